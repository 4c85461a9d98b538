import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import token_attribution as A
from tests.llm.helpers import SF, documents

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expect(fields, rule):
    """(field, section, tokens) by walking over every token's bytes."""
    owners, parts = [], []
    for k, (name, text) in enumerate(fields):
        own = (text or "") + ("\n" if k + 1 < len(fields) else "")
        lines = own.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owners += [(name, i) for i in range(len(lines))]
        parts += lines
    of = [i for i, p in enumerate(parts) for _ in p.encode()]
    counts, at = [0] * len(parts), 0
    for i in EXACT.encode("".join(parts), add_special_tokens=False).ids:
        n = len(EXACT.id_to_token(i))  # one printable character for each byte
        held = of[at : at + n]
        counts[held[0] if rule == "first" else max(dict.fromkeys(held), key=held.count)] += 1
        at += n
    return {(*o, c) for o, c in zip(owners, counts)}


TEXTS = ["one\n\n\ntwo  \n three", "", None, "no line end", "end\n", "\n\n\n\n", "é\nß한\n😀\n\n  x", "a" * 5000 + "\n" + "b"]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_against_walking(spark, rule):
    got = {}
    for r in A.token_counts(documents(spark, *TEXTS), ["source", "text"], rule=rule).collect():
        got.setdefault(r.doc_id, set()).add((r.field, r.section, r.n_tokens))
    assert got == {i: expect([("source", "s"), ("text", t)], rule) for i, t in enumerate(TEXTS)}


def test_query_sums_to_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    total = {}
    for r in A.op5_token_counts(spark, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d.doc_id: len(EXACT.encode(f"{d.source}\n{d.text}", add_special_tokens=False).ids) for d in docs}


def test_empty_table(spark):
    assert A.token_counts(documents(spark, "a").where("false"), ["text"]).count() == 0
