import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import packing
from tests.llm.helpers import SF, documents


def check(rows, texts, capacity):
    """Every id in one piece, sequences gapless and not over capacity. Returns the padding."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length * 4 == len(r.ids)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == [*exact.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        at = 0
        for r in pieces:
            assert r.start == at
            at += r.length
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    assert check(rows, {r.doc_id: r.text for r in docs.collect()}, 1024) == 0
    out = packing.op1_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in out) == sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)


def test_small_pools_and_hot_lengths(spark):
    texts = ["the cat " * 20] * 40 + [None, "", "x", "<|endoftext|> a", "è\u0085​\U0001f600"] + ["word " * n for n in (1, 7, 63, 64, 500)]
    docs = documents(spark, *texts, extra=True).repartition(3)
    rows = packing.pack(docs, capacity=64, pool_tokens=256).collect()
    assert check(rows, dict(enumerate(texts)), 64) == 0


def test_empty_table(spark):
    assert packing.pack(documents(spark, "a").where("false")).count() == 0


def test_closest_filling_is_optimal():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        target = rng.randint(0, 60)
        got = packing.closest_filling(sorted(counts.items(), reverse=True), target)
        assert all(n <= counts[x] for x, n in got.items())
        reach = {0}
        for x, n in counts.items():
            reach = {r + k * x for r in reach for k in range(n + 1) if r + k * x <= target}
        assert sum(x * n for x, n in got.items()) == max(reach)


def test_repeated_rows(spark):
    docs = documents(spark, "same text here").withColumn("doc_id", F.lit(5).cast("long"))
    rows = packing.pack(docs.unionAll(docs)).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens
