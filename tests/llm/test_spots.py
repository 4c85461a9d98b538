import re
from hashlib import sha256
from itertools import islice

import numpy as np
import pytest

from factloom.llm import spot_signatures as S
from tests.llm.helpers import DOCS, SF, documents


def plain(text):
    """Spot signatures as tuples of words."""
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            chain = list(islice((x for x in islice(words, i + 1, None) if x not in S.ANCHORS), S.CHAIN)) if len(words) < 1000 else [x for x in words[i + 1 : i + 50] if x not in S.ANCHORS][: S.CHAIN]
            if len(chain) == S.CHAIN:
                out.add((w, *chain))
    return out or {("", *words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for (some, i, t), (_, _, u) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 2
        edited = t[: len(t) - cut] + u[:cut]
        out.append((i if some else None, len(t), sha256(edited.encode()).hexdigest(), round(jaccard(plain(t), plain(edited)), 9), round(jaccard(plain(t), plain(u)), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = S.op13_spot_signatures(spark, sf)
    assert found(got) == brute([tuple(r) for r in rows])
    by_text = {}
    names = {r.doc_id: r.fingerprint for r in got.collect()}
    for doc, text in rows:
        by_text.setdefault(text, set()).add(names[doc])
    assert all(len(v) == 1 for v in by_text.values())
    assert len(set(names.values())) > 0.95 * len({frozenset(plain(t or "")) for _, t in rows})


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_order_nulls_repeats_and_long_texts(spark, ranges):
    long = "The quick brown fox. " * 3_000 + "of some other thing"
    rows = [(5, "the house on the hill was old"), (5, "the house on the hill was old"), (5, None), (None, "no id at all in the world"), (None, None), (7, ""), (9, long), (-3, "é" * 9), (8, "x"), (10, "the a of and"), (11, "THE House, on the HILL was old")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    df = df.selectExpr("*", "1 as range", "2 as guest", "'own' as fingerprint")
    assert found(S.with_next(df, ranges=ranges)) == brute(rows)
    assert found(S.with_next(df.where("text = 'x'"), ranges=ranges)) == brute([(8, "x")])
    assert S.with_next(df.where("false"), ranges=ranges).count() == 0


def test_likeness_ends_early_and_right():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 2000, rng.integers(1, 1500)).astype(np.uint64)) for _ in "ab")
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], b[:50]]))
            if not len(b):
                continue
        true = jaccard(set(a.tolist()), set(b.tolist()))
        assert S.likeness(a, b) == true
        for least in (0.3, 0.8):
            assert S.likeness(a, b, least) == (true if true >= least else 0.0)


def test_similar_pairs_are_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs, members = S.similar(S.prints(docs))
    texts = {r.doc_id: plain(r.text or "") for r in docs.select("doc_id", "text").collect()}
    name = {r.doc_id: r.fingerprint for r in members.collect()}
    sets = {name[i]: s for i, s in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.fingerprint, r.similar) for r in pairs.collect()} == want and len(want) > 5


def test_similar_without_rows_and_with_copies(spark):
    pairs, members = S.similar(S.prints(documents(spark)))
    assert pairs.count() == members.count() == 0
    pairs, members = S.similar(S.prints(documents(spark, None, "", "one", "one", "the red house of the old man", "the red house of the old man", extra=True)))
    got = {r.doc_id: r.fingerprint for r in members.collect()}
    assert pairs.count() == 0 and got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and len(set(got.values())) == 3
