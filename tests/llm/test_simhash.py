import random

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash_dedup as S
from factloom.llm.common import connected_components
from tests.llm.helpers import SF, classes, documents


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expect(rows):
    fps = {d: slow_fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = classes(pairs, ids)
    return {d: (f"{fps[d]:016x}", comp[d]) for d in ids}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op7_simhash(spark, SF).collect()}
    assert got == expect([(d.doc_id, d.text) for d in docs])


def test_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c dé"))).first()[0] == S._signed(xxhash.xxh64_intdigest("a b c dé".encode(), 42))


def test_edge_texts(spark):
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four", "One\x0bTWO three  four", "É a b c d", "é a b c d"] + ["x y z w v " * 400]
    got = {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in S.near_duplicates(documents(spark, *texts, extra=True)).collect()}
    assert got == expect(list(enumerate(texts)))
    assert got[0] == ("0" * 16, 0) and got[2][1] == 0


@pytest.mark.parametrize("dense", [1, 3, 10_000])
def test_links_by_both_ways(spark, dense):
    rng = random.Random(dense)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    found = [(r.u, r.v) for r in S.links(df, len(fps), dense).collect()]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in found)
    assert classes(found, range(len(fps))) == classes(near, range(len(fps)))


def test_wide_plan_covers_the_radius():
    for count in (10, 1 << 30):
        plan = S.segments(count)
        assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == S.RADIUS + 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(500, 560)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes(real, {x for e in real for x in e})
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_and_repeated(spark):
    docs = documents(spark, "some words are here now", "some words are here now")
    assert S.near_duplicates(docs.where("false")).count() == 0
    assert sorted(r.component_id for r in S.near_duplicates(docs.unionAll(docs)).collect()) == [0, 0, 0, 0]
