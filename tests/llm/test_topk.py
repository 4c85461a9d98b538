import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import hamming_topk as H
from tests.llm.helpers import SF


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expect(codes, queries, k):
    out = set()
    for q, qc in queries:
        ranked = sorted(((qc ^ c).bit_count(), i) for i, c in codes)[:k]
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(ranked)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, signed(c)) for i, c in rows], "vec_id long, code long")


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "few"])
def test_against_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "spread":
        codes = [rng.getrandbits(64) for _ in range(300)]
    elif kind == "clustered":
        centres = [rng.getrandbits(64) for _ in range(5)]
        codes = [rng.choice(centres) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    elif kind == "copies":
        codes = [7] * 150 + [rng.getrandbits(64) for _ in range(50)]
    else:
        codes = [0, (1 << 64) - 1, 5]
    rows = list(enumerate(codes))
    queries = rows[::17] + [(9000, 0)]
    got = {tuple(r) for r in H.top_k(frame(spark, rows), frame(spark, queries), 10).collect()}
    assert got == expect(rows, queries, 10)


def test_empty(spark):
    df = frame(spark, [(1, 1)])
    assert H.top_k(df, df.where("false")).count() == 0
    assert H.top_k(df.where("false"), df).count() == 0


def test_codes(spark):
    rows = [(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, []), (4, [1.0] + [0.0] * 63), (5, [-1.0] * 63 + [1.0]), (6, [-1.0] * 64 + [1.0]), (7, [None, 1.0])]
    got = {r.vec_id: r.code for r in H.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0b1001, 3: 0, 4: 1, 5: -(1 << 63), 6: 1, 7: 2}


def test_query_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, sum(1 << i for i, x in enumerate(r.embedding) if x > 0)) for r in e]
    got = {tuple(r) for r in H.op6_topk(spark, SF).select("query_id", "rank", "vec_id", F.col("distance").cast("int")).collect()}
    assert got == expect(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_many_codes_share_a_segment(spark):
    rng = random.Random(8)
    rows = [(i, (rng.getrandbits(40) << 24) | 0xABCDEF) for i in range(10_000)] + [(10_000 + i, rng.getrandbits(64)) for i in range(200)]
    queries = rows[::1700] + [(20_000, 0xABCDEF)]
    got = {tuple(r) for r in H.top_k(frame(spark, rows), frame(spark, queries), 10).collect()}
    assert got == expect(rows, queries, 10)


def test_candidates_are_limited_before_the_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(H, "stored", lambda df, name, f=H.stored: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "nearest" else None) or f(df, name))
    rows = [(i, i * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(50)]
    H.top_k(frame(spark, rows), frame(spark, rows[:3]), 5).collect()
    assert plans and all("WindowGroupLimit" in p and "Partial" in p for p in plans)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, 5), (1, 5), (1, 9), (2, 5), (3, 1 << 63), (None, 5)]
    df = frame(spark, rows)
    for c in ("ids", "n", "bound", "found", "distance", "key", "rank"):
        df = df.withColumn(c, F.lit("own"))
    got = sorted((r.rank, r.vec_id, r.distance) for r in H.top_k(df.where("vec_id is not null"), frame(spark, [(7, 5)]), 4).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 2)]
