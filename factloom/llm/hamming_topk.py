"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments. Search radii grow one segment at a time: at radius r the values at exactly r
differing bits from a query's segment are probed, and the whole distance of what the index holds there is verified. When
segments 0..a have been searched to radius r and the others to r - 1, every code within ``segments * r + a`` bits has been
seen: one no further off would differ by r or fewer bits in one of the former or by r - 1 or fewer in one of the latter. A query
closes when its k-th verified distance is covered so. The first rounds are cheap and take all segments at once. Copies are
searched once: the index holds distinct codes with their number and k smallest ids, and queries with equal codes share one search.

What a probe finds is cut to each query's ``k`` best codes in the task that found it, before any shuffle, so a segment value that very many
codes share sends no more than that; joins on such a value are between written tables, which Spark splits.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored

BITS, K = 64, 10
#: From this radius on a round takes one segment.
STEPWISE = 3


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``code``: bit i is 1 if number i is above zero (of numbers 64 apart: if any is). Null vectors have no code and are left out."""
    one = F.lit(1).cast("long")
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, F.pmod(i, F.lit(BITS)))).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector_col, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), code.alias("code"))


def segment_count(codes: int) -> int:
    """So many that none is wider than log2(codes) bits; between 2 and 8."""
    return max(2, min(8, ceil(BITS / max(1.0, log2(max(2, codes))))))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def _probe(value: F.Column, masks: list[int], n: int, k: int) -> F.Column:
    constant = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")  # folds to one literal, however many masks there are
    return F.transform(constant, lambda m: value.bitwiseXOR(m) * n + k)


def _keys(codes: DataFrame, n: int, segments: range, radius: int, *more: str) -> DataFrame:
    """A row for each value at exactly ``radius`` bits from each of the named ones of a code's ``n`` segments."""
    edges = [BITS * i // n for i in range(n + 1)]
    arrays = []
    for k in segments:
        a, width = edges[k], edges[k + 1] - edges[k]
        if radius <= width:
            value = F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << width) - 1))
            arrays.append(_probe(value, _masks(width, radius), n, k))
    return codes.select(F.explode(F.concat(*arrays)).alias("key"), "code", *more)


def schedule(n: int):
    """(segments, radius, distance that is covered then), until every code has been seen."""
    widest = max(BITS * (i + 1) // n - BITS * i // n for i in range(n))
    for radius in range(widest + 1):
        if radius < STEPWISE:
            yield range(n), radius, n * (radius + 1) - 1
        else:
            for k in range(n):
                if radius <= BITS * (k + 1) // n - BITS * k // n:
                    yield range(k, k + 1), radius, n * radius + k


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, distance``: the ``k`` nearest rows of ``codes`` by distance, then id, for each row of ``queries``.

    Both: ``vec_id, code``. A query that is among ``codes`` finds itself. Fewer rows than ``k``: all of them. Ties are cut by id. Rows that
    repeat an id count each for themselves. Empty tables give no rows.
    """
    by_code = Window.partitionBy("code").orderBy("vec_id")
    firsts = codes.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k)  # limited before the shuffle, too
    index = stored(firsts.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "codes")
    distinct, rows = index.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    n, need = segment_count(distinct), min(k, rows)
    open_ = stored(queries.select("code").distinct().withColumn("bound", F.lit(BITS)), "queries")
    keyed = stored(_keys(index, n, range(n), 0, "ids"), "keyed")
    best, done, plan = None, [], schedule(n)
    while not open_.isEmpty():
        segments, radius, covered = next(plan, (None, 0, 0))
        if segments is None:  # every code has been seen; there are fewer than k rows
            done.append(best)
            break
        a, b = _keys(open_, n, segments, radius, "bound").alias("a"), keyed.alias("b")
        distance = F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code")))
        # the planner does not see how many rows explode() makes, so it must not take the probes for a small side
        near = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (distance <= F.col("a.bound")))
        near = near.select(F.col("a.code").alias("code"), F.col("b.code").alias("found"), distance.alias("distance"), F.col("b.ids").alias("ids"))
        pool = near if best is None else near.unionByName(best)
        # a code that several segments find has one rank; limited to k ranks before the shuffle, too
        rank = F.dense_rank().over(Window.partitionBy("code").orderBy("distance", F.get("ids", 0), "found"))
        pool = stored(pool.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank").distinct(), "nearest")
        reach = F.aggregate(
            F.array_sort(F.collect_list(F.struct("distance", F.size("ids").alias("n")))), F.struct(F.lit(0).alias("held"), F.lit(BITS).alias("last")),
            lambda a, x: F.when(a["held"] >= need, a).otherwise(F.struct((a["held"] + x["n"]).alias("held"), x["distance"].cast("int").alias("last"))),
        )
        full = pool.groupBy("code").agg(reach.alias("r")).select("code", "r.held", "r.last")
        state = open_.select("code").join(full, "code", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        state = stored(state.withColumn("closed", (F.col("held") >= need) & ((F.col("last") <= covered) | F.lit(need == rows))), "state")
        done.append(pool.join(state.where("closed"), "code", "left_semi"))
        open_ = state.where("not closed").select("code", F.when(F.col("held") >= k, F.col("last")).otherwise(F.lit(BITS)).alias("bound"))
        best = pool.join(open_, "code", "left_semi")
    if not done:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).alias("distance")).where("false")
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))
    answers = answers.select("code", "distance", F.explode("ids").alias("vec_id")).withColumn("rank", rank).where(F.col("rank") <= k)
    return queries.select(F.col("vec_id").alias("query_id"), "code").join(answers, "code").select("query_id", "rank", "vec_id", "distance")


def op6_topk(spark, sf_dir):
    codes = stored(sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "codes")
    return top_k(codes, codes.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH codes AS (
  SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (2::HUGEINT ** (i - 1))::HUGEINT ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""
