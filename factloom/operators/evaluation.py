"""Evaluation: ranking metrics, rates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``k`` for each query that has gold; binary gain."""
    hits = ranked.where(F.col(rank) <= k).join(gold.select(query, item).distinct(), [query, item])
    got = hits.groupBy(query).agg(F.count("*").alias("n_hits"), F.min(rank).alias("first_hit"), F.sum(1 / F.log2(F.col(rank) + 1)).alias("dcg"))
    need = gold.groupBy(query).agg(F.countDistinct(item).alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = need.join(got, query, "left")
    return out.select(
        query, F.round(F.coalesce(F.col("n_hits") / F.col("n_gold"), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 4).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 4).alias("ndcg"),
    )


def upper_medians(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The element at n // 2 of each group's sorted values; nulls do not count.

    Equal values are counted before the shuffle, and a running sum over the distinct ones finds the middle, so no group is gathered.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    running = F.sum("_n").over(group.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.select(*keys, F.col(column).alias(name), running.alias("_upto"), F.sum("_n").over(group).alias("_all"))
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(name).alias(name))


def pass_report(cases: DataFrame, dimensions: list[str], passed: str) -> DataFrame:
    """Passes and fails by each dimension alone and in total, from one scan: grouping sets over a single expand."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    out = cases.select(sets.alias("g"), F.col(passed).cast("long").alias("p")).groupBy("g.dimension", "g.value")
    return out.agg(F.sum("p").alias("n_passed"), F.sum(1 - F.col("p")).alias("n_failed"), F.round(F.avg("p"), 4).alias("pass_rate"))


def failure_tally(codes: DataFrame, code: str) -> DataFrame:
    """Failures by full code and by the code's first two parts."""
    both = F.explode(F.array(F.struct(F.lit("full").alias("level"), F.col(code).alias("code")), F.struct(F.lit("prefix").alias("level"), F.substring_index(code, ":", 2).alias("code"))))
    return codes.select(both.alias("c")).groupBy("c.level", "c.code").agg(F.count("*").alias("n"))
