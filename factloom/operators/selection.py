"""Selection: versions, precedence, one row per group, top-k, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in a unique key. Limited before the shuffle as well."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A hint to broadcast ``df`` if it has no more than ``rows`` rows; beyond that it joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def latest_version(df: DataFrame, keys: list[str], as_of: str, tie: str, versions: str = "versions") -> DataFrame:
    """The latest row of each key (ties: the smallest ``tie``) with all versions, newest first, and their number.

    One aggregation: the newest row and the ordered versions come from the same shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.struct((-F.unix_timestamp(as_of)).alias("o"), F.col(tie).alias("t"))
    out = df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), order).alias("_row"),
        F.array_sort(F.collect_list(order)).alias("_all"),
        F.count("*").alias("n_versions"),
    )
    return out.select(*keys, "_row.*", F.transform("_all", lambda x: x["t"]).alias(versions), "n_versions")


def by_precedence(kind: Column, order: list[str]) -> Column:
    """The place of a kind in a list of precedence; unknown kinds come last."""
    return F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(order)], F.lit(len(order)))


def preferred_fact(facts: DataFrame, keys: list[str], kind: str, precedence: list[str], as_of: str, ordinal: list[Column]) -> DataFrame:
    """One fact per key: best kind, then latest, then first by ``ordinal``."""
    return first_per(facts, keys, [by_precedence(F.col(kind), precedence), F.col(as_of).desc_nulls_last(), *ordinal])


def suppressed(ranked: DataFrame, query: str, rank: str, location: list[str], text: str, k: int, prefix: int = 180) -> DataFrame:
    """Walk each query's ranked rows; drop a row whose location or text prefix was already emitted; stop at ``k``.

    A dropped row registers nothing, so the walk is sequential within a query; a query's pool is a bounded top-n list.
    """
    schema = ranked.select("*").schema

    def walk(pdf):
        keep, places, texts = [], set(), set()
        for i, row in pdf.sort_values(rank, kind="stable").iterrows():
            place, head = tuple(str(row[c]) for c in location), " ".join(str(row[text] or "").split())[:prefix]
            if place in places or head in texts:
                continue
            places.add(place), texts.add(head), keep.append(i)
            if len(keep) == k:
                break
        return pdf.loc[keep]

    return ranked.groupBy(query).applyInPandas(walk, schema)


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each of a chain of conditions, in one pass."""
    held, aggs = F.lit(True), []
    for name, condition in stages.items():
        held = held & F.coalesce(condition, F.lit(False))
        aggs.append(F.sum(held.cast("long")).alias(name))
    return df.agg(F.count("*").alias("n_input"), *aggs)
