"""Joins in time: as-of, validity intervals, time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie: str) -> DataFrame:
    """Each left row with the latest right row of its key that is not later; null payload if there is none.

    Both sides go through one shuffle on the key and one sort; a running last value carries the right side's row forward, so no pair
    of rows is ever built. Right rows of one time: the largest ``tie`` wins.
    """
    cols = left.columns
    right = right.where(F.col(right_time).isNotNull())
    a = left.select(*keys, F.struct(*cols).alias("_left"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_left"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.struct(*payload).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in payload])


def valid_at(rules: DataFrame, moment: Column, start: str, end: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key, the first of the rules that hold at a moment; an open end holds on."""
    held = rules.where((F.col(start) <= moment) & (moment <= F.coalesce(F.col(end), F.lit("9999-12-31").cast("timestamp"))))
    return held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def current_without_conflict(versions: DataFrame, keys: list[str], effective: str, content: str, as_of: Column) -> DataFrame:
    """The content of the latest version that is not after ``as_of``; nothing where that date has two contents."""
    own = versions.where(F.col(effective) <= as_of).groupBy(*keys, effective).agg(F.countDistinct(content).alias("_n"), F.min(content).alias(content))
    last = own.groupBy(*keys).agg(F.max_by(F.struct(effective, content, "_n"), effective).alias("_v"))
    return last.where("_v._n = 1").select(*keys, f"_v.{effective}", f"_v.{content}")


def live_entries(entries: DataFrame, expires: str, now: Column, last_access: str, key: str, capacity: int) -> DataFrame:
    """Entries that have not expired, the most recently used ``capacity`` of them."""
    return entries.where(F.col(expires) > now).orderBy(F.col(last_access).desc(), key).limit(capacity)


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions by a gap of silence: user, session number, start, end, events."""
    w = Window.partitionBy(user).orderBy(ts)
    new = F.coalesce((F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap_seconds).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))
