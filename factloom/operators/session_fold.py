"""The state that a conversation carries from turn to turn, by running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of silence after which nothing is carried on.
TTL = 1800


def session_fold(turns: DataFrame, key: str, order: list[str], said: Column, asks: Column, topic: Column, slots: dict[str, Column], at: str | None = None, ttl: int = TTL) -> DataFrame:
    """``turns`` with the state after each: ``session, last_topic, question_at, <slot>..., missing, action``.

    ``said`` tells whose turns count, ``asks`` which of them are questions; ``topic`` and ``slots`` are values named in a turn, null if none. A value stays until another is named.
    ``question_at`` is the last question's number among the session's turns, ``missing`` the slots without a value, in their given order. ``action``: a question, or a turn that fills a slot
    after one, is CLARIFY while slots are missing; the turn that fills the last is RESUME (the question is taken up again); any other is ANSWER, and null for turns that do not count.
    A silence of more than ``ttl`` seconds by the timestamp ``at`` begins a new session without state; a null time is no silence.

    Turns are in the order of ``order``, nulls first; rows that are equal in it should be equal in all. One shuffle by the key serves all windows, and frames run with the rows, so a long conversation
    is sorted by one task, with spill, but is never in memory whole. The columns of the state replace columns of these names.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    counts = F.coalesce(said, F.lit(False))
    in_key = Window.partitionBy(key).orderBy(*by)
    if at:
        silent = F.unix_micros(F.col(at)) - F.unix_micros(F.last(at, ignorenulls=True).over(in_key.rowsBetween(Window.unboundedPreceding, -1))) > ttl * 1_000_000
        turns = turns.withColumn("_silent", F.coalesce(silent, F.lit(False)).cast("long")).withColumn("session", F.sum("_silent").over(in_key.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        turns = turns.withColumn("session", F.lit(0).cast("long"))
    w = Window.partitionBy(key, "session").orderBy(*by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda value: F.last(F.when(counts, value), ignorenulls=True).over(so_far)
    asked = counts & F.coalesce(asks, F.lit(False))
    state = {f"_slot_{i}": carried(c) for i, c in enumerate(slots.values())}
    rows = turns.withColumns({"_counts": counts, "_asked": asked, "_topic": carried(topic), "_n": F.row_number().over(w).cast("long"), **state})
    missing = F.array_compact(F.array(*[F.when(F.col(f"_slot_{i}").isNull(), F.lit(name)) for i, name in enumerate(slots)])) if slots else F.array().cast("array<string>")
    rows = rows.withColumn("_missing", missing).withColumns({"_before": F.lag(F.size("_missing"), 1, len(slots)).over(w), "_question": F.last(F.when(F.col("_asked"), F.col("_n")), ignorenulls=True).over(so_far)})
    fills = F.col("_question").isNotNull() & (F.size("_missing") < F.col("_before"))
    lacks = F.size("_missing") > 0
    action = F.when(~F.col("_counts"), None).when((F.col("_asked") | fills) & lacks, "CLARIFY").when(~F.col("_asked") & fills, "RESUME").otherwise("ANSWER")
    named = {"last_topic": F.col("_topic"), "question_at": F.col("_question"), **{name: F.col(f"_slot_{i}") for i, name in enumerate(slots)}, "missing": F.col("_missing"), "action": action}
    return rows.withColumns(named).drop("_silent", "_counts", "_asked", "_topic", "_n", "_missing", "_before", "_question", *state)
