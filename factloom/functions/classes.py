"""Attributes that the name of a share class states, and the kinds of its figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a class name or a condition, and what they state; the first that is found counts.
CHARGES = {"선취": "FRONT_END", "후취": "BACK_END", "미징구": "NONE"}
CHANNELS = {"온라인": "ONLINE", "오프라인": "OFFLINE"}
PENSIONS = {"퇴직연금": "RETIREMENT_PENSION", "개인연금": "PERSONAL_PENSION", "연금저축": "PERSONAL_PENSION"}
CONDITIONS = {"이내": "MAX", "이하": "MAX", "최대": "MAX", "이상": "MIN", "최소": "MIN"}


def first_stated(text: Column, words: dict[str, str]) -> Column:
    """What the first of ``words`` that the text holds states; null if none."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), v) for w, v in words.items()))


def class_attributes(name: Column) -> Column:
    """(charge, channel, pension, online) that a class name states; each null if it does not say."""
    channel = first_stated(name, CHANNELS)
    return F.struct(first_stated(name, CHARGES).alias("charge"), channel.alias("channel"), first_stated(name, PENSIONS).alias("pension"), (channel == "ONLINE").alias("online"))


def rate_condition(condition: Column) -> Column:
    """MAX or MIN by the words of a limit, EXACT for any other condition, UNKNOWN without one."""
    bare = F.regexp_replace(F.coalesce(condition, F.lit("")), r"\s+", "")
    return F.coalesce(first_stated(bare, CONDITIONS), F.when(F.coalesce(condition, F.lit("")) != "", "EXACT").otherwise("UNKNOWN"))


def routed_rate(condition: Column, rate: Column) -> Column:
    """(rate, rate_max, rate_min): the place of a rate by its condition."""
    kind = rate_condition(condition)
    return F.struct(F.when(kind.isin("EXACT", "UNKNOWN"), rate).alias("rate"), F.when(kind == "MAX", rate).alias("rate_max"), F.when(kind == "MIN", rate).alias("rate_min"))


def metric_type(given: Column, subject: Column, kind: Column, class_name: Column) -> Column:
    """The stated type of a figure, else what its subject or kind implies: the benchmark's, volatility, or the fund's own return."""
    text = F.concat(F.coalesce(subject, class_name, F.lit("")), F.coalesce(kind, F.lit("")))
    is_kind = lambda k: F.coalesce(kind == k, F.lit(False))
    implied = (
        F.when(F.contains(text, F.lit("비교지수")) | is_kind("benchmark"), "benchmark_return")
        .when(F.contains(text, F.lit("변동성")) | is_kind("volatility"), "volatility")
        .when((F.coalesce(class_name, F.lit("")) != "") | is_kind("class"), "fund_return")
    )
    return F.coalesce(F.when(given != "", given), implied)
