"""Catalog search: facts reduced to one row per class, filters, one row per product, ranks, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.operators.selection import by_precedence, first_per

FEE_PRECEDENCE = ["R", "A", "N"]


def catalog(classes: DataFrame, fees: DataFrame) -> DataFrame:
    """The serving table: one row per class with its preferred fee, its number of facts, a grade and a bucket.

    ``classes``: record_id, class_name, product_name, kind, risk_grade, is_online. ``fees``: record_id, fee_type, rate, as_of, ordinal. The fee is
    picked by a grouped minimum over (precedence, latest, ordinal), so it is combined before the shuffle.
    """
    order = F.struct(by_precedence(F.col("fee_type"), FEE_PRECEDENCE), -F.unix_timestamp("as_of"), F.col("ordinal"))
    picked = fees.groupBy("record_id").agg(F.min_by("rate", order).alias("total_fee"), F.count("*").alias("n_fees"))
    out = classes.join(picked, "record_id", "left")
    return out.withColumn("risk_bucket", rules.risk_bucket(F.lit(None).cast("string"), F.col("risk_grade")))


def search(
    records: DataFrame, *, record_ids: list[int] | None = None, grade_max: int | None = None, tolerance: str | None = None, online: bool = False,
    sort_by: str = "product_name", descending: bool = False, limit: int = 5,
) -> DataFrame:
    """Filter, keep one class per product, sort and take the first ``limit`` (clamped to 1..10).

    Null grades fail a grade filter, unknown buckets fail a tolerance, null fees leave a fee sort. A descending sort turns its ties as well.
    """
    if record_ids:
        records = records.where(F.col("record_id").isin(record_ids))
    if grade_max is not None:
        records = records.where(F.col("risk_grade") <= grade_max)
    if tolerance:
        records = records.where(rules.tolerated(F.col("risk_bucket"), tolerance))
    if online:
        records = records.where(F.coalesce("is_online", F.lit(False)))
    if sort_by == "total_fee":
        records = records.where(F.col("total_fee").isNotNull())
    inner: list[Column] = [F.col("total_fee")] if sort_by == "total_fee" else []
    one = first_per(records, ["product_name"], [*inner, F.col("class_name"), F.col("record_id")])
    order = [F.col(c) for c in ([sort_by] if sort_by != "product_name" else []) + ["product_name", "class_name", "record_id"]]
    return one.orderBy(*[c.desc() if descending else c.asc() for c in order]).limit(min(10, max(1, limit)))
