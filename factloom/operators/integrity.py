"""Integrity: orphans, set differences, fingerprints, gates, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no parent has; rows with a null key are exempt."""
    known = child
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.join(parent.select(*keys).distinct(), keys, "left_anti")


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with BOTH, LEFT_ONLY or RIGHT_ONLY."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), "LEFT_ONLY").when(F.col("_a").isNull(), "RIGHT_ONLY").otherwise("BOTH")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def fingerprint(df: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """A digest of each key's set of facts that does not depend on their order.

    The digest is the number of distinct facts and two sums of 56-bit parts of their MD5, so it is combined before the shuffle and no
    group is gathered, whatever its size.
    """
    line = F.md5(F.concat(*[_field(F.col(c).cast("string")) for c in facts]).cast("binary"))
    part = lambda start: F.sum(F.conv(F.substring("_f", start, 14), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    distinct = df.select(*keys, line.alias("_f")).distinct()
    return distinct.groupBy(*keys).agg(F.concat_ws(":", F.count("*").cast("string"), part(1), part(15)).alias("fingerprint"))


def _field(c: Column) -> Column:
    """A text with its length before it, so that fields cannot run into each other; null is not the empty text."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def copies_that_differ(df: DataFrame, digest: str, fact: str) -> DataFrame:
    """Groups of equal digests: their number and how many different facts they carry."""
    return df.groupBy(digest).agg(F.count("*").alias("n"), F.countDistinct(fact).alias("n_facts")).where("n > 1")


def gate(checks: DataFrame, key: str, check: str, failed: Column) -> DataFrame:
    """Per key the sorted list of failed checks; passed if there is none."""
    out = checks.groupBy(key).agg(F.array_sort(F.collect_set(F.when(failed, F.col(check)))).alias("_b"))
    return out.select(key, F.concat_ws(",", "_b").alias("blockers"), (F.size("_b") == 0).alias("passed"))


def verdicts(checks: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Counts of each status and the roll-up FAIL > WARNING > PASS."""
    n = lambda s: F.sum((F.col(status) == s).cast("long"))
    out = checks.groupBy(*keys).agg(n("PASS").alias("n_pass"), n("WARNING").alias("n_warning"), n("FAIL").alias("n_fail"), n("SKIP").alias("n_skip"))
    return out.withColumn("verdict", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warning") > 0, "WARNING").otherwise("PASS"))


def changed(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs compared by key: SAME, CHANGED, ADDED or REMOVED. Nulls are equal to nulls."""
    x = a.select(*keys, F.struct(value).alias("_a"))
    y = b.select(*keys, F.struct(value).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED")
        .when(F.col(f"_a.{value}").eqNullSafe(F.col(f"_b.{value}")), "SAME").otherwise("CHANGED")
    )
    return x.join(y, keys, "full_outer").select(*keys, status.alias("change"))


def persistence_blockers(docs: DataFrame, risks: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc, blockers``: why a document must not be stored, without repeats and in a fixed order; empty: it may.

    ``docs``: ``doc, hash, expected_hash``. ``risks``: ``doc, i, name, refs`` (ids of chunks). ``chunks``: ``chunk_id, text``. ``facts``: ``doc, field, i, refs, status``. A
    risk's name must stand, but for marks and white space, in the chunks that it refers to; every fact needs a reference, and none may have failed its check.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^가-힣A-Za-z0-9]", "")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    each = risks.select("doc", "i", F.posexplode("refs").alias("at", "chunk_id")).join(chunks, "chunk_id")
    said = each.groupBy("doc", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("said"))
    r = risks.join(said, ["doc", "i"], "left")
    label = lambda text: F.concat(F.lit(f"{text}["), F.col("i").cast("string"), F.lit("]"))
    name = F.coalesce("name", F.lit(""))
    unanchored = none(F.col("refs")) | (bare(name) == "") | ~F.contains(bare(F.col("said")), bare(name))
    marks = F.array_compact(F.array(F.when(F.trim(name) == "", label("RISK_NAME_EMPTY")), F.when(name.rlike("[\n\r\t]"), label("RISK_NAME_LAYOUT_WHITESPACE")), F.when(unanchored, label("RISK_NAME_NOT_SOURCE_ANCHORED"))))
    found = r.select("doc", F.explode(marks).alias("b"))
    path = F.concat("field", F.lit("["), F.col("i").cast("string"), F.lit("]"))
    failed = F.when(F.coalesce(F.col("status") == "FAIL", F.lit(False)), F.concat(F.lit("EVIDENCE_FAIL:"), path))
    bare_fact = F.when(none(F.col("refs")), F.concat(F.lit("FACT_MISSING_EVIDENCE:"), path))
    found = found.unionByName(facts.select("doc", F.explode(F.array_compact(F.array(failed, bare_fact))).alias("b")))
    changed = docs.where(~F.col("hash").eqNullSafe(F.col("expected_hash"))).select("doc", F.lit("DOCUMENT_HASH_MISMATCH").alias("b"))
    all_ = found.unionByName(changed).groupBy("doc").agg(F.array_sort(F.collect_set("b")).alias("blockers"))
    return docs.select("doc").join(all_, "doc", "left").select("doc", F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"))
