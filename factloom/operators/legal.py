"""References between provisions of law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a reference to an article, its paragraph and its item; one that starts with the word for law means the parent law.
REFERENCE = r"(?:법\s*)?제(\d+)조(?:제(\d+)항)?(?:제(\d+)호(?:의(\d+))?)?"


def law_references(text: Column) -> Column:
    """(raw, parent, article, paragraph, item) of each reference of a text, in order; parts that it does not name are null."""
    part = lambda raw, i: F.nullif(F.regexp_extract(raw, REFERENCE, i), F.lit(""))

    def parsed(raw):
        item = F.concat(part(raw, 3), F.coalesce(F.concat(F.lit("의"), part(raw, 4)), F.lit("")))
        return F.struct(raw.alias("raw"), F.startswith(raw, F.lit("법 ")).alias("parent"), part(raw, 1).alias("article"), part(raw, 2).alias("paragraph"), item.alias("item"))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({REFERENCE})"), 1), parsed)


def resolved(texts: DataFrame, provisions: DataFrame, keys: list[str], law: str, text: str) -> DataFrame:
    """``keys, raw, law, article, paragraph, item, target``: each distinct reference of a text with what it refers to, or null.

    ``provisions``: ``law, article, paragraph, item, text``; the row of a whole article has neither paragraph nor item, that of a paragraph no item. A
    reference is resolved at the level that it names, never at a coarser one. References to the parent law leave the suffix of decrees and rules. An equality join.
    """
    found = texts.select(*keys, F.col(law).alias("_law"), F.explode(F.array_distinct(law_references(F.col(text)))).alias("r")).select(*keys, "_law", "r.*")
    found = found.withColumn("law", F.when(F.col("parent"), F.regexp_replace("_law", " (시행령|시행규칙)$", "")).otherwise(F.col("_law"))).drop("_law", "parent")
    whole = lambda c: F.coalesce(c, F.lit(""))
    known = provisions.groupBy("law", "article", whole(F.col("paragraph")).alias("_p"), whole(F.col("item")).alias("_i")).agg(F.min("text").alias("target"))
    out = found.withColumn("_p", whole(F.col("paragraph"))).withColumn("_i", F.when(F.col("paragraph").isNull(), "").otherwise(whole(F.col("item"))))
    return out.join(known, ["law", "article", "_p", "_i"], "left").select(*keys, "raw", "law", "article", "paragraph", "item", "target")
