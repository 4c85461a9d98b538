"""Rows of tables that support a fact: a join within a tolerance, five keys of rank, and staged search for a performance row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 5e-4
#: Added to the tolerance where buckets are chosen, so that rounding loses no neighbour; the exact comparison follows.
ROUNDING = 1e-9


def bucket(value: Column, tolerance: float) -> Column:
    """The number of a value's bucket; buckets are as wide as a whole tolerance band."""
    return F.floor(value / (2 * (tolerance + ROUNDING))).cast("long")


def buckets_near(value: Column, tolerance: float) -> Column:
    """The one or two buckets that hold everything within the tolerance of a value."""
    reach = tolerance + ROUNDING
    return F.array_distinct(F.array(bucket(value - reach, tolerance), bucket(value + reach, tolerance)))


def within(facts: DataFrame, cells: DataFrame, keys: list[str], value: str, cell: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of ``facts`` with those of ``cells`` that agree in ``keys`` and whose ``cell`` differs from ``value`` by ``tolerance`` at most.

    A band join as an equality join: a cell lies in one bucket and a fact looks into the one or two that its band touches. Nulls match nothing.
    """
    looks = facts.where(F.col(value).isNotNull()).withColumn("_bucket", F.explode(buckets_near(F.col(value), tolerance)))
    lies = cells.where(F.col(cell).isNotNull()).withColumn("_bucket", bucket(F.col(cell), tolerance))
    return looks.join(lies, [*keys, "_bucket"]).where(F.abs(F.col(value) - F.col(cell)) <= tolerance).drop("_bucket")


def supporting_rows(facts: DataFrame, cells: DataFrame, keys: list[str], value: str, cell: str, page: str, cell_page: str, section: str, header: str, width: str, names: list[str], tolerance: float = TOLERANCE, differs: Column | None = None) -> DataFrame:
    """For each distinct fact (all columns of ``facts``) the row that supports it best, in ``support``: ``exact, section, header, distance, width`` and its ``names``; facts without support are left out.

    Rank: the exact value first, then a row of the right ``section``, then under the right ``header`` (both boolean), then the nearest page, then the widest row, then its names.
    ``differs``: a further condition on a fact and a row. Facts are made distinct before the join and the best row is a grouped minimum, so no pairs are sorted.
    """
    own = facts.columns
    met = within(facts.distinct(), cells, keys, value, cell, tolerance)
    if differs is not None:
        met = met.where(differs)
    rank = F.struct(
        (F.col(value) != F.col(cell)).alias("inexact"), (~F.coalesce(section, F.lit(False))).alias("elsewhere"), (~F.coalesce(header, F.lit(False))).alias("unlike"),
        F.abs(F.col(page) - F.col(cell_page)).alias("distance"), (-F.col(width)).alias("narrow"), *names,
    )
    best = met.groupBy(*own).agg(F.min(rank).alias("_r"))
    found = F.struct((~F.col("_r.inexact")).alias("exact"), (~F.col("_r.elsewhere")).alias("section"), (~F.col("_r.unlike")).alias("header"), F.col("_r.distance").alias("distance"), (-F.col("_r.narrow")).alias("width"), *[F.col(f"_r.{n}").alias(n) for n in names])
    return best.select(*own, found.alias("support"))


def performance_row(facts: DataFrame, rows: DataFrame, fact: str, table: str, row: str, label: str, kind: str, name: str, value: str, cell: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``fact, row, stage``: the row of each fact in its ``table``, by the first stage that gives one.

    ``kind`` of a fact: benchmark or volatility (the first row of that kind), else its class ``name`` (the first row with that label), else, for a fund without a class, the only row
    of no special kind that carries the expected value. ``rows``: ``table, row, label, kind, cell`` (one row for each table row). ``facts``: ``fact, table, kind, name, value``.
    """
    special = ["benchmark", "volatility"]
    r = rows.select(table, F.col(row).alias("_row"), F.col(label).alias("_label"), F.col(kind).alias("_kind"), F.col(cell).alias("_cell"))
    by_kind = r.where(F.col("_kind").isin(special)).groupBy(table, F.col("_kind").alias(kind)).agg(F.min("_row").alias("_by_kind"))
    by_name = r.groupBy(table, F.col("_label").alias(name)).agg(F.min("_row").alias("_by_name"))
    plain = r.where(~F.coalesce(F.col("_kind").isin(special), F.lit(False)))
    lone = within(facts.where(F.col(name).isNull() & ~F.coalesce(F.col(kind).isin(special), F.lit(False))).select(fact, table, value), plain, [table], value, "_cell", tolerance)
    lone = lone.groupBy(fact).agg(F.min("_row").alias("_lone"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    met = facts.join(by_kind, [table, kind], "left").join(by_name, [table, name], "left").join(lone, fact, "left")
    named = F.when(F.col(kind).isin(special), F.lit(None)).otherwise(F.col("_by_name"))
    stage = F.when(F.col("_by_kind").isNotNull(), F.col(kind)).when(named.isNotNull(), "class").when(F.col("_lone").isNotNull(), "value")
    return met.select(fact, F.coalesce("_by_kind", named, "_lone").alias(row), stage.alias("stage"))


def phrases_in(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str, text: str, phrase: str, words: str = r"[^\p{L}\p{N}]+", longest: int = 16) -> DataFrame:
    """``text_id, phrase_id, at, n_words``: every place (word, from 1) where a phrase of up to ``longest`` words stands in a text, in lower case and as whole words.

    Texts are read as runs of words of the lengths that phrases have; a run's hash finds its phrase by an equality join and the words decide. Runs are made only where
    their first word begins a phrase of that length. Of phrases with equal words all are found. Empty and longer phrases are in no text.
    """
    split = lambda c: F.filter(F.split(F.lower(c), words), lambda w: w != "")
    own = phrases.select(phrase_id, split(F.col(phrase)).alias("_said")).where(F.size("_said").between(1, longest)).withColumn("_n", F.size("_said"))
    starts = own.groupBy(F.get("_said", F.lit(0)).alias("_first")).agg(F.collect_set("_n").alias("_lengths"))  # at most ``longest`` each
    each = texts.select(text_id, split(F.col(text)).alias("_words"))
    most = own.agg(F.max("_n")).first()[0] or 1
    # each place carries the words that a phrase could take there, never the whole text; they are put together only where a phrase may begin
    ahead = F.arrays_zip(*[F.slice(F.col("_words"), n, F.greatest(F.size("_words"), F.lit(1))).alias(f"_w{n}") for n in range(1, most + 1)])
    places = each.select(text_id, F.posexplode(ahead).alias("_i", "_x")).select(text_id, (F.col("_i") + 1).alias("at"), F.col("_x._w1").alias("_first"), *[f"_x._w{n}" for n in range(1, most + 1)])
    met = places.join(starts, "_first").select(text_id, "at", F.explode("_lengths").alias("_n"), *[f"_w{n}" for n in range(1, most + 1)])
    said = F.when(F.col("_n") == 1, F.array("_w1"))
    for n in range(2, most + 1):
        said = said.when((F.col("_n") == n) & F.col(f"_w{n}").isNotNull(), F.array(*[f"_w{i}" for i in range(1, n + 1)]))
    runs = met.select(text_id, "at", "_n", said.alias("_said")).where("_said is not null")
    return runs.join(own.drop("_n"), "_said").select(text_id, phrase_id, "at", F.col("_n").alias("n_words"))


def longest_first(found: DataFrame, text_id: str, phrase_id: str) -> DataFrame:
    """Of ``phrases_in`` the places that are left when a text is read from its beginning and at each place the longest phrase is taken (the smallest id on ties)."""
    best = found.groupBy(text_id, "at").agg(F.max_by(F.struct(phrase_id, "n_words"), F.struct("n_words", -F.col(phrase_id))).alias("x")).select(text_id, "at", "x.*")
    listed = best.groupBy(text_id).agg(F.array_sort(F.collect_list(F.struct("at", phrase_id, "n_words"))).alias("all"))
    kept = F.aggregate(
        "all", F.struct(F.lit(0).alias("end"), F.slice("all", 1, 0).alias("kept")),
        lambda s, x: F.when(x["at"] > s["end"], F.struct((x["at"] + x["n_words"] - 1).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
    )["kept"]
    return listed.select(text_id, F.inline(kept))
