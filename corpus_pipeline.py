"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import packing, quality_gbt, simhash_similar, toxicity_cnn
from factloom.llm.common import bitmap, parted, stored, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(``docs`` with columns ``c0, c1, ...``; the operators' column parameters; those names): no name of an own column can clash with an operator's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    return docs.toDF(*names), {"id_col": at["doc_id"], "text_col": at["text"], "lang_col": at["lang"]}, names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject at their language's threshold, with the columns of ``docs``, whatever they are called."""
    rows, cols, names = _numbered(docs)
    labels = table(spark, sf_dir, "labels")
    model = toxicity_cnn.fit(rows, labels, **cols)
    scored = stored(toxicity_cnn.scored(rows, model, cols["text_col"]), "scored")
    judged = toxicity_cnn.rejecting(scored, toxicity_cnn.calibrated(scored, labels, model, **cols), cols["lang_col"])
    return judged.where("not rejected").select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word that pass the base rules and the trees, with the columns of ``docs``, whatever they are called.

    How few words are too few is left to the trees: short documents that the labels call good stay.
    """
    rows, cols, names = _numbered(docs)
    forest = quality_gbt.fit(rows, table(spark, sf_dir, "labels"), id_col=cols["id_col"], text_col=cols["text_col"])
    return quality_gbt.judged(rows, forest, cols["text_col"], min_words=1).where("kept").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates (five-word shingles, similarity 0.8 or more), with the columns of ``docs``.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    rows, cols, names = _numbered(docs)
    own = cols["id_col"]
    classes = simhash_similar.near_duplicates(rows, own, cols["text_col"])
    gone = stored(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    maybe, surely = parted(rows, own, bitmap(gone, gone.count()))  # only what may go is shuffled
    stay = maybe.join(gone, F.col(own) == F.col("doc_id"), "left_anti")
    return surely.unionByName(stay).select(*names).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with the tokens' checksum."""
    rows, cols, _ = _numbered(docs)
    pieces = packing.pack(rows, cols["id_col"], cols["text_col"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packed)]
#: No stage's decisions can be expressed in SQL: two are learnt, one hashes with XXH64, one tokenises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
