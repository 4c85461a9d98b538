"""File sources and sinks: explicit schemas, corrupt rows kept apart, versions by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, document_id string, source_group string, source_label string, filename string, location_type string, location string, text string"
ARTICLES = "source_key string, article_no string, effective_date date, content string, content_hash string"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk corpus of JSON lines; blank lines are skipped, an empty corpus raises."""
    df = spark.read.schema(CHUNKS).json(path).where(F.col("chunk_id").isNotNull())
    if df.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return df


def read_records(spark: SparkSession, path: str, schema: str, required: list[str], pattern: str = "*.json", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) of a folder of JSON documents, one to a file or, with ``lines``, to a line; a row without a required field or with bad syntax is quarantined."""
    wide = f"{schema}, _corrupt string"
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).option("multiLine", str(not lines).lower()).json(path)
    df = df.withColumn("_file", F.col("_metadata.file_name"))
    bad = F.col("_corrupt").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return df.where(~bad).drop("_corrupt"), df.where(bad).select("_file", F.coalesce("_corrupt", F.lit("missing required field")).alias("reason"))


def resolve_source(spark: SparkSession, options: list[tuple[str, str]], explicit: str | None = None) -> tuple[str, DataFrame]:
    """The first readable (label, path) of a chain of Parquet backends; an explicit label must be there."""
    from pyspark.errors import AnalysisException

    for label, path in options:
        if explicit and label != explicit:
            continue
        try:
            return label, spark.read.parquet(path)
        except AnalysisException:
            if explicit:
                raise
    raise FileNotFoundError("no backend can be read: " + ", ".join(x for x, _ in options))


def filled(df: DataFrame) -> DataFrame:
    """Missing document id, file name and schema version filled in from the file."""
    name = F.coalesce("filename", F.concat(F.regexp_replace("_file", r"\.[^.]+$", ""), F.lit(".pdf")))
    return df.withColumn("filename", name).withColumn("document_id", F.coalesce("document_id", F.regexp_replace("filename", r"\.[^.]+$", ""))).withColumn("schema_version", F.coalesce("schema_version", F.lit("0.1")))


def write_csv(df: DataFrame, path: str) -> None:
    """Lists joined by ``|``, structs and maps as JSON, one header."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.concat_ws("|", F.transform(c, lambda x: x.cast("string"))) if kind == "array" else F.to_json(c) if kind in ("struct", "map") else c).alias(f.name))
    df.select(*out).write.mode("overwrite").option("header", "true").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` holds, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A relational store; Spark pushes columns and filters down. The driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def source_version(df: DataFrame) -> str:
    """A digest of a source's content that does not depend on row order: two sums of row hashes and the count."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    n, a, b = df.agg(F.count("*"), F.sum(h), F.sum(F.hash(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{a}:{b}"
