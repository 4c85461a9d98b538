"""Sources, sinks and streams: round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.queries.base import query
from factloom.sources import files
from factloom.sources.shared import shared_path
from factloom.streaming import sessions as S

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("SELECT 'c' || doc_id AS chunk_id, source AS source_group, length(text) AS n FROM documents", session=True)
def s01_jsonl_corpus(t, spark, sf_dir):
    """S-01, S-16: a chunk corpus written as JSON lines and scanned with its schema."""
    path = shared_path(spark, "chunks")
    d = t("documents")
    d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_group"), "text").write.json(path)
    return files.read_chunks(spark, path).select("chunk_id", "source_group", F.length("text").cast("long").alias("n"))


@query(
    """SELECT CASE WHEN event_id % 7 = 0 THEN 'quarantine' ELSE 'good' END AS store, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN user_id END) AS BIGINT) AS users FROM events GROUP BY ALL""",
    session=True,
)
def s02_quarantine(t, spark, sf_dir):
    """S-02, S-03: broken and incomplete records are set apart and counted, never fatal."""
    path = shared_path(spark, "records")
    e = F.col("event_id")
    line = F.when(e % 14 == 0, F.lit("{broken")).when(e % 7 == 0, F.to_json(F.struct("user_id"))).otherwise(F.to_json(F.struct("event_id", "user_id")))
    t("events").select(line.alias("value")).write.text(path)
    good, bad = files.read_records(spark, path, "event_id long, user_id long", ["event_id"], "*.txt", lines=True)
    one = good.agg(F.count("*").alias("n"), F.sum("user_id").alias("users")).select(F.lit("good").alias("store"), "n", "users")
    return one.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("store"), "n", F.lit(None).cast("long").alias("users")))


@query(
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'd' || event_id END, 'e' || user_id) AS document_id, CASE WHEN event_id % 2 = 0 THEN 'f' || event_id || '.pdf' ELSE 'e' || user_id || '.pdf' END AS filename, '0.1' AS schema_version FROM events"""
)
def s06_filled(t):
    """S-06: missing identity fields come from the file."""
    e = F.col("event_id")
    raw = t("events").select(
        "event_id", F.when(e % 3 != 0, F.concat(F.lit("d"), e.cast("string"))).alias("document_id"), F.when(e % 2 == 0, F.concat(F.lit("f"), e.cast("string"), F.lit(".pdf"))).alias("filename"),
        F.lit(None).cast("string").alias("schema_version"), F.concat(F.lit("e"), F.col("user_id").cast("string"), F.lit(".json")).alias("_file"),
    )
    out = files.filled(raw)
    return out.select("event_id", F.when(e % 3 != 0, F.col("document_id")).otherwise(F.regexp_replace("_file", r"\.[^.]+$", "")).alias("document_id"), "filename", "schema_version")


@query(
    """SELECT n_regionkey, count(*) AS n, CAST(max(CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END) AS INTEGER) AS version FROM nation GROUP BY ALL""", session=True
)
def s12_partition_overwrite(t, spark, sf_dir):
    """S-12: a document's rows are replaced in one commit; other partitions stay."""
    path = shared_path(spark, "facts")
    base = t("nation").select("n_nationkey", "n_regionkey", F.lit(0).alias("version"))
    files.write_partitioned(base, path, "n_regionkey")
    files.write_partitioned(base.where("n_regionkey = 1").withColumn("version", F.lit(1)), path, "n_regionkey")
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n_events FROM events GROUP BY ALL", session=True)
def d17_streamed_windows(t, spark, sf_dir):
    """Section 2.12: tumbling windows over a stream of files, run to the end of what is there."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return S.run_available(S.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "1 hour"), shared_path(spark, "windows"), "complete").withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("SELECT item_id, length(text) AS n, CAST(item_id % 3 AS INTEGER) AS level FROM benchmark", session=True)
def s17_case_table(t, spark, sf_dir):
    """S-17, S-18: a table of cases with a header; blank rows are dropped, quoted line ends stay."""
    path = shared_path(spark, "cases")
    rows = t("benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text", (F.col("item_id") % 3).cast("string").alias("level"))
    blank = rows.where("item_id % 4 = 0").select(F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("level"))
    files.write_csv(rows.unionByName(blank), path)
    back = spark.read.schema("item_id long, text string, level int").option("header", "true").option("enforceSchema", "false").option("multiLine", "true").option("escape", "\\").csv(path)
    return back.where(F.col("item_id").isNotNull()).select("item_id", F.length("text").cast("long").alias("n"), "level")
