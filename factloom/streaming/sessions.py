"""Sessions over a stream of events, with a watermark and a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per user and session: start, end, events, sum. A session closes after ``gap`` of silence; rows later than ``late`` are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return out.agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "n_events", "total")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding counts by type."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return out.select(F.col("w.start").alias("started"), "event_type", "n_events")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Take all that is there into a Parquet table and stop; offsets and state lie beside it, so a restart goes on where it ended.

    ``append`` uses the exactly-once file sink; ``complete`` replaces the table with each batch.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
