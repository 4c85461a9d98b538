"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process (tests, a
    laptop) a temporary folder is made and set; on a cluster each machine would write to its own disk, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    made = named or spark.sparkContext.getCheckpointDir()
    if not made:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factloom-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *taken: str) -> list[F.Column]:
    """The columns of ``df`` whose names, without regard to case, are not taken."""
    gone = {t.lower() for t in taken}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def appended(frame: DataFrame, run, *more: str) -> DataFrame:
    """``frame`` and the fields ``more`` that ``run`` appends to each Arrow batch. Inside, columns go by place, so names may be of any form."""
    plain = frame.toDF(*(f"_{i}" for i in range(len(frame.columns))))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]
    return plain.mapInArrow(run, ", ".join([*schema, *more])).toDF(*frame.columns, *(m.split()[0] for m in more))


def slices(batches, rows: int = 512):
    """The Arrow ``batches`` in parts of at most ``rows`` rows, so that Python values of few rows live at once; then Arrow's unused memory goes back, as workers outlive a stage."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


#: Bits of one row of a bitmap, and the most rows that a bitmap has (32 MB in all).
ROW_BITS, MOST_ROWS = 1 << 15, 1 << 13


def bitmap(ids: DataFrame, count: int) -> DataFrame:
    """``row, bits``: a set of places that the one column of ``ids`` falls on, about eight for each of ``count`` ids and 2^28 at most.

    Its size is bounded, so it may be broadcast. Of other ids at most one in eight falls on a place that is taken; beyond 2^25
    ids more do, up to all of them: what is marked is then as much as there is, and never too little.
    """
    rows = min(MOST_ROWS, max(1, 1 << max(0, (8 * count - 1).bit_length() - ROW_BITS.bit_length() + 1)))
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(rows * ROW_BITS))
    taken = ids.select(F.floor(place / ROW_BITS).alias("row"), F.pmod(place, F.lit(ROW_BITS)).alias("at"))
    return taken.groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).withColumn("rows", F.lit(rows))


def parted(frame: DataFrame, column: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``frame`` whose ``column`` may be among the ids of the bitmap ``marks``, all others). No shuffle."""
    rows = marks.select("rows").first()
    if rows is None:
        return frame.where("false"), frame
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(rows[0] * ROW_BITS))
    placed = frame.withColumn("_row", F.floor(place / ROW_BITS)).withColumn("_at", F.pmod(place, F.lit(ROW_BITS)))
    met = placed.join(F.broadcast(marks.select(F.col("row").alias("_row"), F.col("bits").alias("_bits"))), "_row", "left")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    taken = F.call_function("shiftright", byte, F.pmod("_at", F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = met.withColumn("_taken", F.coalesce(taken & F.col(column).isNotNull(), F.lit(False)))
    return met.where("_taken").select(*frame.columns), met.where("not _taken").select(*frame.columns)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: columns ``u``, ``v`` (long). Returns ``node``, ``component`` (the smallest node that is
    reachable), one row for each node that has an edge to another. Every step contracts edges towards the
    smallest neighbour, so a long chain needs a logarithmic number of rounds. Each round is written to the shared
    folder, and so are the minima that edges are joined with: joins of two written tables can be split where one node has most of the
    edges. Edges with a null end and loops are dropped.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct(), "edges")
        # settled: every node has one edge, to a node that has none to a smaller one
        state = e.select("u").unionByName(e.select(F.col("v").alias("u")).distinct()).groupBy("u").count().where("count > 1")
        if state.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError("connected components did not settle")
