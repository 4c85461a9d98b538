"""Order within keys of any size: running numbers and digests of whole sequences.

A key may hold a third of all rows. Rows are therefore cut into ranges of (key, order), which split a large key, and only what is
small is put together for each key: the count of its rows in each range, or the bytes that a digest must see in order.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import stored

#: Bytes of a sequence that travel as one row.
PIECE = 1 << 20


def numbered(rows: DataFrame, key: str, *order: F.Column, name: str = "numbered") -> DataFrame:
    """``rows`` with ``pos`` (long, from 1 within ``key``, by ``order``; null keys are one key), written to the shared folder.

    Rows are sorted in ranges and numbered within their range by a running count; a range's first key may go on from the ranges before, so the
    counts of each range's last key, one row for each range, are summed and broadcast. An empty table gives no rows.
    """
    place = rows.columns.index(key)

    def run(batches):
        last, at = None, 0
        for batch in batches:
            keys, out = batch.column(place).to_pylist(), []
            for k in keys:
                at = at + 1 if at and k == last else 1
                last = k
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "_at"])

    cut = rows.repartitionByRange(F.col(key).asc_nulls_first(), *order).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType())])
    cut = stored(cut.mapInArrow(run, schema).withColumn("_range", F.spark_partition_id()), name)
    none = F.col(key).isNull()
    last = cut.groupBy("_range").agg(F.max(F.struct((~none).alias("some"), F.col(key).alias("k"), "_at")).alias("x")).select("_range", "x.*")
    before = last.select(
        F.lead("_range").over(Window.orderBy("_range")).alias("_next"), F.col("k").alias("_key"),
        F.sum("_at").over(Window.partitionBy("k").orderBy("_range")).alias("_before"),
    )  # one row for each range
    met = cut.join(F.broadcast(before), (cut["_range"] == before["_next"]) & cut[key].eqNullSafe(before["_key"]), "left")
    return met.select(*[cut[c] for c in rows.columns], (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("pos"))


def sequence_digests(rows: DataFrame, keys: list[str], order: str, value: str, separator: bytes) -> DataFrame:
    """``keys, first, n, sha256``: the smallest ``order`` (long), the rows, and the digest of the binary ``value``s joined in ``order``, for each key.

    SHA-256 reads its input in sequence, so a key's bytes do pass through one task, but as pieces of a megabyte and never all in memory: ranges
    of (key, order) join their rows into pieces first. Keys and order must not be null.
    """
    k = len(keys)

    def joined(batches):
        now, start, n, parts, size, out = None, None, 0, [], 0, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, at, data in zip(*columns):
                if key != now or size >= PIECE:
                    if parts:
                        out.append((*now, start, n, separator.join(parts)))
                    now, start, n, parts, size = key, at, 0, [], 0
                parts.append(data)
                n, size = n + 1, size + len(data)
                if len(out) >= 4096 or (out and size >= PIECE):
                    yield _batch(out, pieces)
                    out = []
        if parts:
            out.append((*now, start, n, separator.join(parts)))
        yield _batch(out, pieces)

    def chained(batches):
        now, first, n, digest, out = None, None, 0, None, []
        for batch in batches:
            for *key, at, count, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if digest:
                        out.append((*now, first, n, digest.hexdigest()))
                    now, first, n, digest = key, at, 0, sha256()
                else:
                    digest.update(separator)
                digest.update(data)
                n += count
            yield _batch(out, result)
            out = []
        if digest:
            out.append((*now, first, n, digest.hexdigest()))
        yield _batch(out, result)

    fields = [rows.schema[c] for c in keys]
    pieces = T.StructType([*fields, T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
    result = T.StructType([*fields, T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())])
    cut = rows.select(*keys, F.col(order).alias("_order"), F.col(value).alias("_value")).repartitionByRange(*keys, "_order").sortWithinPartitions(*keys, "_order")
    met = cut.mapInArrow(joined, pieces).repartition(*keys).sortWithinPartitions(*keys, "first")
    return met.mapInArrow(chained, result)


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(arrow), arrow.types)], schema=arrow)
