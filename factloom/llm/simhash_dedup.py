"""SimHash near-duplicate classes by multi-index hashing.

A text's fingerprint is 64 bits. Two fingerprints link if they differ in at most ``RADIUS`` bits. The bits are cut into
segments; by the pigeonhole rule, linked fingerprints are within a small radius of each other in at least one
segment. Every distinct fingerprint is indexed once for each segment and probes the small Hamming ball around its own
value, so a shuffle join on (segment, value) fetches the candidates and the whole distance is verified inside the join.

Copies never meet: only distinct fingerprints enter the index, each with its smallest document id. A segment value that
more than ``dense`` fingerprints share is not joined. All that index or probe such a value enumerate the
points within half the radius instead: two fingerprints link exactly if they share such a point, so a group of any
size costs rows in proportion to its members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import connected_components, stored

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints that one segment value may hold before its members enumerate midpoints.
DENSE = 2048


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, repeats included: lower-cased A-Z, words between ASCII white space.

    Fewer words than a shingle has: the whole sequence is the one shingle. No words (null, empty): none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], "<u8")


def majority(h: np.ndarray) -> int:
    """The unsigned number whose bits are set in over half of ``h``; zero if there is none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text needs no more memory than a block
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; zero for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long), one row for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int, int]]:
    """(first bit, width, probe radius) of each segment; the radii suit ``RADIUS`` by the general pigeonhole rule.

    Linked fingerprints that differ by more than its radius in every segment would differ in at least the sum of
    (radius + 1) bits, which is RADIUS + 1. Wider segments keep buckets small when there are more fingerprints.
    """
    return [(0, 22, 1), (22, 22, 1), (44, 20, 0)] if count <= 1 << 24 else [(0, 34, 2), (34, 30, 1)]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def constants(values) -> F.Column:
    """An array that folds to one literal, however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def tagged(masks: F.Column, value: F.Column, n: int, k: int) -> F.Column:
    return F.transform(masks, lambda m: value.bitwiseXOR(m) * n + k)


def _keys(fps: DataFrame, plan: list[tuple[int, int, int]], probe: bool) -> DataFrame:
    """A row for each segment value of a fingerprint; ``probe``: for each value of the ball around it."""
    arrays = []
    for k, (first, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        masks = constants(ball(width, radius) if probe else [0])
        arrays.append(tagged(masks, value, len(plan), k))
    return fps.select(F.explode(F.concat(*arrays)).alias("key"), "fp", "rep")


def links(fps: DataFrame, count: int, dense: int = DENSE) -> DataFrame:
    """``u``, ``v``: the ``rep`` of every linked pair of distinct fingerprints, or edges that connect the same classes.

    ``fps``: distinct ``fp`` with its ``rep``.
    """
    plan = segments(count)
    index = _keys(fps, plan, probe=False)
    heavy = stored(index.groupBy("key").count().where(F.col("count") > dense).select("key"), "dense")
    probes = _keys(fps, plan, probe=True)
    crowded = not heavy.isEmpty()
    if crowded:
        index = index.join(heavy, "key", "left_anti")
    a, b = probes.alias("a"), index.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    # the planner does not see how many rows explode() makes, so it must not take the probes for a small side
    found = a.hint("merge").join(b, near).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    if not crowded:
        return found
    members = probes.join(heavy, "key", "left_semi").select("fp", "rep").distinct()
    points = members.select(F.explode(constants(map(_signed, ball(BITS, RADIUS // 2)))).alias("m"), "fp", "rep")
    points = points.select(F.col("fp").bitwiseXOR(F.col("m")).alias("point"), "rep")
    hubs = points.groupBy("point").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.unionByName(points.join(hubs, "point").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """``doc_id``, ``fp`` (long), ``component_id``: the smallest document id reachable over links, itself included.

    Every row of ``docs`` comes back once. Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat a document id come back as often as they stand there. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    all_fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    components = connected_components(links(distinct, distinct.count(), dense))
    named = distinct.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    return all_fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
