"""Near-duplicates at a given shingle similarity: wide SimHash fingerprints, multi-index hashing, verified similarity.

``simhash_dedup`` links fingerprints of 64 bits within 4 bits, which finds texts that hardly differ. Texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 differ in about 15 % of the bits, so this operator takes fingerprints of 128 bits over
shingle sets, cuts them into segments and enumerates the Hamming ball around each segment's value. Two texts of similarity 0.8 meet in
some segment with a probability of 0.93, of 0.85 with 0.97, of 0.9 with 0.99. What meets and is within ``RADIUS`` bits in
all is a candidate (two and a half standard deviations beyond the mean at 0.8), and the shingle sets of candidates decide.

Segment values that more than ``DENSE`` fingerprints share, and more than four times as many as by chance, are not joined with themselves. All that hold such a value are
compared with ``LEADERS`` leaders. After that, members whose class differs from that of most in the bucket look for one similar
text of that main class (a semi join, so each gives one row at most), and what is left of them meets each other. So a group of any size gives rows in
proportion to its members, and no link that would join two classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bitmap, connected_components, parted, slices, stored
from factloom.llm.simhash_dedup import ball, constants, majority, shingle_hashes, tagged

SHINGLE, SIMILARITY, RADIUS, DENSE, LEADERS = 5, 0.8, 30, 8, 2
#: (lane, first bit, width, probe radius) of the segments, the same for any number of documents.
PLAN = [(k, b, 16, 1) for k in (0, 1) for b in (0, 16, 32, 48)]
#: So many distinct fingerprints meet in the session's number of tasks; more meet in more tasks. This deals out work and decides nothing.
FEW = 1 << 22


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending; none for a text without words."""
    return np.unique(shingle_hashes(text, shingle))


def wide(text: str | None, shingle: int = SHINGLE) -> tuple[int, int]:
    """Two signed 64-bit lanes: majorities over the text's shingle set, of the hashes and of the hashes mixed anew."""
    h = shingle_set(text, shingle)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    lanes = np.array([majority(h), majority(mixed ^ (mixed >> np.uint64(32)))], "<u8")
    return tuple(lanes.view("<i8").tolist())


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            lanes = [wide(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in lanes], pa.int64()) for k in (0, 1))], ["doc_id", "f0", "f1"])

    return docs.mapInArrow(run, "doc_id long, f0 long, f1 long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, 256):
            sets = [shingle_set(x.as_py(), shingle).view("<i8") for x in part.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate(sets) if sets else [], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _keys(fps: DataFrame, plan, probe: bool) -> DataFrame:
    """A row for each segment value of a fingerprint; ``probe``: for each value of the ball around it.

    Of two values that differ in an odd number of bits one has even parity; that one alone probes at odd distances, which halves the probes.
    """
    arrays = []
    for k, (lane, first, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned(f"f{lane}", first).bitwiseAND(F.lit((1 << width) - 1))
        around = ball(width, radius) if probe else [0]
        even = tagged(constants([m for m in around if m.bit_count() % 2 == 0]), value, len(plan), k)
        odd = [m for m in around if m.bit_count() % 2]
        arrays.append(even)
        if odd:
            arrays.append(F.when(F.bit_count(value) % 2 == 0, tagged(constants(odd), value, len(plan), k)).otherwise(F.array().cast("array<bigint>")))
    return fps.select(F.explode(F.concat(*arrays)).alias("key"), *fps.columns)


def _distance(a: str, b: str) -> F.Column:
    return sum((F.bit_count(F.col(f"{a}f{k}").bitwiseXOR(F.col(f"{b}f{k}"))) for k in (0, 1)), F.lit(0))


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "d").distinct()


def candidates(fps: DataFrame, plan, dense: int = DENSE, times: int = 1) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(pairs ``u``, ``v`` to verify, with their distance ``d``; the dense segment values, if any; the probes). ``fps``: distinct ``f0, f1`` with their ``rep``. ``times``: how many times the session's tasks share the join."""
    index, probes = _keys(fps, plan, probe=False), _keys(fps, plan, probe=True)
    leader = [F.min_by(F.struct("f0", "f1", "rep"), F.xxhash64("rep", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    heavy = stored(index.groupBy("key").agg(F.count("*").alias("n"), *leader).where(F.col("n") > dense), "dense")
    crowded = not heavy.isEmpty()
    thin = index.join(heavy.select("key"), "key", "left_anti")
    parts = times * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x if times == 1 else x.repartition(parts, "key") for x in (probes, thin))
    a, b = a.alias("a"), b.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") != F.col("b.rep")) & (_distance("a.", "b.") <= RADIUS)
    # the planner does not see how many rows explode() makes, so it must not take the probes for a small side
    found = a.hint("merge").join(b, meets).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), _distance("a.", "b.").alias("d"))
    if crowded:  # members meet their bucket's leaders; what only probes it is looked after in _crowds()
        led = heavy.select("key", F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS))))).alias("l")).select("key", F.col("l.f0").alias("l_f0"), F.col("l.f1").alias("l_f1"), F.col("l.rep").alias("b"))
        found = found.unionByName(index.join(led, "key").where(_distance("", "l_") <= RADIUS).select(F.col("rep").alias("a"), "b", _distance("", "l_").alias("d")))
    return _pairs(found), heavy if crowded else None, probes


def shingled(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, shingles`` of the texts of ``ids`` (one column, distinct). ``docs``: ``doc_id, text``; only their texts are hashed again, and no text is shuffled."""
    ends = stored(ids.toDF("doc_id"), "ends")
    maybe, _ = parted(docs, "doc_id", bitmap(ends, ends.count()))
    return stored(_sets(maybe, shingle).join(ends, "doc_id").groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "sets")


def _alike(x: str, y: str, similarity: float) -> F.Column:
    common = F.size(F.array_intersect(x, y))
    return common >= similarity * (F.size(x) + F.size(y) - common)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose shingle sets have at least the similarity."""
    sets = shingled(pairs.select("u").union(pairs.select("v")).distinct(), docs, shingle)
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y")), "v")
    return both.where(_alike("x", "y", similarity)).select("u", "v")


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.drop("class").join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))


def _met(strays: DataFrame, mains: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``u, v``: the class of each stray that is similar to a member of its bucket's main class, and that class. A stray gives one row, however many it meets."""
    meets = (F.col("a.key") == F.col("b.key")) & (_distance("a.", "b.") <= RADIUS)
    some = stored(strays.alias("a").join(mains.alias("b"), meets, "left_semi"), "strays")  # cheap: no shingles yet
    own = stored(mains.join(some.select("key").distinct(), "key", "left_semi"), "mains")
    sets = shingled(some.select("rep").unionByName(own.select("rep")).distinct(), docs, shingle).withColumnRenamed("doc_id", "rep")
    a, b = (stored(x.join(sets, "rep"), "shingled").alias(n) for x, n in ((some, "a"), (own, "b")))
    found = a.join(b, meets & _alike("a.shingles", "b.shingles", similarity), "left_semi")
    return found.select(F.greatest("class", "main").alias("u"), F.least("class", "main").alias("v")).distinct()


def _classes(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("class"))


def _contracted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, class`` once the classes that ``links`` (``u``, ``v``) name are one."""
    over = stored(connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("whole")), "over")
    named = classes.join(over, "class", "left").select("rep", F.coalesce("whole", "class").alias("class"))
    alone = over.join(classes.select("rep"), F.col("class") == F.col("rep"), "left_anti").select(F.col("class").alias("rep"), F.col("whole").alias("class"))
    return stored(named.unionByName(alone), "classes")


def _crowds(fps: DataFrame, plan, probes: DataFrame, heavy: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``classes`` with the links inside dense buckets. Strays, whose class is not that of most in a bucket, meet the main class first, then each other."""
    keys = heavy.select("key")
    index = stored(_labelled(_keys(fps, plan, probe=False).join(keys, "key"), classes), "members")
    main = stored(index.groupBy("key", "class").count().groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("main")), "main")
    index = stored(index.join(main, "key"), "members")
    probing = stored(_labelled(probes.join(keys, "key"), classes).join(main, "key"), "probing")
    is_main = F.col("class") == F.col("main")
    links = _met(probing.where(~is_main), index.where(is_main), docs, shingle, similarity)
    links = stored(links.unionByName(_met(index.where(~is_main), probing.where(is_main), docs, shingle, similarity)).distinct(), "links")
    classes = _contracted(classes, links)
    whole = stored(_labelled(main.select("key", F.col("main").alias("rep")), classes).select("key", F.col("class").alias("main")), "main")
    rest = lambda rows: _labelled(rows.where(~is_main).drop("main"), classes).join(whole, "key").where(~is_main)
    a, b = stored(rest(probing), "strays").alias("a"), stored(rest(index), "strays").alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.class") != F.col("b.class")) & (_distance("a.", "b.") <= RADIUS)
    pairs = stored(_pairs(a.join(b, meets).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), _distance("a.", "b.").alias("d"))), "pairs")
    if pairs.isEmpty():
        return classes
    held = verified(pairs, docs, shingle, similarity)
    named = lambda end: classes.select(F.col("rep").alias(end), F.col("class").alias(f"class_{end}"))
    held = held.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("class_u", "u").alias("u"), F.coalesce("class_v", "v").alias("v"))
    return _contracted(classes, held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, dense: int = DENSE) -> DataFrame:
    """``doc_id``, ``component_id``: the smallest document id reachable over links of at least ``similarity``, itself included.

    A row for each row of ``docs``. Null and empty texts are one class. A text of fewer words than a shingle has is one shingle. Rows
    that repeat a document id come back as often as they stand there; if their texts differ, the id's links are those of the text with the smallest shingle set.
    Rows without an id are in the class of their text. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = stored(_fingerprints(docs, shingle), "wide")
    fps = stored(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")), "distinct")
    n, plan = fps.count(), PLAN
    dense = max(dense, 4 * n >> min(width for _, _, width, _ in plan))
    parts = max(1, -(-n // max(1, FEW)))
    pairs, heavy, probes = candidates(fps.where("rep is not null"), plan, dense, min(64, parts * parts))
    links = verified(stored(pairs, "pairs"), docs, shingle, similarity)
    classes = stored(_classes(links), "classes")
    if heavy is not None:
        classes = _crowds(fps.where("rep is not null"), plan, probes, heavy, classes, docs, shingle, similarity)
    named = fps.join(classes, "rep", "left").select("f0", "f1", F.coalesce("class", "rep").alias("component_id"))
    return prints.join(stored(named, "classes"), ["f0", "f1"]).select("doc_id", "component_id")
