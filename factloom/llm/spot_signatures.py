"""Document fingerprints from spot signatures.

A common word (an anchor) and the chain of the next ``CHAIN`` words that are not common form a spot signature. Such chains lie in the running text and hardly in
menus, tables or lists. The set of a text's signatures, as sorted 64-bit numbers, is its fingerprint; its digest names it. A text without a
signature (too short, or without anchors) has one signature of all its words, so that different short texts differ.

Similar sets have similar lengths. Lengths are cut into partitions such that sets of similarity ``t`` lie in the same or in neighbouring partitions, sets meet by
equality on (partition, signature) for the few smallest signatures that similar sets must share, and the comparison of two sorted sets stops
where ``t`` is out of reach.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table

CHAIN, SIMILAR = 2, 0.8
WORD = re.compile(r"[^\W_]+")
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """a an and are as at be by for from has in is it of on or that the this to was were which with you
    au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une
    als auf das dem den der die ein eine im ist mit nicht sich sie sind und von zu
    al como con del el es los las lo más no para por se su una y""".split()
)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(1 << 16)
def _number(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def signatures(text: str, anchors: frozenset = ANCHORS, length: int = CHAIN) -> np.ndarray:
    """The sorted distinct signatures of a whole text. There is always one at least."""
    words = WORD.findall(text.lower())
    common = np.fromiter((w in anchors for w in words), bool, len(words))
    numbers = np.fromiter(map(_number, words), np.uint64, len(words))
    follows = np.cumsum(~common)  # of an anchor: the place of the next word that is not common
    content, at = numbers[~common], np.flatnonzero(common)
    at = at[follows[at] + length <= len(content)]
    if not len(at):
        return np.array([_number("\x00".join(["", *words]))], np.uint64)
    code, start = _mixed(numbers[at]), follows[at]
    for k in range(length):
        code = _mixed(code * M2 + content[start + k])
    return np.unique(code)


def digest(spots: np.ndarray) -> str:
    return blake2b(spots.astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0 where it is below ``least``.

    Below ``least`` most pairs end before all is compared: by their lengths, or as soon as those that are left can't reach the overlap that ``least`` needs.
    """
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    met, done_a, done_b, step = 0, 0, 0, max(64, int(min(len(a), len(b)) * (1 - least)))
    while done_a < len(a) and done_b < len(b):
        if met + min(len(a) - done_a, len(b) - done_b) < need:
            return 0.0
        x, y = a[done_a : done_a + step], b[done_b : done_b + step]
        top = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
        met += len(np.intersect1d(x, y, assume_unique=True))
        done_a, done_b = done_a + len(x), done_b + len(y)
    share = met / (len(a) + len(b) - met)
    return share if share >= least else 0.0


def partition(length: Column, threshold: float = SIMILAR) -> Column:
    """The number of a set's length partition: sets whose lengths differ by a factor of ``threshold`` at most are in the same or in neighbouring partitions."""
    return F.floor(F.log(length.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, spots`` (sorted 64-bit signatures, binary, little endian) of every row; a null text is empty. Other columns are not read."""

    def run(batches):
        for batch in batches:
            sets = [signatures(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(s) for s in sets]), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["doc_id", "fingerprint", "spots"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, spots binary")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The next document is the one behind in the order of (id, text), nulls first; behind the last comes the first. The edited text ends half way through
    (``n_chars - n_chars // 2`` code points stay) and goes on with as much of the beginning of the next text, or all of it. A null text is empty. A single document
    is its own next. Repeated rows are documents of their own. Other columns are not read. An empty table gives no rows.

    Documents are dealt by ranges of ids, whose bounds are quantiles of all ids. A range's first document also goes to the range before it, which is one text
    for each range. A task holds two neighbours at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))[: n - 1]
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(_behind(cut, F.col("doc_id")))
    dealt = rows.withColumn("range", place)
    firsts = [r for r in dealt.groupBy("range").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("range").collect()]  # one row for each range
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = [firsts[i - 1]["range"] for i in range(len(firsts))]
    guests = spark.createDataFrame([(None if f["none"] else f["least"], f["range"], b, i == 0) for i, (f, b) in enumerate(zip(firsts, before))], "least long, range int, before int, wraps boolean")
    met = dealt.join(F.broadcast(guests), (dealt["range"] == guests["range"]) & dealt["doc_id"].eqNullSafe(guests["least"]))
    guest = met.groupBy(guests["before"].alias("range"), "wraps").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).withColumn("guest", F.lit(True))
    own = dealt.select("range", F.lit(False).alias("wraps"), "doc_id", "text", F.lit(False).alias("guest"))
    # behind a range's own rows comes its guest, or, behind the last range's, the first document of all
    both = own.unionByName(guest).repartition(len(firsts), "range")
    both = both.sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return both.select("range", "guest", "doc_id", "text").mapInArrow(_compared, RESULT)


def _behind(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are below or at ``value``."""
    return F.size(F.filter(cuts, lambda c: c <= value))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches):
    """Rows by range and order, each range's guest last: every row that is no guest, compared with the row behind it."""
    row, spots, out = None, None, []
    for batch in batches:
        for where, guest, doc, text in chain(zip(*(c.to_pylist() for c in batch.columns))):
            mine = signatures(text)
            if row and row[0] == where:
                before = row[2]
                cut = len(before) // 2
                edited = before[: len(before) - cut] + text[:cut]
                changed = signatures(edited)
                out.append((row[1], len(before), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(spots), digest(changed), likeness(spots, changed), likeness(spots, mine)))
            row, spots = None if guest else (where, doc, text), mine
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
            out = []


NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def similar(prints: DataFrame, threshold: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(``fingerprint, similar, likeness``: the pairs of different fingerprints of ``threshold`` or more, the smaller digest first; ``doc_id, fingerprint``: who has which).

    Equal sets are one fingerprint, however many documents have it. A set of ``n`` signatures is filed under its ``n - ceil(threshold * n) + 1`` rarest ones (fewest sets,
    then smallest number), in its own length partition, and looks there and in the one below; two sets of that similarity share one of them. Frequent signatures are so
    left to sets that have nothing else.
    """
    members = prints.select("doc_id", "fingerprint")
    sets = stored(prints.groupBy("fingerprint").agg(F.any_value("spots").alias("spots")), "sets")

    def spread(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(data, "<i8")
                for k in range(0, len(found), 1 << 16):
                    part = found[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array([len(found)] * len(part), pa.int64())], ["fingerprint", "spot", "n"])

    each = stored(sets.mapInArrow(spread, "fingerprint string, spot long, n long"), "spots")
    rare = stored(each.groupBy("spot").agg(F.count("*").alias("in")).where("in > 1"), "rare")  # what one set has meets nobody, but counts for the order
    ranked = each.join(rare, "spot", "left").groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("in", F.lit(1)).alias("in"), "spot"))).alias("by"))
    filed = ranked.select("fingerprint", "n", F.explode(F.slice("by", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))).alias("x"))
    filed = stored(filed.where("x.in > 1").select("fingerprint", "n", F.col("x.spot").alias("spot"), partition(F.col("n"), threshold).alias("part")), "filed")
    looks = filed.select(F.col("fingerprint").alias("other"), F.col("n").alias("m"), "spot", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    pairs = filed.join(looks, ["spot", "part"]).where((F.col("fingerprint") != F.col("other")) & (F.col("m") * threshold <= F.col("n") + 1e-9) & (F.col("n") * threshold <= F.col("m") + 1e-9))
    pairs = stored(pairs.select(F.least("fingerprint", "other").alias("fingerprint"), F.greatest("fingerprint", "other").alias("similar")).distinct(), "pairs")

    def verified(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            share = [likeness(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), threshold) for p, q in zip(x, y)]
            keep = pa.array([s > 0 for s in share])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(share, pa.float64())], ["fingerprint", "similar", "likeness"]).filter(keep)

    met = pairs.join(sets, "fingerprint").join(sets.select(F.col("fingerprint").alias("similar"), F.col("spots").alias("other")), "similar")
    return met.select("fingerprint", "similar", "spots", "other").mapInArrow(verified, "fingerprint string, similar string, likeness double"), members


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
