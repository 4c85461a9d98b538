"""WARC archives with revisit records, read back by boundary-chain verification.

Writing: a payload's SHA-256 decides which of the equal payloads is the response (the smallest page id) and which are
revisits. Only pages whose id falls on a marked place of a bitmap of bounded size can be revisits; the others are written
without a shuffle. Records go out through Spark's own committed text writer, whose line separator is the empty line that
ends a WARC record, so a lost executor costs its unfinished file alone. Records are written by size class, so that files are bounded
in bytes and not only in records.

Reading: a task scans a file for the record magic and emits a candidate for each place, with the offset of its
successor by the declared length. Payloads may hold the magic too. Starting from offset zero, pointer jumping doubles the
distance of every candidate's pointer each round and keeps what is reachable; everything else is no record. The file's
end is a candidate too: a chain that does not reach it is damage.
"""

from __future__ import annotations

import re
import uuid
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bitmap, parted, shared_dir, stored

LEAST = 100
#: (bytes of payload and address below which a record is of the class, records in a file): 128 MB a file, or one record.
CLASSES = ((1 << 15, 4000), (1 << 20, 128), (1 << 62, 1))
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
CANDIDATES = (
    "path string, start long, next long, kind string, page_id long, refers_to long, declared string, payload_bytes long, payload_digest string"
)


def duplicates(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """``page_id, digest, refers_to`` of every page that revisits another one: equal payload of at least ``least`` bytes, smaller id first."""
    data = F.encode(F.coalesce(payload_col, F.lit("")), "utf-8")
    digests = pages.select(F.col(id_col).alias("page_id"), data.alias("data")).where(F.octet_length("data") >= least)
    digests = stored(digests.select("page_id", F.unhex(F.sha2("data", 256)).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, "firsts")  # read back, so that a join with a digest that many pages share can be split
    return digests.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """One record for each page into files under ``path``, a folder for each size class. Null payloads and addresses are empty.

    Rows that repeat a page id are written each for itself; an equal payload under the same id is no revisit. Other columns are not read. An
    empty table gives files without records. A header is as long as its address.
    """
    revisits = stored(duplicates(pages, id_col, payload_col, least), "revisits")
    marks = stored(bitmap(revisits.select("page_id"), revisits.count()), "marks")
    page = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.regexp_replace(uri_col, r"\s", "%20"), F.lit("")).alias("uri"), F.coalesce(payload_col, F.lit("")).alias("payload")
    )
    size, low = F.octet_length("payload") + F.octet_length("uri"), 0
    for k, (high, records) in enumerate(CLASSES):
        own = page.where((size >= low) & (size < high)).withColumn("digest", F.unhex(F.sha2(F.encode("payload", "utf-8"), 256)))
        maybe, alone = parted(own, "page_id", marks)
        alone = alone.withColumn("refers_to", F.lit(None).cast("long"))
        rows = alone.unionByName(maybe.join(revisits, ["page_id", "digest"], "left").select(*alone.columns))
        rows.select(_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(f"{path}/class-{k}")
        low = high


def _record() -> F.Column:
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    common = F.format_string(
        "WARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: %s\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d",
        "page_id", "uri", F.lower(F.hex("digest")), F.octet_length(body),
    )
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(
        F.format_string("revisit\r\nWARC-Profile: identical-payload-digest\r\nWARC-Refers-To: <urn:page:%d>", "refers_to")
    )
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), common, F.lit("\r\n\r\n"), body)


def scan(content: bytes, file: str):
    """Candidates of one file: every magic that a whole header with a length follows, and the file's end (``next`` -1).

    A header is as long as it is. Magics before the same header end share its lines, so each byte is split once.
    """
    yield file, len(content), -1, None, None, None, None, None, None
    group, stop = [], -1
    for m in MAGIC.finditer(content):
        if m.end() > stop:
            yield from _headed(content, file, group, stop)
            group, stop = [], content.find(b"\r\n\r\n", m.end())
            if stop < 0:
                return
        group.append((m.start(), m.end()))
    yield from _headed(content, file, group, stop)


def _page(value: str | None) -> int | None:
    """The page id of a record's URN; null if it is none or no 64-bit number."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", value or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _headed(content: bytes, file: str, group: list[tuple[int, int]], stop: int):
    """The candidates of the magics ``group``, whose headers all end at ``stop``."""
    head, upto, digests = {}, stop, {}
    for start, at in reversed(group):  # a header's first line of a name counts, so earlier lines win
        lines = content[at:upto].split(b"\r\n")
        for name, _, value in (line.partition(b":") for line in reversed(lines)):
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        upto = at
        length = head.get(b"content-length", "")
        if not length.isdigit() or len(length) > 15:
            continue
        begin, n = stop + 4, int(length)
        if n not in digests:
            digests = {n: sha256(memoryview(content)[begin : begin + n]).hexdigest()}
        yield (
            file, start, begin + n + 4, head.get(b"warc-type"), _page(head.get(b"warc-record-id")), _page(head.get(b"warc-refers-to")),
            head.get(b"warc-payload-digest", "").removeprefix("sha256:"), n, digests[n],
        )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in CANDIDATES.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(scan(batch.column(1)[i].as_py(), batch.column(0)[i].as_py()))
                for at in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + (1 << 14)]), types)], names)

    # joins carry a number for the file: paths compress so well that a side of a join looks far smaller than it is
    return stored(files.mapInArrow(run, CANDIDATES).withColumn("file", F.xxhash64("path")), "candidates")


def reachable(pointers: DataFrame) -> DataFrame:
    """``file``, ``start`` of the candidates on the chain from each file's start. ``pointers``: ``file, start, next``.

    Round by round the pointers' reach doubles, so a chain of n records takes log n rounds.
    """
    hops = stored(pointers.join(pointers.select("file", F.col("start").alias("next")), ["file", "next"]).select("file", "start", "next"), "hops")
    seen = stored(pointers.where("start = 0").select("file", "start"), "seen")
    while not hops.isEmpty():
        reached = hops.join(seen, ["file", "start"]).select("file", F.col("next").alias("start"))
        seen = stored(seen.unionByName(reached).distinct(), "seen")
        onward = hops.select("file", F.col("start").alias("next"), F.col("next").alias("then"))
        hops = stored(hops.join(onward, ["file", "next"]).select("file", "start", F.col("then").alias("next")), "hops")
    return seen


def read_archives(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """The records under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's size is that of the response that it names. An empty folder gives no rows. Raises if a payload
    differs from its record's digest, if a file's chain does not reach the file's end, if there are not as many records as ``expected``, or if a
    revisit's response is missing. A file is read whole, so its size is bounded by a task's memory and by 2 GB; the writer keeps to 128 MB or one record.
    """
    found = candidates(spark, path)
    seen = reachable(found.select("file", "start", "next"))
    broken = found.where("next = -1").join(seen, ["file", "start"], "left_anti").select("path", "start").first()
    if broken:
        raise ValueError(f"the records of {broken.path} do not reach its end at {broken.start}")
    records = found.where("next <> -1").join(seen, ["file", "start"])
    sound = F.when(F.col("kind") == "revisit", F.col("declared")).when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest"))
    sound = F.coalesce(sound, F.raise_error(F.format_string("payload of %s at %d differs from its digest", "path", "start")).cast("string"))
    rows = stored(records.select("page_id", "payload_bytes", sound.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"), "records")
    if expected is not None and rows.count() != expected:
        raise ValueError(f"{path} holds {rows.count()} records; {expected} were written")
    sizes = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).distinct()
    back = rows.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    size = F.coalesce("size", F.raise_error(F.format_string("page %d revisits %d, whose response is missing", "page_id", "refers_to")).cast("long"))
    back = back.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return rows.where("record_type = 'response'").unionByName(back)


def op8_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/factloom-warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    write_archives(pages, path)
    return read_archives(spark, path, pages.count())


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
