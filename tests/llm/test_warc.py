import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.llm import warc_store as W
from factloom.llm.common import shared_dir
from tests.llm.helpers import SF

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, **more):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    W.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path, **more)
    return {r.page_id: r for r in W.read_archives(spark, path).collect()}, path


def expect(rows):
    first, out = {}, {}
    for i, _, html in sorted(rows):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        to = first.setdefault(digest, i) if len(data) >= 100 else i
        out[i] = (len(data), digest, "response" if to == i else "revisit", None if to == i else to)
    return out


def same(got, rows):
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == expect(rows)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_edges(spark):
    long = "x" * 100
    rows = [
        (5, "http://a", long), (3, "http://b", long), (9, None, long), (4, "http://c", "x" * 99), (6, "http://d", "x" * 99), (7, "http://e", None), (8, "http://f", ""), (10, "a b\r\nc", FAKE * 3), (11, "u", FAKE * 3),
        (12, "u", "\r\n\r\n" * 40), (13, "u", "é한😀" * 50), (14, "u", "WARC/1.0\r\n" * 20), (15, "u", "y" * 3_000_000), (-2, "u", "z"),
    ]
    got, path = round_trip(spark, rows)
    same(got, rows)
    names = sorted(x.path for x in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect())
    assert names and W.candidates(spark, path).count() > len(rows)  # the magic inside payloads was a candidate


def test_chain_is_followed_over_many_records(spark):
    rows = [(i, f"http://x/{i}", FAKE if i % 3 == 0 else f"page {i} " * 20) for i in range(300)]
    got, _ = round_trip(spark, rows)
    same(got, rows)


def test_whole_table_and_saturated_bitmap(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    same({r.page_id: r for r in W.op8_warc(spark, SF).collect()}, rows)
    monkeypatch.setattr(common, "ROW_BITS", 8)
    monkeypatch.setattr(common, "MOST_ROWS", 1)
    same(round_trip(spark, rows)[0], rows)


def test_bitmap_marks_every_id_and_few_others(spark):
    ids = spark.range(0, 40_000, 7)
    for count in (1, 5715):  # too small a count makes a bitmap that marks more, never less
        maybe, surely = common.parted(spark.range(100_000).withColumn("x", F.lit(1)), "id", common.bitmap(ids, count))
        found = {r.id for r in maybe.collect()}
        assert found >= set(range(0, 40_000, 7)) and len(found) + surely.count() == 100_000
    assert len(found) < 0.25 * 100_000
    assert common.parted(ids, "id", common.bitmap(ids.where("false"), 0))[1].count() == ids.count()
    none = spark.createDataFrame([(None,), (7,)], "id long")
    assert [r.id for r in common.parted(none, "id", common.bitmap(ids, 5715))[0].collect()] == [7]


def test_files_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(W, "CLASSES", ((1000, 40), (10_000, 4), (1 << 62, 1)))
    rows = [(i, "u" * (30_000 if i == 5 else 3), f"{i % 50} " + "x" * (i * 37 % 20_000)) for i in range(300)]
    got, path = round_trip(spark, rows)
    same(got, rows)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert len(sizes) > 60 and max(sizes) < 40 * 1400


def test_a_lost_file_is_found(spark):
    rows = [(i, "u", f"page {i}") for i in range(30)]
    _, path = round_trip(spark, rows)
    with pytest.raises(ValueError, match="31 were written"):
        W.read_archives(spark, path, 31)


def test_damage_is_found(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good)
    with pytest.raises(Exception, match="differs from its digest"):
        W.read_archives(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    W.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert W.read_archives(spark, path).count() == 0


def test_repeated_and_null_ids(spark):
    long, other = "l" * 120, "o" * 130
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (2, "u", other), (3, "u", other), (None, "u", "n")]
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    W.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in W.read_archives(spark, path).collect())
    assert got == [(0, "response", 0, 1), (1, "response", 0, 120), (1, "response", 0, 120), (2, "response", 0, 130), (2, "revisit", 1, 120), (2, "revisit", 1, 120), (3, "revisit", 2, 130)]


def test_long_headers_and_ids_of_19_digits(spark):
    big, long = (1 << 63) - 1, "l" * 150
    rows = [(1, "data:," + "u" * 40_000, "first"), (2, "http://x/WARC/1.1", long), (big - 1, "v" * 20_000, long), (big, "u", long), (-(1 << 63), "u", "least")]
    got, _ = round_trip(spark, rows)
    same(got, rows)


def test_headers_take_linear_time():
    whole = list(W.scan(b"WARC/1.1\r\n" * 100_000 + b"Content-Length: 3\r\n\r\nabc\r\n\r\n", "f"))
    assert len(whole) == 100_001 and len({x[8] for x in whole}) == 2
    assert len(list(W.scan(b"WARC/1.1\r\n" * 100_000, "f"))) == 1


RECORD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(b"abc").hexdigest().encode() + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("content", [RECORD % 1 + b"x" + RECORD % 2, b"x" + RECORD % 1, RECORD % 1 + (RECORD % 2)[:40], b"no record"])
def test_a_broken_chain_is_found(spark, tmp_path, content):
    (tmp_path / "a.warc").write_bytes(content)
    with pytest.raises(ValueError, match="do not reach its end"):
        W.read_archives(spark, str(tmp_path)).collect()


def test_a_revisit_without_its_response_is_found(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes((RECORD % 1).replace(b"response", b"revisit\r\nWARC-Refers-To: <urn:page:7>"))
    with pytest.raises(Exception, match="whose response is missing"):
        W.read_archives(spark, str(tmp_path)).collect()
