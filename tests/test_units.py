"""Hand-checkable cases."""

import datetime
import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import rules, text
from factloom.operators import extraction, temporal
from factloom.operators.selection import suppressed
from factloom.plans import retrieval
from factloom.sources import files
from factloom.streaming.sessions import session_counts, windowed_counts


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_tax_credit_cap(spark):
    lit = lambda x: F.lit(x).cast("decimal(18,6)")
    r = one(spark, rules.effective_rate(lit("0.12"), lit("0.10")), rules.tax_credit(F.lit(15_000_000), F.lit(9_000_000), lit("0.12"), lit("0.10")))
    assert (r[0], r[1]) == (Decimal("0.1320"), Decimal(1_188_000))


@pytest.mark.parametrize(
    "said, want", [("IRP 가입 가능", "ELIGIBLE"), ("IRP 가입 불가", "INELIGIBLE"), ("IRP 전용. 다만 IRP 가입 불가", "UNRESOLVED"), ("퇴직연금", "UNRESOLVED"), (None, "UNRESOLVED")]
)
def test_eligibility(spark, said, want):
    assert one(spark, rules.eligibility(F.lit(None).cast("array<string>"), F.lit(said)))[0] == want


def test_eligibility_conflict_of_code_and_text(spark):
    assert one(spark, rules.eligibility(F.array(F.lit("IRP")), F.lit("IRP 가입 불가")))[0] == "UNRESOLVED"


@pytest.mark.parametrize("answer, evidence, ok", [("50%", "150%", False), ("900만원", "9,000,000원", True), ("50%", "100분의 50", True), ("0.5%", "50%", False), ("1억원", "100,000,000원", True)])
def test_numeric_grounding(spark, answer, evidence, ok):
    assert (len(one(spark, text.unsupported_facts(F.lit(answer), F.lit(evidence)))[0]) == 0) is ok


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("DB형 퇴직연금 A 12.5% 가 나다")))[0] == ["db", "퇴직연금", "a", "12.5", "나다"]
    assert one(spark, text.tokens(F.lit(None).cast("string")))[0] == []


def test_label_beats_grade(spark):
    assert one(spark, rules.risk_bucket(F.lit("[낮은 위험]"), F.lit(1)))[0] == "CONSERVATIVE"
    assert one(spark, rules.risk_bucket(F.lit(None).cast("string"), F.lit(1)))[0] == "VERY_AGGRESSIVE"


def test_as_of_and_conflict(spark):
    day = lambda s: datetime.datetime.strptime(s, "%Y%m%d")
    v = spark.createDataFrame([("a", day("20250101"), "x"), ("a", day("20260101"), "y"), ("a", day("20270101"), "z")], "k string, d timestamp, c string")
    at = F.lit("2026-09-06").cast("timestamp")
    assert temporal.current_without_conflict(v, ["k"], "d", "c", at).collect()[0].c == "y"
    twice = v.unionByName(spark.createDataFrame([("a", day("20260101"), "other")], v.schema))
    assert temporal.current_without_conflict(twice, ["k"], "d", "c", at).count() == 0


def test_as_of_join_keeps_unmatched_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, None, 9), (4, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1, "old"), ("a", 5, 2, "new"), ("a", None, 9, "never")], "k string, rt int, tie int, v string")
    got = {r.id: r.v for r in temporal.as_of_join(left, right, ["k"], "t", "rt", ["v"], "tie").collect()}
    assert got == {1: "new", 2: None, 3: None, 4: None}


def test_suppression_is_sequential(spark):
    rows = [("q", 1, "f", "1", "same text"), ("q", 2, "f", "1", "other text"), ("q", 3, "f", "2", "other text"), ("q", 4, "f", "3", "same text"), ("q", 5, "f", "4", "last")]
    df = spark.createDataFrame(rows, "q string, r int, file string, loc string, text string")
    assert sorted(x.r for x in suppressed(df, "q", "r", ["file", "loc"], "text", 5).collect()) == [1, 3, 5]


def test_variants_and_expansion(spark):
    got = one(spark, retrieval.variants(F.lit("DB와 DC의  차이는 무엇인가요?")))[0]
    assert got[0] == "DB와 DC의 차이는 무엇인가요?" and "확정급여형" in got[1] and "DC 정의 운용 주체 산정 방식 제한" in got and len(got) <= 7
    assert one(spark, retrieval.variants(F.lit("")))[0] == []


def test_char_grams(spark):
    got = one(spark, retrieval.char_grams(F.lit("ab c")))[0]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "dc dc fund"), (2, "irp tax"), (3, "dc tax")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "dc dc")], "query_id string, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, q).collect()}
    idf, mean = math.log(1 + 1.5 / 2.5), 7 / 3
    want = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert got == pytest.approx({1: want(2, 3), 3: want(1, 2)})


def test_retrieve_prefers_the_passage_with_both_accounts(spark):
    rows = [
        ("c1", "DB는 확정급여형, DC는 확정기여형으로 운용 주체가 다릅니다", "docs", "f1", "1"), ("c2", "펀드 수수료 안내", "investment", "f2", "1"), ("c3", "질문 리스트 DB? DC?", "docs", "f3", "1"),
    ]
    chunks = spark.createDataFrame(rows, "doc_id string, text string, source_group string, filename string, location string")
    q = spark.createDataFrame([("q", "DB와 DC 운용 차이")], "query_id string, text string")
    got = sorted(retrieval.retrieve(chunks, q, 3).collect(), key=lambda r: r.place)
    assert got[0].doc_id == "c1"
    assert {r.doc_id for r in retrieval.retrieve(chunks, q, 3, "investment").collect()} <= {"c2"}


def test_packed_chunks_lose_nothing(spark):
    docs = spark.createDataFrame([(1, "a" * 25 + "\n" + "b" * 3 + "\n\n" + "c" * 4), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.seq, r.chunk) for r in extraction.packed_chunks(docs, "doc_id", "text", 10).collect())
    assert all(len(c) <= 10 for _, _, c in got)
    assert "".join(c for _, _, c in got).replace("\n", "") == "a" * 25 + "bbb" + "cccc"


def test_wrapped_rows_are_merged(spark):
    rows = spark.createDataFrame([("t", 1, ["A", "1"]), ("t", 2, ["", "2"]), ("t", 3, ["B", "3"]), ("u", 1, [None, "9"])], "t string, i int, cells array<string>")
    got = sorted((r.t, r.i, r.cells) for r in extraction.merged_rows(rows, "t", "i", "cells").collect())
    assert got == [("t", 1, ["A", "1 2"]), ("t", 3, ["B", "3"]), ("u", 1, [None, "9"])]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "d1", "filename": None}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"filename": "x.pdf"}))
    good, bad = files.read_records(spark, str(tmp_path), "document_id string, filename string, schema_version string", ["document_id"])
    assert [r.document_id for r in good.collect()] == ["d1"] and sorted(r._file for r in bad.collect()) == ["b.json", "c.json"]
    assert files.filled(good).first().filename == "a.pdf"
    (tmp_path / "chunks.jsonl").write_text('{"chunk_id": "c1", "text": "x"}\n\n')
    assert files.read_chunks(spark, str(tmp_path / "chunks.jsonl")).count() == 1
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.read_chunks(spark, str(tmp_path / "none.jsonl"))


def test_sinks_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1}), (2, [], {})], "id int, tags array<string>, m map<string,int>")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.tags or "" for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()) == ["", "a|b"]
    base = spark.range(6).withColumn("p", F.col("id") % 2)
    files.write_partitioned(base, str(tmp_path / "t"), "p")
    files.write_partitioned(base.where("p = 1").limit(1), str(tmp_path / "t"), "p")
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("p").count().orderBy("p").collect()[1]["count"] == 1
    assert files.source_version(base) == files.source_version(base.orderBy(F.desc("id"))) != files.source_version(base.where("id > 0"))
    label, got = files.resolve_source(spark, [("missing", str(tmp_path / "nothing")), ("table", str(tmp_path / "t"))])
    assert label == "table" and got.count() == 4


def test_streaming_sessions(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([(at(0), 1, "a", 1.0), (at(10), 1, "b", 2.0), (at(90), 1, "a", 4.0), (at(300), 2, "a", 8.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, make in (("sess", session_counts), ("wins", windowed_counts)):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.user_id, r.n_events, r.total) for r in spark.table("sess").collect()) == [(1, 1, 4.0), (1, 2, 3.0)]
    assert spark.table("wins").count() > 0


def test_paged_source_retries(spark):
    import http.server
    import threading

    from factloom.sources.paged import PagedSource

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            busy = self.path == "/2" and seen.count("/2") < 3
            self.send_response(503 if busy else 200)
            self.end_headers()
            if not busy:
                self.wfile.write(json.dumps({"items": [{"id": f"a{self.path[1:]}", "text": "t"}]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/{{page}}").option("pages", "3").option("pause", "0.01").load()
    assert sorted(r.id for r in df.collect()) == ["a1", "a2", "a3"]
    assert seen.count("/2") >= 3
    server.shutdown()


def test_tables_are_made_once(spark):
    from factloom.sources.schema import ensure_tables

    names = ensure_tables(spark, "store")
    spark.sql("INSERT INTO store.field_status VALUES ('d', 'p', 'FOUND')")
    assert ensure_tables(spark, "store") == names
    assert spark.table("store.field_status").count() == 1
    spark.sql("DROP DATABASE store CASCADE")


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:facts;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    try:
        base.write.format("jdbc").options(url=url, dbtable="docs", **driver).mode("overwrite").save()
    except Exception as e:  # no relational store on the class path
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no JDBC driver")
        raise
    got = files.read_jdbc(spark, url, "docs", **driver)
    assert [r.name for r in got.where("id = 2").collect()] == ["b"]


def test_upper_median_and_fingerprint(spark):
    from factloom.operators.evaluation import upper_medians
    from factloom.operators.integrity import fingerprint

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("a", 9.0), ("b", None), ("c", 5.0)], "k string, v double")
    assert {r.k: r.m for r in upper_medians(df, ["k"], "v", "m").collect()} == {"a": 3.0, "c": 5.0}
    one, other = fingerprint(df, ["k"], ["v"]), fingerprint(df.orderBy(F.desc("v")).unionAll(df), ["k"], ["v"])
    assert sorted(one.collect()) == sorted(other.collect())
    assert fingerprint(df.where("v <> 9"), ["k"], ["v"]).where("k = 'a'").first() != one.where("k = 'a'").first()


@pytest.mark.parametrize("label", ["C-P2", "C-P2e", "CP2"])
def test_a_class_label_is_no_eligibility(spark, label):
    none = F.lit(None).cast("array<string>")
    assert one(spark, rules.eligibility(none, F.lit(label), types=(F.lit(label),)))[0] == "UNRESOLVED"
    assert one(spark, rules.eligibility(none, F.lit("DC형 전용")))[0] == "INELIGIBLE"
    assert one(spark, rules.eligibility(none, types=(F.lit("개인형 퇴직연금"),)))[0] == "ELIGIBLE"
    assert one(spark, rules.eligibility(none, F.lit("DB형 전용"), types=(F.lit("IRP"),)))[0] == "UNRESOLVED"


@pytest.mark.parametrize("answer, evidence, ok", [("50%", "50원", False), ("09:20", "09:30", False), ("09:20", "9:20 시작", True), ("2026-09-06", "기준일 2026.9.6", True), ("보고서3.pdf", "", True), ("AB-12", "", True), ("1. 보수", "", True)])
def test_moments_files_and_codes(spark, answer, evidence, ok):
    assert (len(one(spark, text.unsupported_facts(F.lit(answer), F.lit(evidence)))[0]) == 0) is ok


def test_routing_of_nulls_and_named_products(spark):
    from factloom.functions import routing as Q

    null = F.lit(None).cast("string")
    assert tuple(one(spark, Q.task_intent(null))) == ("general",) and one(spark, Q.route(null))[0] == "document" and one(spark, Q.law_topic(null))[0] is None
    q = F.lit("알파성장주 벤치마크가 코스피가 맞나요")
    assert one(spark, Q.route(q))[0] == "document" and one(spark, Q.route(q, F.lit(True)))[0] == "product"
    df = spark.createDataFrame([(None,), ("",), ("A b. C!\nD",)], "x string")
    assert [r[0] for r in df.select(Q.slot(F.col("x"), [])).collect()] == [[], [], ["A b. C!\nD"] * 3]
    assert [r[0] for r in df.select(Q.reject_rows(F.lit("실물이전 코드"), F.col("x"))).collect()] == [[], [], []]


def test_marks_of_a_text_found_once(spark):
    """The retrieval searches a text for its marks once; every question gets the same factor as by searching the text anew."""
    texts = [None, "", "질문 리스트 DB? DC?", "왜? 뭐? 어? DB", "DB 확정급여형과 DC 확정기여형의 운용", "①②③④ irp", "plain words"]
    asks = ["DB와 DC 차이", "IRP 세액공제 한도", "plain words", ""]
    df = spark.createDataFrame([(q, t) for q in asks for t in texts], "q string, t string").withColumn("m", retrieval.content_marks(F.col("t")))
    got = df.select(retrieval.content_multiplier(F.col("q"), F.col("t")).alias("a"), retrieval.content_multiplier(F.col("q"), F.col("t"), F.col("m")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len({r.a for r in got}) > 5


def test_packed_chunks_are_streamed(spark):
    docs = spark.createDataFrame([(1, "ab\n" * 1_200_000), (2, None)], "doc_id long, text string")
    out = extraction.packed_chunks(docs, "doc_id", "text")
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # no frame of all chunks of a batch of texts
    got = sorted((r.seq, r.chunk) for r in out.collect())
    assert [s for s, _ in got] == list(range(len(got))) and "\n".join(c for _, c in got) == "\n".join(["ab"] * 1_200_000) and max(len(c) for _, c in got) <= 3500
