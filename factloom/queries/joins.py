"""Join queries: provenance, orphans, as-of, intervals, hierarchies, runs compared."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators.integrity import changed, copies_that_differ, fingerprint, membership, orphans
from factloom.operators.temporal import as_of_join, current_without_conflict, valid_at
from factloom.queries.base import query


@query(
    """SELECT o_orderkey, o_custkey, count(l_orderkey) AS n_facts, round(coalesce(sum(l_extendedprice), 0), 2) AS total,
  coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') AS line_numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def j02_facts_per_class(t):
    """J-01, J-02: facts reduced to one ordered row per key before the join, so the join is one to one."""
    facts = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"), F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    out = t("orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(
        "o_orderkey", "o_custkey", F.coalesce("n", F.lit(0)).alias("n_facts"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"),
        F.coalesce(F.concat_ws(",", F.transform("a", lambda x: x.cast("string"))), F.lit("")).alias("line_numbers"),
    )


@query(
    """SELECT event_id, string_agg(c_name, ',' ORDER BY i) AS names FROM (SELECT event_id, i, CASE i WHEN 1 THEN user_id WHEN 2 THEN user_id * 7 ELSE event_id END AS ref FROM events, range(1, 4) r(i))
  JOIN customer ON c_custkey = ref GROUP BY ALL"""
)
def j03_references_resolved(t):
    """J-03, J-07: ids in an array resolved in order; ids without a target are dropped."""
    refs = t("events").select("event_id", F.posexplode(F.array("user_id", F.col("user_id") * 7, "event_id")).alias("i", "ref"))
    found = refs.join(t("customer").select(F.col("c_custkey").alias("ref"), "c_name"), "ref")
    return found.groupBy("event_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("i", "c_name"))), lambda x: x["c_name"])).alias("names"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, c.event_id FROM lineitem JOIN (SELECT user_id, event_id, event_id % 7 + 1 AS line FROM events WHERE event_type = 'purchase') c
  ON l_suppkey = c.user_id AND l_linenumber = c.line"""
)
def j04_provenance(t):
    """J-04, R-12: facts to sources by two keys."""
    sources = t("events").where("event_type = 'purchase'").select(F.col("user_id").alias("l_suppkey"), "event_id", (F.col("event_id") % 7 + 1).alias("l_linenumber"))
    return t("lineitem").join(sources, ["l_suppkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j05_orphans(t):
    """J-05, J-06: references whose target does not exist."""
    parents = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return orphans(t("orders").select("o_orderkey", "o_custkey"), parents, ["o_custkey"])


@query(
    """SELECT coalesce(a.k, b.k) AS user_id, CASE WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.k IS NULL THEN 'RIGHT_ONLY' ELSE 'BOTH' END AS status FROM (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup') a
  FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k"""
)
def j08_membership(t):
    """J-08, U-03: which side knows a key."""
    left = t("events").where("event_type = 'signup'").select("user_id")
    return membership(left, t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS n_facts FROM documents GROUP BY ALL HAVING count(*) > 1")
def j09_copies_that_differ(t):
    """J-09: equal digests whose facts differ."""
    return copies_that_differ(t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "source"), "digest", "source")


@query(
    """SELECT e.event_id, e.user_id, e.ts, o.o_orderkey, o.o_totalprice FROM (SELECT event_id, user_id, ts, ts - INTERVAL 25 YEAR AS at FROM events) e
  ASOF LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate"""
)
def j10_as_of(t):
    """J-10: for each event the latest version that is not later."""
    left = t("events").select("event_id", "user_id", "ts", (F.col("ts") - F.expr("INTERVAL 25 YEAR")).alias("at"), F.col("user_id").alias("key"))
    right = t("orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", "o_totalprice")
    return as_of_join(left, right, ["key"], "at", "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey").select("event_id", "user_id", "ts", "o_orderkey", "o_totalprice")


@query(
    """WITH v AS (SELECT o_custkey, o_orderdate, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY ALL)
SELECT o_custkey, o_orderdate, o_orderstatus FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1) WHERE n = 1"""
)
def j10_as_of_without_conflict(t):
    """J-10 (strict): no answer where the latest date has two contents."""
    return current_without_conflict(t("orders"), ["o_custkey"], "o_orderdate", "o_orderstatus", F.lit("1998-06-30").cast("timestamp"))


@query(
    """SELECT l_partkey, l_orderkey, l_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-01-01' <= coalesce(CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 90 DAY END, TIMESTAMP '9999-12-31')
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax) = 1"""
)
def j11_valid_at(t):
    """J-11: the latest rule whose interval holds a moment; an open end holds on."""
    rules = t("lineitem").withColumn("until", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL 90 DAY")))
    order = [F.desc("l_shipdate"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")]]
    return valid_at(rules, F.lit("1999-01-01").cast("timestamp"), "l_shipdate", "until", ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_tax")


@query("SELECT r_name, n_name, s_suppkey, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name IN ('ASIA', 'EUROPE')")
def j12_topic_scope(t):
    """J-12: topics to bundles to sources."""
    topics = t("region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    bundles = topics.join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return bundles.join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("r_name", "n_name", "s_suppkey", "s_name")


@query(
    """SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE CASE WHEN r_name = 'ASIA' THEN true WHEN r_name = 'EUROPE' THEN n_name IN ('NATION_3', 'NATION_8') ELSE false END"""
)
def f12_allow_list(t):
    """F-12: FULL sources pass, PARTIAL ones by their list (an empty list denies), unknown ones never."""
    wide = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scope = F.when(F.col("r_name") == "ASIA", "FULL").when(F.col("r_name") == "EUROPE", "PARTIAL")
    allowed = F.array(F.lit("NATION_3"), F.lit("NATION_8"))
    return wide.where((scope == "FULL") | ((scope == "PARTIAL") & F.array_contains(allowed, F.col("n_name")))).select("s_suppkey", "n_nationkey")


LAW = "CASE doc_id % 3 WHEN 0 THEN '가법' WHEN 1 THEN '가법 시행령' ELSE '나법 시행규칙' END"
CITES = "'법 제' || (1 + doc_id % 4) || '조제2항 및 제' || (1 + doc_id % 5) || '조, 제3조제1항제' || (1 + doc_id % 3) || '호의2 참조'"
PROVISIONS = """SELECT law, article, paragraph, item, law || '/' || article || '/' || coalesce(paragraph, '-') || '/' || coalesce(item, '-') AS text FROM
  (VALUES ('가법'), ('가법 시행령'), ('나법')) l(law), (VALUES ('1', NULL, NULL), ('1', '2', NULL), ('2', NULL, NULL), ('3', NULL, NULL), ('3', '1', NULL), ('3', '1', '1의2'), ('3', '1', '2'), ('3', '2', NULL)) p(article, paragraph, item)"""


@query(
    f"""WITH d AS (SELECT doc_id, {LAW} AS law, regexp_replace({LAW}, ' (시행령|시행규칙)$', '') AS parent FROM documents), p AS ({PROVISIONS}),
 r AS (SELECT doc_id, '법 제' || (1 + doc_id % 4) || '조제2항' AS raw, parent AS law, CAST(1 + doc_id % 4 AS VARCHAR) AS article, '2' AS paragraph, NULL AS item FROM d
  UNION ALL SELECT doc_id, '제' || (1 + doc_id % 5) || '조', law, CAST(1 + doc_id % 5 AS VARCHAR), NULL, NULL FROM d
  UNION ALL SELECT doc_id, '제3조제1항제' || (1 + doc_id % 3) || '호의2', law, '3', '1', (1 + doc_id % 3) || '의2' FROM d)
SELECT r.*, p.text AS target FROM r LEFT JOIN p ON p.law = r.law AND p.article = r.article AND coalesce(p.paragraph, '') = coalesce(r.paragraph, '') AND coalesce(p.item, '') = coalesce(r.item, '')"""
)
def j13_cross_references(t):
    """J-13: references of a text to articles, paragraphs and items, resolved at the level that they name; those to the parent law leave the decree."""
    from factloom.operators.legal import resolved

    docs = t("documents").select("doc_id", F.expr(LAW).alias("law"), F.expr(CITES).alias("text"))
    return resolved(docs, docs.sparkSession.sql(PROVISIONS), ["doc_id"], "law", "text")


@query(
    """SELECT p.p_partkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey FROM part p LEFT JOIN (SELECT s_name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL) a ON a.s_name = 'Supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
  LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL) b ON b.s_nationkey = p_size % 25"""
)
def j14_two_step_lookup(t):
    """J-14, J-15: the exact name first, then a coarser code."""
    exact = t("supplier").groupBy("s_name").agg(F.min("s_suppkey").alias("a"))
    coarse = t("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"))
    p = t("part").select("p_partkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("s_name"), (F.col("p_size") % 25).alias("s_nationkey"))
    return p.join(exact, "s_name", "left").join(coarse, "s_nationkey", "left").select("p_partkey", F.coalesce("a", "b").alias("s_suppkey"))


@query(
    """SELECT e.event_id, min(c.c_custkey) AS c_custkey FROM events e LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg, c_nationkey FROM customer) c
  ON c.c_nationkey = e.user_id % 25 AND (c.seg = CASE e.event_type WHEN 'click' THEN 'BUILDING' ELSE 'MACHINERY' END OR c.seg IS NULL) GROUP BY ALL"""
)
def j16_wildcard_match(t):
    """J-16: a null class on the right is a wildcard. Wildcards and exact classes are joined by equality and the first match kept."""
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_nationkey").alias("nation"))
    first = c.groupBy("nation", "seg").agg(F.min("c_custkey").alias("c_custkey"))
    e = t("events").select("event_id", (F.col("user_id") % 25).cast("int").alias("nation"), F.when(F.col("event_type") == "click", "BUILDING").otherwise("MACHINERY").alias("seg"))
    exact, wild = first.where("seg IS NOT NULL"), first.where("seg IS NULL").select("nation", F.col("c_custkey").alias("w"))
    out = e.join(exact, ["nation", "seg"], "left").join(wild, "nation", "left")
    return out.select("event_id", F.least("c_custkey", "w").alias("c_custkey"))


@query(
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'REMOVED' WHEN a.o_custkey IS NULL THEN 'ADDED' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'SAME' ELSE 'CHANGED' END AS change
  FROM (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL) a FULL JOIN (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL) b ON a.o_custkey = b.o_custkey"""
)
def j17_runs_compared(t):
    """J-17: two runs by key, with null-safe equality."""
    cut = F.lit("1997-01-01").cast("timestamp")
    run = lambda c: t("orders").where(c).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("v"))
    return changed(run(F.col("o_orderdate") < cut), run(F.col("o_orderdate") >= cut), ["o_custkey"], "v")


@query(
    """WITH f AS (SELECT DISTINCT l_suppkey, md5(length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey || length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber || length(CAST(l_returnflag AS VARCHAR)) || ':' || l_returnflag) AS h FROM lineitem)
SELECT l_suppkey, count(*) || ':' || sum(('0x' || substr(h, 1, 14))::BIGINT) || ':' || sum(('0x' || substr(h, 15, 14))::BIGINT) AS fingerprint FROM f GROUP BY ALL"""
)
def e18_fact_fingerprint(t):
    """E-17, E-18: a digest of a key's facts that does not depend on their order."""
    return fingerprint(t("lineitem"), ["l_suppkey"], ["l_partkey", "l_linenumber", "l_returnflag"])


@query(
    """SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0') s WHERE s.h = sha256(d.text))"""
)
def x33_skip_known_hashes(t):
    """X-33, S-22: only texts whose digest was not processed before."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    known = t("documents").where("source = 'src0'").select(digest.alias("h")).distinct()
    fresh = t("documents").select("doc_id", digest.alias("h")).join(known, "h", "left_anti")
    return fresh.join(t("labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality")


@query(
    """SELECT user_id, event_id, ts FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def s11_upsert(t):
    """S-11, S-12: a batch over a table, the latest row of each id stays."""
    old, new = t("events").where("event_id % 2 = 0"), t("events").where("event_id % 3 = 0")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return old.unionByName(new).withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "ts")


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, (string_split(coalesce(text, ''), ' '))[1] || ' ' || coalesce((string_split(coalesce(text, ''), ' '))[2], '') AS name FROM documents), bare AS (SELECT doc_id, regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') AS s, regexp_replace(name, '[^가-힣A-Za-z0-9]', '', 'g') AS n, name FROM d),
 b AS (SELECT doc_id, 'DOCUMENT_HASH_MISMATCH' AS b FROM d WHERE doc_id % 7 = 0 UNION SELECT doc_id, 'EVIDENCE_FAIL:performance[0]' FROM d WHERE doc_id % 11 = 0 UNION SELECT doc_id, 'FACT_MISSING_EVIDENCE:fees[0]' FROM d WHERE doc_id % 13 = 0
  UNION SELECT doc_id, 'RISK_NAME_EMPTY[0]' FROM d WHERE trim(name) = '' UNION SELECT doc_id, 'RISK_NAME_LAYOUT_WHITESPACE[0]' FROM d WHERE regexp_matches(name, '[\n\r\t]')
  UNION SELECT a.doc_id, 'RISK_NAME_NOT_SOURCE_ANCHORED[0]' FROM bare a LEFT JOIN bare c ON c.doc_id = a.doc_id + (CASE WHEN a.doc_id % 5 = 0 THEN 1 ELSE 0 END) WHERE a.doc_id % 17 = 0 OR a.n = '' OR NOT contains(coalesce(c.s, ''), a.n))
SELECT d.doc_id AS doc, coalesce(string_agg(b.b, ',' ORDER BY b.b), '') AS blockers FROM d LEFT JOIN b USING (doc_id) GROUP BY ALL"""
)
def f17_quality_gate(t):
    """F-17: hashes, names of risks in the chunks that they refer to, failed checks and facts without evidence."""
    from factloom.operators.integrity import persistence_blockers

    d = t("documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.split("text", " ", -1)
    refs = F.when(F.col("doc") % 17 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("doc") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)))
    risks = d.select("doc", F.lit(0).alias("i"), F.concat(F.get(words, 0), F.lit(" "), F.coalesce(F.get(words, 1), F.lit(""))).alias("name"), refs.alias("refs"))
    hashes = d.select("doc", F.sha2("text", 256).alias("hash"), F.when(F.col("doc") % 7 == 0, "other").otherwise(F.sha2("text", 256)).alias("expected_hash"))
    some = F.when(F.col("doc") % 13 != 0, F.array("doc"))
    facts = d.select("doc", F.lit("fees").alias("field"), F.lit(0).alias("i"), some.alias("refs"), F.lit("PASS").alias("status"))
    facts = facts.unionByName(d.select("doc", F.lit("performance").alias("field"), F.lit(0).alias("i"), F.array("doc").alias("refs"), F.when(F.col("doc") % 11 == 0, "FAIL").alias("status")))
    out = persistence_blockers(hashes, risks, d.select(F.col("doc").alias("chunk_id"), "text"), facts)
    return out.select("doc", F.concat_ws(",", "blockers").alias("blockers"))
