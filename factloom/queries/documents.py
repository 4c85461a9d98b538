"""Extraction queries: pages and documents stand for parsed prospectuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import extraction as X
from factloom.queries.base import query

SECTIONS = {"fees": ["the", "fee", "of"], "risk": ["und", "der", "die"], "performance": ["les", "des", "que"], "strategy": ["de ", "el "]}


@query(
    """WITH s AS (SELECT doc_id, lower(text) AS x FROM documents), n AS (SELECT doc_id, contains(x, 'the')::INT + contains(x, 'fee')::INT + contains(x, 'of')::INT AS a, contains(x, 'und')::INT + contains(x, 'der')::INT + contains(x, 'die')::INT AS b,
  contains(x, 'les')::INT + contains(x, 'des')::INT + contains(x, 'que')::INT AS c, contains(x, 'de ')::INT + contains(x, 'el ')::INT AS d FROM s)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN 'none' WHEN a = greatest(a, b, c, d) THEN 'fees' WHEN b = greatest(a, b, c, d) THEN 'risk' WHEN c = greatest(a, b, c, d) THEN 'performance' ELSE 'strategy' END AS section, CAST(greatest(a, b, c, d) AS BIGINT) AS n_hits FROM n"""
)
def x01_section_classifier(t):
    """X-01, E-47: the section with most keyword hits."""
    return X.section_scores(t("documents"), "doc_id", F.lower("text"), SECTIONS)


@query()
def x02_heading_spans(t):
    """W-08, X-02: sections from heading to heading inside a text."""
    return X.heading_spans(t("documents"), "doc_id", "text", r"(?m)^[A-ZÀ-Þ]\S+")


@query()
def x03_packed_chunks(t):
    """W-09, X-03: paragraphs packed into chunks."""
    out = X.packed_chunks(t("documents"), "doc_id", "text")
    return out.select("doc_id", "seq", F.length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    r"""SELECT page_id, contains(html, '<article') AND regexp_matches(html, '<p') AS accepted, array_to_string(list_filter(['no_cover', 'few_sections'], lambda r: (r = 'no_cover' AND NOT contains(html, '<h1')) OR (r = 'few_sections' AND len(regexp_extract_all(html, '<(nav|footer|article|aside)')) < 3)), ',') AS reasons FROM pages"""
)
def f18_guardrail(t):
    """F-18, F-13: a document needs a cover mark and enough section marks; otherwise the reasons."""
    has = lambda s: F.contains("html", F.lit(s))
    marks = F.size(F.regexp_extract_all("html", F.lit("<(nav|footer|article|aside)"), 1))
    reasons = F.array_compact(F.array(F.when(~has("<h1"), "no_cover"), F.when(marks < 3, "few_sections")))
    return t("pages").select("page_id", (has("<article") & has("<p")).alias("accepted"), F.concat_ws(",", reasons).alias("reasons"))


@query(
    """SELECT p_partkey, period, value FROM (SELECT p_partkey, unnest(['1Y', '2Y', '3Y', 'SINCE_INCEPTION']) AS period, unnest([p_retailprice, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 2 END, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 3 END, p_size]) AS value FROM part) WHERE value IS NOT NULL"""
)
def x12_melt(t):
    """X-12, X-13: period columns to rows."""
    p, s = F.col("p_retailprice"), F.col("p_size")
    wide = t("part").select("p_partkey", p.alias("y1"), F.when(s % 2 == 0, p * 2).alias("y2"), F.when(s % 3 == 0, p * 3).alias("y3"), s.cast("double").alias("si"))
    return X.melted(wide, ["p_partkey"], {"y1": "1Y", "y2": "2Y", "y3": "3Y", "si": "SINCE_INCEPTION"}, "period", "value")


@query(
    """WITH c AS (SELECT doc_id, string_split(replace(text, chr(10), ' | '), ' | ') AS a, len(a) AS n, len(list_filter(a, lambda x: trim(x) = '')) AS e FROM documents)
SELECT doc_id, CASE WHEN n = 0 OR e / n > 0.6 THEN 'BROKEN' WHEN e / n > 0.3 OR list_max(list_transform(a, lambda x: length(x))) > 300 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS quality FROM c"""
)
def x08_table_quality(t):
    """X-08: the state of a table whose rows are lines."""
    cells = F.split(F.col("text"), r"\n| \| ", -1)
    return t("documents").select("doc_id", X.table_quality(cells).alias("quality"))


@query(
    """SELECT l_orderkey, l_linenumber AS priority, q AS quality FROM (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN min(l_returnflag) = 'A' THEN 'BROKEN' ELSE 'NORMAL' END AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (q <> 'NORMAL')::INT, l_linenumber) = 1"""
)
def x09_fallback_cascade(t):
    """X-09: the best source of a table by state and priority."""
    c = t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("priority")).agg(F.when(F.min("l_returnflag") == "A", "BROKEN").otherwise("NORMAL").alias("quality"))
    return X.fallback_cascade(c, ["l_orderkey"], "priority", "quality")


@query(
    """SELECT user_id, concat_ws(',', CASE WHEN bool_or(event_type = 'click') THEN NULL ELSE 'clicked' END, CASE WHEN bool_or(event_type = 'purchase') THEN NULL ELSE 'bought' END) AS missing,
 CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') THEN 'success' WHEN bool_or(event_type = 'click') OR bool_or(event_type = 'purchase') THEN 'warning' ELSE 'failed' END AS status FROM events GROUP BY ALL"""
)
def x28_reconciliation(t):
    """X-28, X-23: which fields a document has, and its final status."""
    e = t("events").select("user_id", F.when(F.col("event_type") == "click", 1).alias("clicked"), F.when(F.col("event_type") == "purchase", 1).alias("bought"))
    return X.presence(e, "user_id", ["clicked", "bought"])


@query(
    """SELECT source, NOT bool_or(contains(lower(text), 'idiot')) AS absent, count(*) AS n FROM documents GROUP BY ALL"""
)
def x24_source_absent(t):
    """X-24: no text of a source says it; a flag is combined, texts are not gathered."""
    return t("documents").groupBy("source").agg((~F.bool_or(F.contains(F.lower("text"), F.lit("idiot")))).alias("absent"), F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_totalprice END AS fact, c_acctbal < 0 AS cleared FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def x21_ownership(t):
    """X-21: facts of an owner that is not valid are cleared."""
    wide = t("orders").join(t("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    bad = F.col("c_acctbal") < 0
    return wide.select("o_orderkey", F.when(~F.coalesce(bad, F.lit(False)), F.col("o_totalprice")).alias("fact"), bad.alias("cleared"))


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN abs(l_tax - l_discount) <= 5e-4 THEN 'MATCH' WHEN l_discount IS NULL THEN 'SKIPPED' ELSE 'MISMATCH' END AS verdict FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (abs(l_tax - l_discount) > 5e-4)::INT, l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1"""
)
def x25_supporting_row(t):
    """X-25, X-36: the row that supports a fact best, by exact value, then width, then place."""
    bad = F.abs(F.col("l_tax") - F.col("l_discount")) > 5e-4
    order = F.struct(bad.cast("int"), -F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    best = t("lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber", F.when(~bad, "MATCH").when(F.col("l_discount").isNull(), "SKIPPED").otherwise("MISMATCH").alias("verdict")), order).alias("x"))
    return best.select("l_partkey", "x.*")


@query(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE value IS NOT NULL AND event_type <> 'error'"""
)
def x29_renumbered(t):
    """X-29: bad rows leave and the rest is numbered anew."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").where("value IS NOT NULL AND event_type <> 'error'").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query(
    """SELECT doc_id, kind, field FROM (SELECT doc_id, 'NOT_FOUND' AS kind, 'lang' AS field FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'AMBIGUOUS', 'text' FROM documents WHERE length(text) < 100 UNION ALL SELECT doc_id, 'PARSE_FAILED', 'text' FROM documents WHERE contains(text, '|'))"""
)
def x40_issues(t):
    """X-40: one issue row for each rule that applies; one scan, not one for each rule."""
    issue = lambda kind, field, c: F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field")))
    rules = F.array_compact(F.array(issue("NOT_FOUND", "lang", F.col("lang") == "es"), issue("AMBIGUOUS", "text", F.length("text") < 100), issue("PARSE_FAILED", "text", F.contains("text", F.lit("|")))))
    return t("documents").select("doc_id", F.explode(rules).alias("x")).select("doc_id", "x.*")


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-ZÀ-Þ]') AND length(text) > 200 THEN 'keep' WHEN length(text) > 100 THEN 'candidate' ELSE 'clear' END AS choice FROM documents"""
)
def x39_narrative_choice(t):
    """X-39, E-48: keep a complete narrative, else take a candidate, else clear it."""
    complete = F.col("text").rlike("^[A-ZÀ-Þ]") & (F.length("text") > 200)
    return t("documents").select("doc_id", F.when(complete, "keep").when(F.length("text") > 100, "candidate").otherwise("clear").alias("choice"))
