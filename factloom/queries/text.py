"""Text, number and date function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import classes as C
from factloom.functions import text as X
from factloom.queries.base import query

TOK = "[x.lower() for x in regexp_extract_all(text, '[A-Za-z]+|[가-힣]{2,}|[0-9]+(?:\\.[0-9]+)?')]"


@query(f"SELECT doc_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_distinct, md5(array_to_string({TOK}, ' ')) AS digest FROM documents")
def r01_tokens(t):
    """R-01: the tokenizer."""
    k = X.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.size(F.array_distinct(k)).cast("long").alias("n_distinct"), F.md5(F.concat_ws(" ", k).cast("binary")).alias("digest"))


@query(
    r"""SELECT page_id, regexp_replace(url, '[\s　]+', '', 'g') AS compacted, lower(regexp_replace(url, '[^0-9A-Za-z가-힣]+', '', 'g')) AS folded, trim(regexp_replace(lower(url), '\s+', ' ', 'g')) AS question FROM pages"""
)
def e01_normal_forms(t):
    """E-01, E-02, E-19: compact, folded and squeezed forms."""
    u = F.col("url")
    return t("pages").select("page_id", X.compact(u).alias("compacted"), X.fold(u).alias("folded"), X.squeeze(F.lower(u)).alias("question"))


@query(
    r"""SELECT page_id, TRY_CAST(replace(regexp_extract(url, '(-?\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS first, len(regexp_extract_all(url, '(-?\d[\d,]*(?:\.\d+)?)')) AS n FROM pages"""
)
def e03_numbers(t):
    """E-03, E-04, E-31: first and all numbers."""
    return t("pages").select("page_id", X.first_number(F.col("url")).alias("first"), F.size(X.all_numbers(F.col("url"))).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(abs(l_discount - l_tax) <= 5e-4, false) AS near FROM lineitem")
def e05_nearly_equal(t):
    """E-05: equality within a tolerance."""
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.nearly(F.col("l_discount"), F.col("l_tax")).alias("near"))


@query(r"SELECT event_id, regexp_replace(printf('%.4f', value), '\.?0+$', '') AS shown, regexp_replace(printf('%.6f', value / 8), '\.?0+$', '') AS shown6 FROM events")
def e06_number_format(t):
    """E-06: numbers without zeros at the end."""
    return t("events").select("event_id", X.trimmed_number(F.col("value"), 4).alias("shown"), X.trimmed_number(F.col("value") / 8, 6).alias("shown6"))


@query(
    """SELECT o_orderkey, o_orderkey % 3 <> 2 AS mentioned, strftime(o_orderdate, '%Y-%m-%d') AS long_form FROM orders"""
)
def e07_date_spellings(t):
    """E-07, E-08: a date in any of its spellings; short dates made long."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    said = F.concat(F.lit("as of "), F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy.MM.dd")).otherwise(F.date_format(d, "dd 'of' MM yyyy")))
    return t("orders").select("o_orderkey", X.mentions_date(said, d).alias("mentioned"), X.long_date(F.when(F.year(d) >= 2000, F.date_format(d, "yy.MM.dd")).otherwise(F.date_format(d, "yyyy.MM.dd"))).alias("long_form"))


@query(
    """WITH b AS (SELECT item_id, text AS a, lead(text) OVER (ORDER BY item_id) AS c, greatest(6, least(12, length(text) // 4)) AS w FROM benchmark), s AS (SELECT item_id, a, c, w, unnest(generate_series(1, greatest(length(a) - w + 1, 1), w)) AS i FROM b)
SELECT item_id, round(avg(coalesce(contains(c, substr(a, CAST(i AS INTEGER), w)), false)::INT), 6) AS overlap FROM s GROUP BY ALL"""
)
def e09_block_overlap(t):
    """E-09, X-27: the share of a text's blocks that another holds."""
    b = t("benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("c"))
    return b.join(after, "item_id", "left").select("item_id", F.round(F.coalesce(X.block_overlap(F.col("text"), F.col("c")), F.lit(0.0)), 6).alias("overlap"))


@query(
    f"""WITH b AS (SELECT item_id, list_distinct({TOK}) AS k FROM benchmark)
SELECT a.item_id, round(len(list_intersect(a.k, b.k)) / least(len(a.k), len(b.k)), 6) AS overlap FROM b a JOIN b ON b.item_id = a.item_id + 1"""
)
def e10_token_overlap(t):
    """E-10, E-56: shared tokens over the smaller set."""
    b = t("benchmark").select("item_id", X.tokens(F.col("text")).alias("k"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("k").alias("c"))
    return b.join(after, "item_id").select("item_id", F.round(X.token_overlap(F.col("k"), F.col("c")), 6).alias("overlap"))


@query(
    f"""WITH b AS (SELECT item_id, text, text AS claim, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark), k AS (SELECT *, [x.lower() for x in regexp_extract_all(claim, '[A-Za-z]+')] AS c, [x.lower() for x in regexp_extract_all(coalesce(other, ''), '[A-Za-z]+')] AS o FROM b)
SELECT item_id, coalesce(contains(regexp_replace(other, '\\s+', '', 'g'), regexp_replace(claim, '\\s+', '', 'g')) OR len(list_intersect(list_distinct(c), o)) >= 0.85 * len(list_distinct(c)), false) AS by_other, true AS by_own FROM k"""
)
def e11_support(t):
    """E-11: a claim supported by a source."""
    b = t("benchmark").select("item_id", "text", F.col("text").alias("claim"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(after, "item_id", "left").select("item_id", X.supported(F.col("claim"), F.col("other")).alias("by_other"), X.supported(F.col("claim"), F.col("text")).alias("by_own"))


@query(
    r"""SELECT doc_id, length(regexp_replace(text, '[^�ÃÂ]', '', 'g')) >= 5 OR length(regexp_replace(text, '[^�ÃÂ]', '', 'g')) / greatest(length(text), 1) > 0.02 AS suspicious FROM documents WHERE length(text) > 0"""
)
def e13_bad_encoding(t):
    """E-13: texts that were decoded wrongly."""
    return t("documents").where("length(text) > 0").select("doc_id", X.suspicious_encoding(F.col("text")).alias("suspicious"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '\.[A-Za-z0-9]+$', ''), '[^0-9A-Za-z가-힣_-]+', '_', 'g') AS id, sha256(url) AS digest, substr(sha256(url), 1, 20) AS short FROM pages")
def e15_ids(t):
    """E-15, E-16, E-24, E-26: ids and digests."""
    h = F.sha2(F.col("url").cast("binary"), 256)
    return t("pages").select("page_id", X.safe_id(F.col("url")).alias("id"), h.alias("digest"), F.substring(h, 1, 20).alias("short"))


CLASS_NAMES = "CASE event_id % 5 WHEN 0 THEN '종류A(수수료선취-오프라인)' WHEN 1 THEN '종류C-P2e(수수료미징구-온라인-퇴직연금)' WHEN 2 THEN '종류S-P(수수료후취-온라인-연금저축)' WHEN 3 THEN '종류C-P(개인연금)' ELSE '종류F' END"
RATE_WORDS = "CASE event_id % 6 WHEN 0 THEN '납입금액의 1.0% 이 내' WHEN 1 THEN '최소 0.1%' WHEN 2 THEN '최대' WHEN 3 THEN '정액' WHEN 4 THEN '' END"


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'FRONT_END' WHEN 1 THEN 'NONE' WHEN 2 THEN 'BACK_END' END AS charge, CASE event_id % 5 WHEN 0 THEN 'OFFLINE' WHEN 1 THEN 'ONLINE' WHEN 2 THEN 'ONLINE' END AS channel,
  CASE event_id % 5 WHEN 1 THEN 'RETIREMENT_PENSION' WHEN 2 THEN 'PERSONAL_PENSION' WHEN 3 THEN 'PERSONAL_PENSION' END AS pension, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS online FROM events"""
)
def e22_class_attributes(t):
    """E-22: charge, channel, pension type and online sale that a class name states."""
    return t("events").select("event_id", C.class_attributes(F.expr(CLASS_NAMES)).alias("a")).select("event_id", "a.*")


@query(
    """WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'MAX' WHEN 1 THEN 'MIN' WHEN 2 THEN 'MAX' WHEN 3 THEN 'EXACT' ELSE 'UNKNOWN' END AS condition FROM events)
SELECT event_id, condition, CASE WHEN condition IN ('EXACT', 'UNKNOWN') THEN event_id END AS rate, CASE condition WHEN 'MAX' THEN event_id END AS rate_max, CASE condition WHEN 'MIN' THEN event_id END AS rate_min FROM c"""
)
def e23_rate_condition(t):
    """E-23: the words of a condition decide which column a rate goes to."""
    words = F.expr(RATE_WORDS)
    return t("events").select("event_id", C.rate_condition(words).alias("condition"), C.routed_rate(words, F.col("event_id")).alias("r")).select("event_id", "condition", "r.*")


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'stated' WHEN 1 THEN 'benchmark_return' WHEN 2 THEN 'volatility' WHEN 3 THEN 'fund_return' WHEN 4 THEN 'benchmark_return' END AS metric FROM events"""
)
def e30_metric_type(t):
    """E-30: the type of a figure, stated or implied by its subject, kind or class."""
    k = F.col("event_id") % 6
    subject = F.when(k == 1, "비교지수(%)").when(k == 2, "수익률 변동성")
    out = C.metric_type(F.when(k == 0, "stated"), subject, F.when(k == 4, "benchmark"), F.when(k == 3, "종류A"))
    return t("events").select("event_id", out.alias("metric"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN true WHEN p_name LIKE '%blue%' THEN false END AS tag FROM part")
def e27_tri_state(t):
    """E-27: true, false or unknown."""
    return t("part").select("p_partkey", F.when(F.contains("p_name", F.lit("red")), True).when(F.contains("p_name", F.lit("blue")), False).alias("tag"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'CLK' WHEN 'view' THEN 'VIW' ELSE upper(event_type) END AS alias, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def e29_alias_map(t):
    """E-29, E-52: aliases by a map; JSON fields by schema."""
    names = F.create_map(F.lit("click"), F.lit("CLK"), F.lit("view"), F.lit("VIW"))
    return t("events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.upper("event_type")).alias("alias"), F.from_json("props", "k long")["k"].alias("k"))


MORE_FACTS = """CASE event_id % 6 WHEN 0 THEN '기준일 2026-09-0' || (1 + event_id % 9) || ' 입니다' WHEN 1 THEN '마감 09:' || (10 + event_id % 50) WHEN 2 THEN '붙임 x' || event_id || '.pdf 참조, 3개월' WHEN 3 THEN '1) 수수료 ' || event_id || '.50%' WHEN 4 THEN '코드 AB-' || event_id || ' 는 7영업일' ELSE '없음' END"""
FACTS = "CASE event_id % 4 WHEN 0 THEN '수익률은 ' || event_id || '% 입니다' WHEN 1 THEN '한도는 ' || event_id || '만원 입니다' WHEN 2 THEN '100분의 ' || (event_id % 90) || ' 적용' ELSE '금액 ' || event_id || '0000원' END"


@query(
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 10000 WHEN 2 THEN event_id % 90 ELSE event_id * 10000 END AS DECIMAL(34,6)) AS value, CASE event_id % 4 WHEN 0 THEN '%' WHEN 1 THEN '원' WHEN 2 THEN '%' ELSE '원' END AS unit FROM events"""
)
def e36_numeric_facts(t):
    """E-36: numbers with units in one canonical form."""
    fact = F.get(X.numeric_facts(F.expr(FACTS)), 0)
    return t("events").select("event_id", fact["value"].cast("decimal(34,6)").alias("value"), fact["unit"].alias("unit"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2026:9:' || (1 + event_id % 9) || ' date' WHEN 1 THEN '9:' || (10 + event_id % 50) || ' time' WHEN 2 THEN '3 개월' WHEN 3 THEN event_id || '.5 %' WHEN 4 THEN '7 영업일' ELSE '' END AS facts FROM events"""
)
def e36_moments_and_codes(t):
    """E-36: dates and times are facts; file names, list numbers and codes are none."""
    facts = F.transform(X.numeric_facts(F.expr(MORE_FACTS)), lambda x: F.concat_ws(" ", x["value"], x["unit"]))
    return t("events").select("event_id", F.array_join(facts, ", ").alias("facts"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM events")
def e35_grounding(t):
    """E-35, E-43: an answer's numbers must stand in the evidence with the same unit."""
    evidence = F.concat(F.lit("근거: "), (F.col("event_id") * 10_000).cast("string"), F.lit("원"))
    missing = X.unsupported_facts(F.expr(FACTS), evidence)
    return t("events").select("event_id", F.when(F.size(missing) == 0, "PASS").otherwise("REVIEW").alias("verdict"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS n_mails, regexp_matches(text, '(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+') AS secret FROM documents"""
)
def e39_redaction_needed(t):
    """E-39: what the redaction would mask."""
    mails = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)"), 1)
    return t("documents").select("doc_id", F.size(mails).cast("long").alias("n_mails"), F.col("text").rlike(r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+").alias("secret"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head, split_part(o_orderpriority, '-', -1) AS tail FROM orders")
def e44_split(t):
    """E-44: a label split at its last mark."""
    return t("orders").select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("head"), F.substring_index("o_orderpriority", "-", -1).alias("tail"))


@query(
    """SELECT l_orderkey, '| ' || string_agg(l_linenumber || ' | ' || l_returnflag || ' | ' || l_partkey || ' |', chr(10) || '| ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS markdown FROM lineitem GROUP BY ALL"""
)
def e46_markdown(t):
    """E-46: the few rows of each order rendered as a table."""
    line = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), "l_returnflag", F.col("l_partkey").cast("string")).alias("line")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line)))
    return t("lineitem").groupBy("l_orderkey").agg(F.concat_ws("\n", F.transform(rows, lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |")))).alias("markdown"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'diagnostic' ELSE 'info' END AS class FROM events")
def e55_severity(t):
    """E-55, X-23: the class of a message."""
    said = F.concat(F.when(F.col("event_type") == "view", "debug").otherwise(F.col("event_type")), F.lit(" happened"))
    return t("events").select("event_id", X.severity(said).alias("class"))


@query("SELECT n_nationkey, least(levenshtein(n_name, r_name), 99) AS distance, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS ratio FROM nation JOIN region ON n_regionkey = r_regionkey")
def e58_fuzzy_ratio(t):
    """E-58: a fuzzy ratio from the edit distance."""
    d = F.levenshtein("n_name", "r_name")
    wide = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return wide.select("n_nationkey", F.least(d, F.lit(99)).cast("long").alias("distance"), F.round(1 - d / F.greatest(F.length("n_name"), F.length("r_name")), 6).alias("ratio"))
