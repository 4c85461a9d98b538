"""Further extraction queries: rows of tables, narratives, verification, mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.extraction import contained
from factloom.queries.base import query

LINES = "(SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) r(i))"


def lines(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


@query(
    rf"""SELECT doc_id, i, len(c) AS n_cells, c[1] AS first_cell, len(list_filter(c, lambda x: regexp_matches(x, '^[A-ZÀ-Þ]'))) AS n_heads FROM (SELECT doc_id, i, string_split(line, ' | ') AS c FROM {LINES}) WHERE len(c) >= 3"""
)
def x04_cell_rows(t):
    """X-04: lines that are rows of a table, and their cells."""
    cells = F.split("line", r" \| ", -1)
    rows = lines(t).select("doc_id", F.col("i").cast("long").alias("i"), cells.alias("c")).where(F.size("c") >= 3)
    return rows.select("doc_id", "i", F.size("c").cast("long").alias("n_cells"), F.get("c", 0).alias("first_cell"), F.size(F.filter("c", lambda x: x.rlike("^[A-ZÀ-Þ]"))).cast("long").alias("n_heads"))


@query(
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)">([^<]*)</a>')) AS m FROM pages)
SELECT page_id, regexp_extract(m, 'href="(/[^"]*)"', 1) AS href, regexp_extract(m, '>([^<]*)</a>', 1) AS label, count(*) AS n FROM m GROUP BY ALL"""
)
def x07_pattern_rows(t):
    """X-07: rows by a pattern where no table was found."""
    m = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(<li><a href="/[^"]*">[^<]*</a>)'), 1)).alias("m"))
    return m.groupBy("page_id", F.regexp_extract("m", 'href="(/[^"]*)"', 1).alias("href"), F.regexp_extract("m", ">([^<]*)</a>", 1).alias("label")).agg(F.count("*").alias("n"))


@query(
    rf"""SELECT doc_id, i, score FROM (SELECT doc_id, i, least(length(line), 400) / 10.0 + 15 * regexp_matches(line, '^[A-ZÀ-Þ]')::INT + 10 * regexp_matches(line, '[.]$')::INT - 30 * contains(line, '|')::INT AS score FROM {LINES} WHERE trim(line) <> '')
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1"""
)
def x14_best_narrative(t):
    """X-14, E-49: the line with the best additive score, the first on ties."""
    has = lambda c: c.cast("int")
    n = F.col("line")
    score = F.least(F.length(n), F.lit(400)) / 10.0 + 15 * has(n.rlike("^[A-ZÀ-Þ]")) + 10 * has(n.rlike("[.]$")) - 30 * has(n.contains("|"))
    scored = lines(t).where(F.trim("line") != "").select("doc_id", F.col("i").cast("long").alias("i"), score.alias("score"))
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("i", "score"), F.struct("score", -F.col("i"))).alias("x")).select("doc_id", "x.*")


@query(
    rf"""SELECT doc_id, i, n_words, kind FROM (SELECT doc_id, i, len(regexp_extract_all(line, '\S+')) AS n_words, CASE WHEN contains(line, ' | ') THEN 'table' WHEN regexp_matches(line, '!!') THEN 'shouted' WHEN regexp_matches(line, '[%*#&$]{{3}}') THEN 'symbols' WHEN len(regexp_extract_all(line, '\S+')) < 4 THEN 'heading' ELSE 'prose' END AS kind FROM {LINES} WHERE trim(line) <> '')"""
)
def x16_structure_kinds(t):
    """X-16: blocks of a text and their kinds."""
    n, words = F.col("line"), F.size(F.regexp_extract_all("line", F.lit(r"(\S+)"), 1))
    kind = F.when(n.contains(" | "), "table").when(n.rlike("!!"), "shouted").when(n.rlike("[%*#&$]{3}"), "symbols").when(words < 4, "heading").otherwise("prose")
    return lines(t).where(F.trim("line") != "").select("doc_id", F.col("i").cast("long").alias("i"), words.cast("long").alias("n_words"), kind.alias("kind"))


@query(
    """SELECT doc_id, count(DISTINCT item_id) AS n_anchors FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> '' GROUP BY ALL"""
)
def x17_heading_anchors(t):
    """X-17, J-20: passages that are literal spans of a source."""
    found = contained(t("benchmark"), t("documents"), "item_id", "doc_id", "text")
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_anchors"))


@query(
    """SELECT o_orderkey, level, CASE level WHEN 'HIGH' THEN 'table' WHEN 'MEDIUM' THEN 'table+text' ELSE 'text' END AS source FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'HIGH' WHEN o_totalprice > 100000 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM orders)"""
)
def x18_source_choice(t):
    """X-18: the level of a table decides where its records come from."""
    level = F.when(F.col("o_totalprice") > 300_000, "HIGH").when(F.col("o_totalprice") > 100_000, "MEDIUM").otherwise("LOW")
    rows = t("orders").select("o_orderkey", level.alias("level"))
    return rows.select("o_orderkey", "level", F.when(F.col("level") == "HIGH", "table").when(F.col("level") == "MEDIUM", "table+text").otherwise("text").alias("source"))


@query(
    """WITH p AS (SELECT item_id, text, [x for x in string_split_regex(lower(text), '[^a-z]+') if x <> ''] AS k FROM benchmark), j AS (SELECT a.item_id, len(list_intersect(list_distinct(a.k), list_distinct(b.k))) / len(list_distinct(a.k)) AS share FROM p a JOIN p b ON b.item_id = a.item_id + 1)
SELECT item_id, round(share, 6) AS share, CASE WHEN share >= 0.75 THEN 'SUPPORTED' WHEN share >= 0.35 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS verdict FROM j"""
)
def x27_lexical_verdict(t):
    """X-27: the lexical verdict on a narrative by two thresholds."""
    k = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    p = t("benchmark").select("item_id", k.alias("k"))
    other = p.select((F.col("item_id") - 1).alias("item_id"), F.col("k").alias("o"))
    j = p.join(other, "item_id").select("item_id", (F.size(F.array_intersect("k", "o")) / F.size("k")).alias("s"))
    return j.select("item_id", F.round("s", 6).alias("share"), F.when(F.col("s") >= 0.75, "SUPPORTED").when(F.col("s") >= 0.35, "PARTIAL").otherwise("UNSUPPORTED").alias("verdict"))


@query(
    """SELECT p_partkey, json_object('product_key', CASE WHEN p_size % 2 = 0 THEN 'CODE:' || p_size ELSE 'NAMEHASH:' || substr(sha256(p_name), 1, 20) END, 'official_name', p_name, 'risk', CASE WHEN p_size % 10 <> 0 THEN p_size % 6 + 1 END) AS record FROM part"""
)
def x30_standard_record(t):
    """X-30, E-24: the canonical row as a nested record, null fields kept."""
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("CODE:"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("NAMEHASH:"), F.substring(F.sha2("p_name", 256), 1, 20)))
    record = F.struct(key.alias("product_key"), F.col("p_name").alias("official_name"), F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 6 + 1).alias("risk"))
    return t("part").select("p_partkey", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


@query(
    """SELECT s.s_suppkey AS feeder, m.s_suppkey AS master FROM supplier s JOIN supplier m ON m.s_name = 'Supplier#' || lpad(CAST(s.s_suppkey // 10 AS VARCHAR), 9, '0') WHERE s.s_suppkey <> m.s_suppkey"""
)
def x32_master_feeder(t):
    """X-32: relations by a name that another record states."""
    named = t("supplier").select(F.col("s_suppkey").alias("feeder"), F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("s_suppkey") / 10).cast("string"), 9, "0")).alias("s_name"))
    return named.join(t("supplier").select("s_name", F.col("s_suppkey").alias("master")), "s_name").where("feeder <> master").select("feeder", "master")


@query(
    """SELECT event_id, TRY_CAST(json_extract_string(p, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 11 = 0 THEN 'bad_json' WHEN TRY_CAST(json_extract_string(p, '$.k') AS INTEGER) IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{}' WHEN event_id % 13 = 0 THEN '{"z": 1}' ELSE props END AS p FROM events)"""
)
def x35_isolated_errors(t):
    """X-35: a bad item becomes an error row and stops nothing."""
    e = F.col("event_id")
    raw = F.when(e % 11 == 0, "{broken").when(e % 13 == 0, '{"z": 1}').otherwise(F.col("props"))
    rows = t("events").select("event_id", F.from_json(raw, "k int, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    status = F.when(F.col("r._bad").isNotNull(), "bad_json").when(F.col("r.k").isNull(), "missing").otherwise("ok")
    return rows.select("event_id", F.when(F.col("r._bad").isNull(), F.col("r.k")).alias("k"), status.alias("status"))


@query(
    """WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL), u AS (SELECT l_partkey, min(v) AS v FROM c GROUP BY ALL HAVING count(*) = 1)
SELECT p_partkey, coalesce(a.v, b.v, u.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'class' WHEN b.v IS NOT NULL THEN 'benchmark' WHEN u.v IS NOT NULL THEN 'unique' ELSE 'none' END AS how
FROM part LEFT JOIN (SELECT * FROM c WHERE l_returnflag = 'R' AND n > 9) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT * FROM c WHERE l_returnflag = 'A' AND n > 9) b ON b.l_partkey = p_partkey LEFT JOIN u ON u.l_partkey = p_partkey"""
)
def x37_row_search(t):
    """X-37: the class's row, else the benchmark's, else the only one. One aggregation by key holds all three."""
    c = t("lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("v"))
    of = lambda f: F.max(F.when((F.col("l_returnflag") == f) & (F.col("n") > 9), F.col("v")))
    one = c.groupBy("l_partkey").agg(of("R").alias("a"), of("A").alias("b"), F.when(F.count("*") == 1, F.min("v")).alias("u"))
    out = t("part").join(one, F.col("p_partkey") == F.col("l_partkey"), "left")
    how = F.when(F.col("a").isNotNull(), "class").when(F.col("b").isNotNull(), "benchmark").when(F.col("u").isNotNull(), "unique").otherwise("none")
    return out.select("p_partkey", F.coalesce("a", "b", "u").alias("value"), how.alias("how"))


@query(
    """SELECT user_id, array_to_string(list_filter(['no_click', 'no_buy', 'stale', 'no_click'], lambda w: NOT ((w = 'no_click' AND c) OR (w = 'no_buy' AND b) OR w = 'stale')), ',') AS first_pass, len(list_distinct(list_filter(['no_click', 'no_buy', 'stale', 'no_click'], lambda w: NOT ((w = 'no_click' AND c) OR (w = 'no_buy' AND b) OR w = 'stale')))) AS n
 FROM (SELECT user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS b FROM events GROUP BY ALL)"""
)
def x38_contradicted_warnings(t):
    """X-38: warnings that the final state contradicts leave."""
    have = t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    said = F.array(*map(F.lit, ("no_click", "no_buy", "stale", "no_click")))
    left = F.filter(said, lambda w: ~(((w == "no_click") & F.col("c")) | ((w == "no_buy") & F.col("b")) | (w == "stale")))
    return have.select("user_id", F.array_join(left, ",").alias("first_pass"), F.size(F.array_distinct(left)).cast("long").alias("n"))


@query(
    """SELECT p_partkey, l_suppkey, n_nationkey, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_size = 7 AND n_regionkey = 2 GROUP BY ALL"""
)
def j18_region_tables_chunks(t):
    """J-18: regions, tables and chunks by two keys; both filters reach the scans before the fact table is joined."""
    facts = t("lineitem").select("l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    part = t("part").where("p_size = 7").select("p_partkey")
    home = t("supplier").join(t("nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")
    out = facts.join(part, F.col("l_partkey") == F.col("p_partkey")).join(home, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select("p_partkey", "l_suppkey", "n_nationkey", "n")


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_share FROM documents")
def e12_numeric_density(t):
    """E-12: how numeric a text is, dates and all."""
    return t("documents").select("doc_id", F.length(X.compact(F.col("text"))).cast("long").alias("n"), F.round(F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("digit_share"))


@query(
    """SELECT user_id, event_type, n, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"""
)
def d20_run_metrics(t):
    """D20: counts of each node of a run with a running total."""
    c = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("running", F.sum("n").over(w))


@query(
    """WITH b AS (SELECT item_id, list_distinct([x for x in string_split_regex(lower(text), '[^a-z]+') if length(x) >= 6]) AS need FROM benchmark), h AS (SELECT item_id - 1 AS item_id, [x for x in string_split_regex(lower(text), '[^a-z]+')] AS have FROM benchmark)
SELECT item_id, round(len(list_intersect(need, have)) / greatest(len(need), 1), 6) AS share, len(need) > 0 AND len(list_intersect(need, have)) >= 0.5 * len(need) AS covered FROM b JOIN h USING (item_id)"""
)
def a16_fact_coverage(t):
    """A-16: a fact is covered if half of its telling words are there."""
    words = F.split(F.lower("text"), "[^a-z]+")
    need = t("benchmark").select("item_id", F.array_distinct(F.filter(words, lambda x: F.length(x) >= 6)).alias("need"))
    have = t("benchmark").select((F.col("item_id") - 1).alias("item_id"), words.alias("have"))
    got, n = F.size(F.array_intersect("need", "have")), F.size("need")
    return need.join(have, "item_id").select("item_id", F.round(got / F.greatest(n, F.lit(1)), 6).alias("share"), ((n > 0) & (got >= 0.5 * n)).alias("covered"))


@query(
    """SELECT user_id, event_type, min(place) AS place, count(*) AS n FROM (SELECT user_id, event_type, 0 AS place FROM events WHERE event_id % 5 = 0 UNION ALL SELECT user_id, event_type, 1 FROM events WHERE event_id % 2 = 0) GROUP BY ALL"""
)
def u05_contexts_united(t):
    """U-05: contexts of two rounds without repeats, those of the new round first."""
    new, old = t("events").where("event_id % 5 = 0"), t("events").where("event_id % 2 = 0")
    both = new.select("user_id", "event_type", F.lit(0).alias("place")).unionByName(old.select("user_id", "event_type", F.lit(1).alias("place")))
    return both.groupBy("user_id", "event_type").agg(F.min("place").alias("place"), F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT p_partkey, 'fee' AS kind, 'total' AS name, min(l_tax) AS value FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL),
 p AS (SELECT p_partkey, 'performance' AS kind, unnest(['1Y', '2Y']) AS name, unnest([p_retailprice, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 2 END]) AS value FROM part)
SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM p) WHERE value IS NOT NULL AND NOT (kind = 'fee' AND value >= 0.08)"""
)
def x11_table_facts(t):
    """X-11: fee and performance facts in one shape, then the cleaning rules in their order."""
    from factloom.operators.extraction import melted

    fees = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_tax").alias("value"))
    fees = fees.join(t("part").select("p_partkey"), "p_partkey", "left_semi").select("p_partkey", F.lit("fee").alias("kind"), F.lit("total").alias("name"), "value")
    wide = t("part").select("p_partkey", F.lit("performance").alias("kind"), F.col("p_retailprice").alias("y1"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 2).alias("y2"))
    facts = fees.unionByName(melted(wide, ["p_partkey", "kind"], {"y1": "1Y", "y2": "2Y"}, "name", "value"))
    return facts.where(F.col("value").isNotNull()).where(~((F.col("kind") == "fee") & (F.col("value") >= 0.08)))


@query(
    """SELECT l_orderkey, CAST(floor(l_quantity / 10) AS BIGINT) AS row, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_extendedprice, l_partkey, l_suppkey, l_returnflag || l_linestatus) AS line, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def x10_rows_from_boxes(t):
    """X-10: text boxes to rows: boxes of one band of heights are a row, in the order of their left edges."""
    word = F.concat("l_returnflag", "l_linestatus")
    box = F.struct("l_extendedprice", "l_partkey", "l_suppkey", word.alias("word"))
    rows = t("lineitem").groupBy("l_orderkey", F.floor(F.col("l_quantity") / 10).cast("long").alias("row")).agg(F.array_sort(F.collect_list(box)).alias("b"), F.count("*").alias("n"))
    return rows.select("l_orderkey", "row", F.concat_ws(" ", F.transform("b", lambda x: x["word"])).alias("line"), "n")
