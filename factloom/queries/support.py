"""Rows that support facts, and names of several words in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import support as S
from factloom.queries.base import query


@query(
    """WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, l_tax * l_discount AS rate, l_linenumber AS page FROM lineitem), c AS (SELECT l_partkey, l_suppkey AS other, l_tax * l_discount AS cell, l_linenumber AS cell_page, l_returnflag = 'N' AS fees, l_linestatus = 'O' AS heads, l_quantity AS width, l_orderkey FROM lineitem)
SELECT l_partkey, l_suppkey, round(rate, 9) AS rate, page, rate = cell AS exact, fees AS in_section, heads AS under_header, abs(page - cell_page) AS distance, width, other, l_orderkey FROM f JOIN c USING (l_partkey) WHERE other <> l_suppkey AND abs(rate - cell) <= 5e-4
 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, rate, page ORDER BY (rate <> cell)::INT, fees DESC, heads DESC, abs(page - cell_page), width DESC, other, l_orderkey) = 1"""
)
def x36_supporting_rows(t):
    """X-25, X-36: the row of another supplier that supports a part's rate best, by five keys, within a tolerance."""
    line = t("lineitem").withColumn("rate", F.col("l_tax") * F.col("l_discount"))
    facts = line.select("l_partkey", "l_suppkey", "rate", F.col("l_linenumber").alias("page"))
    cells = line.select("l_partkey", F.col("l_suppkey").alias("other"), F.col("rate").alias("cell"), F.col("l_linenumber").alias("cell_page"), (F.col("l_returnflag") == "N").alias("fees"), (F.col("l_linestatus") == "O").alias("heads"), F.col("l_quantity").alias("width"), "l_orderkey")
    found = S.supporting_rows(facts, cells, ["l_partkey"], "rate", "cell", "page", "cell_page", F.col("fees"), F.col("heads"), "width", ["other", "l_orderkey"], differs=F.col("other") != F.col("l_suppkey"))
    s = lambda n: F.col(f"support.{n}")
    return found.select("l_partkey", "l_suppkey", F.round("rate", 9).alias("rate"), "page", s("exact").alias("exact"), s("section").alias("in_section"), s("header").alias("under_header"), s("distance").alias("distance"), s("width").alias("width"), s("other").alias("other"), s("l_orderkey").alias("l_orderkey"))


PERFORMANCE = """r AS (SELECT l_orderkey, l_linenumber * 1000000 + l_suppkey * 100 + l_quantity::INT AS row_no, l_returnflag || l_linenumber AS label, CASE WHEN l_discount > 0.09 THEN 'benchmark' WHEN l_discount < 0.01 THEN 'volatility' ELSE 'class' END AS kind, l_tax AS cell FROM lineitem),
f AS (SELECT o_orderkey AS l_orderkey, CASE o_orderstatus WHEN 'F' THEN 'benchmark' WHEN 'P' THEN 'volatility' ELSE 'class' END AS kind, CASE WHEN o_orderpriority < '3' THEN 'N1' WHEN o_orderpriority < '4' THEN 'X' END AS name, CAST(floor(o_totalprice) AS BIGINT) % 9 / 100 AS value FROM orders)"""


@query(
    f"""WITH {PERFORMANCE}, k AS (SELECT l_orderkey, kind, min(row_no) AS by_kind FROM r WHERE kind <> 'class' GROUP BY ALL), n AS (SELECT l_orderkey, label AS name, min(row_no) AS by_name FROM r GROUP BY ALL),
v AS (SELECT f.l_orderkey, min(row_no) AS lone FROM f JOIN r USING (l_orderkey) WHERE f.kind = 'class' AND name IS NULL AND r.kind = 'class' AND abs(value - cell) <= 5e-4 GROUP BY ALL HAVING count(*) = 1)
SELECT f.l_orderkey, coalesce(by_kind, CASE WHEN f.kind = 'class' THEN by_name END, lone) AS row_no, CASE WHEN by_kind IS NOT NULL THEN f.kind WHEN f.kind = 'class' AND by_name IS NOT NULL THEN 'class' WHEN lone IS NOT NULL THEN 'value' END AS stage FROM f LEFT JOIN k USING (l_orderkey, kind) LEFT JOIN n USING (l_orderkey, name) LEFT JOIN v USING (l_orderkey)"""
)
def x37_performance_rows(t):
    """X-37: the row of a performance fact: benchmark, volatility, class, or the only row that carries the expected value."""
    d = F.col("l_discount")
    rows = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("int")).alias("row_no"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"), F.when(d > 0.09, "benchmark").when(d < 0.01, "volatility").otherwise("class").alias("kind"), F.col("l_tax").alias("cell"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    facts = t("orders").select(
        F.col("o_orderkey").alias("fact"), F.col("o_orderkey").alias("l_orderkey"), F.when(status == "F", "benchmark").when(status == "P", "volatility").otherwise("class").alias("kind"),
        F.when(priority < "3", "N1").when(priority < "4", "X").alias("name"), (F.floor("o_totalprice") % 9 / 100).alias("value"),
    )
    return S.performance_row(facts, rows, "fact", "l_orderkey", "row_no", "label", "kind", "name", "value", "cell").select(F.col("fact").alias("l_orderkey"), "row_no", "stage")


NORMAL = r"' ' || trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@query(
    rf"""WITH d AS (SELECT doc_id, {NORMAL.format("text")} AS x FROM documents), b AS (SELECT item_id, {NORMAL.format("text")} AS y FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS text FROM benchmark))
SELECT doc_id, item_id, CAST((length(x) - length(replace(x, y, ' '))) / (length(y) - 1) AS BIGINT) AS n FROM d JOIN b ON contains(x, y) AND trim(y) <> ''"""
)
def j19_phrases_in_texts(t):
    """F-10, J-19: phrases of several words in whole texts, by an equality join on runs of words."""
    phrases = t("benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("phrase"))
    found = S.phrases_in(t("documents"), phrases, "doc_id", "item_id", "text", "phrase")
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query(
    rf"""WITH p AS (SELECT p_partkey, {NORMAL.format("p_name")} AS y FROM part), t AS (SELECT p_partkey // 20 AS shelf, ' ' || string_agg(trim(y), ' x ' ORDER BY p_partkey) || ' ' AS x FROM p GROUP BY ALL)
SELECT shelf, p_partkey FROM t JOIN (SELECT min(p_partkey) AS p_partkey, y FROM p GROUP BY y) ON contains(x, y)"""
)
def x32_names_on_shelves(t):
    """X-32, F-10: part names of several words in texts that list them; equal names count for the smallest key."""
    names = t("part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / 20).alias("shelf"))
    texts = names.groupBy("shelf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " x ").alias("text"))
    said = names.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("p_partkey"))
    return S.phrases_in(texts, said, "shelf", "p_partkey", "text", "name").select("shelf", "p_partkey").distinct()
