"""Aggregation queries: reports, rates, audits, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators.evaluation import failure_tally, pass_report, ranking_metrics, upper_medians
from factloom.operators.integrity import gate, verdicts
from factloom.queries.base import query


@query(
    """WITH ranked AS (SELECT c_nationkey AS q, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
 gold AS (SELECT c_nationkey AS q, c_custkey AS item FROM customer WHERE c_mktsegment = 'BUILDING'),
 hits AS (SELECT q, count(*) AS n, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN gold USING (q, item) WHERE rank <= 10 GROUP BY ALL),
 need AS (SELECT q, count(DISTINCT item) AS g FROM gold GROUP BY ALL)
SELECT q, round(coalesce(n / g, 0), 4) AS recall, round(coalesce(1 / f, 0), 4) AS mrr, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= g), 0), 4) AS ndcg FROM need LEFT JOIN hits USING (q)"""
)
def a10_ranking_metrics(t):
    """A-10: recall, MRR and nDCG at 10."""
    w = Window.partitionBy("q").orderBy(F.desc("c_acctbal"), "item")
    c = t("customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("item"), "c_acctbal", "c_mktsegment")
    return ranking_metrics(c.withColumn("rank", F.row_number().over(w)), c.where("c_mktsegment = 'BUILDING'").select("q", "item"), "q", "item", "rank", 10)


@query(
    """SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'lang' END AS dimension, coalesce(source, lang) AS value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang))"""
)
def a11_counts_by_two_dimensions(t):
    """A-11, A-33, A-17: several groupings from one scan by grouping sets."""
    d = t("documents").groupingSets([["source"], ["lang"]], "source", "lang")
    out = d.agg(F.grouping("source").alias("g"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return out.select(F.when(F.col("g") == 0, "source").otherwise("lang").alias("dimension"), F.coalesce("source", "lang").alias("value"), "n", "chars")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def a12_last_wins(t):
    """A-12: of rows with one stable id the last stays."""
    best = t("events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return best.select("user_id", "event_type", "x.event_id", "x.value")


CHECKS = """SELECT l_orderkey AS k, l_linenumber AS c, CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 'FAIL' WHEN l_discount > 0.08 THEN 'WARNING' WHEN l_quantity < 2 THEN 'SKIP' ELSE 'PASS' END AS status FROM lineitem"""


def checks(t):
    status = F.when((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07), "FAIL").when(F.col("l_discount") > 0.08, "WARNING").when(F.col("l_quantity") < 2, "SKIP").otherwise("PASS")
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"), status.alias("status"))


@query(
    f"""SELECT k, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'WARNING') AS n_warning, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'SKIP') AS n_skip,
  CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warning > 0 THEN 'WARNING' ELSE 'PASS' END AS verdict FROM ({CHECKS}) GROUP BY ALL"""
)
def a13_verdict_rollup(t):
    """A-13, A-14: checks to one verdict per key."""
    return verdicts(checks(t), ["k"], "status")


@query(f"SELECT k, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (status = 'FAIL'), '') AS blockers, count(*) FILTER (status = 'FAIL') = 0 AS passed FROM ({CHECKS}) GROUP BY ALL")
def f16_persistence_gate(t):
    """F-16: the blockers of each key; it passes without any."""
    return gate(checks(t), "k", "c", F.col("status") == "FAIL")


@query(
    """SELECT user_id, round(len(list_intersect(list(DISTINCT event_type), ['click', 'purchase', 'refund'])) / 3, 4) AS coverage, array_to_string(list_sort(list_filter(['click', 'purchase', 'refund'], lambda x: NOT list_contains(list(DISTINCT event_type), x))), ',') AS missing FROM events GROUP BY ALL"""
)
def a15_domain_coverage(t):
    """A-15, U-02, U-03: required and covered domains."""
    need = F.array(*[F.lit(x) for x in ("click", "purchase", "refund")])
    got = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("got"))
    return got.select("user_id", F.round(F.size(F.array_intersect(need, "got")) / 3, 4).alias("coverage"), F.concat_ws(",", F.array_sort(F.array_except(need, "got"))).alias("missing"))


@query(
    """WITH c AS (SELECT o_orderpriority, o_orderstatus, (o_totalprice > 150000)::INT AS p FROM orders), g AS (SELECT 'all' AS dimension, 'all' AS value, p FROM c UNION ALL SELECT 'o_orderpriority', o_orderpriority, p FROM c UNION ALL SELECT 'o_orderstatus', o_orderstatus, p FROM c)
SELECT dimension, value, CAST(sum(p) AS BIGINT) AS n_passed, CAST(sum(1 - p) AS BIGINT) AS n_failed, round(avg(p), 4) AS pass_rate FROM g GROUP BY ALL"""
)
def a17_pass_report(t):
    """A-17, A-34: pass and fail by each dimension and in total."""
    return pass_report(t("orders").withColumn("p", (F.col("o_totalprice") > 150000).cast("long")), ["o_orderpriority", "o_orderstatus"], "p")


@query("SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, list_sort(list(value))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS p50 FROM events GROUP BY ALL")
def a18_latency_summary(t):
    """A-18: mean, upper median, maximum."""
    middle = upper_medians(t("events"), ["event_type"], "value", "p50")
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).join(middle, "event_type", "left")


@query(
    """WITH c AS (SELECT l_returnflag || ':' || l_linestatus || ':' || l_linenumber AS code FROM lineitem)
SELECT 'full' AS level, code, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'prefix', split_part(code, ':', 1) || ':' || split_part(code, ':', 2), count(*) FROM c GROUP BY ALL"""
)
def a19_failure_tally(t):
    """A-19: failures by code and by the code's first two parts."""
    codes = t("lineitem").select(F.concat_ws(":", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("code"))
    return failure_tally(codes, "code")


@query(
    """SELECT field, CASE WHEN v IS NULL THEN 'NOT_FOUND' WHEN v = '' THEN 'EMPTY' ELSE 'FOUND' END AS status, count(*) AS n FROM (SELECT unnest(['text', 'lang', 'source']) AS field, unnest([text, lang, nullif(source, 'src0')]) AS v FROM documents) GROUP BY ALL"""
)
def a20_field_status_audit(t):
    """A-20: how often each field was found."""
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("text"), F.lit("lang"), F.lit("source")), F.array("text", "lang", F.nullif(F.col("source"), F.lit("src0"))))).alias("field", "v")
    status = F.when(F.col("v").isNull(), "NOT_FOUND").when(F.col("v") == "", "EMPTY").otherwise("FOUND")
    return t("documents").select(pairs).groupBy("field", status.alias("status")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_discount > 0.09)::INT AS anomalous FROM lineitem ORDER BY anomalous DESC, abs(l_extendedprice) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40"""
)
def a22_anomalies_first(t):
    """A-22: a sample of forty, anomalies first (the documented intent; see the README for the reversed order)."""
    rows = t("lineitem").withColumn("anomalous", (F.col("l_discount") > 0.09).cast("int"))
    order = [F.desc("anomalous"), F.desc(F.abs("l_extendedprice")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.orderBy(*order).limit(40).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "anomalous")


@query(
    """WITH r AS (SELECT o_custkey, avg((o_orderstatus IS NOT DISTINCT FROM m)::INT) AS same FROM orders JOIN (SELECT o_custkey, mode(o_orderstatus ORDER BY o_orderstatus) AS x, min(o_orderstatus) AS m FROM orders GROUP BY ALL) USING (o_custkey) GROUP BY ALL)
SELECT round(avg(same), 4) AS rate, count(*) FILTER (same < 1) AS n_violations, avg(same) >= 0.5 AS passed FROM r"""
)
def a23_reproducibility(t):
    """A-23: the share of rows that agree with their group's first, and a threshold on its mean."""
    least = t("orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("m"))
    same = t("orders").join(least, "o_custkey").groupBy("o_custkey").agg(F.avg(F.col("o_orderstatus").eqNullSafe(F.col("m")).cast("int")).alias("same"))
    return same.agg(F.round(F.avg("same"), 4).alias("rate"), F.sum((F.col("same") < 1).cast("long")).alias("n_violations"), (F.avg("same") >= 0.5).alias("passed"))


@query(
    """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_totalprice, o_orderkey) AS price, count(DISTINCT (o_orderstatus, o_orderpriority)) > 1 AS conflict FROM orders GROUP BY ALL"""
)
def a24_first_row_wins(t):
    """A-24, X-19: the first whole row of a key stays; different values are a conflict."""
    out = t("orders").groupBy("o_custkey").agg(
        F.min_by(F.struct("o_orderstatus", "o_totalprice"), "o_orderkey").alias("x"), (F.countDistinct("o_orderstatus", "o_orderpriority") > 1).alias("conflict")
    )
    return out.select("o_custkey", F.col("x.o_orderstatus").alias("status"), F.col("x.o_totalprice").alias("price"), "conflict")


@query(
    """SELECT name, min(place) AS place FROM (SELECT p_name AS name, 0 AS place FROM part UNION ALL SELECT s_name, 1 FROM supplier UNION ALL SELECT p_brand, 2 FROM part) GROUP BY ALL"""
)
def a25_union_of_names(t):
    """A-25, U-01, U-04: names of several sources, the first source that has one."""
    part, supplier = t("part"), t("supplier")
    rows = part.select(F.col("p_name").alias("name"), F.lit(0).alias("place")).unionByName(supplier.select(F.col("s_name").alias("name"), F.lit(1).alias("place")))
    return rows.unionByName(part.select(F.col("p_brand").alias("name"), F.lit(2).alias("place"))).groupBy("name").agg(F.min("place").alias("place"))


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem l WHERE NOT (l_returnflag = 'A' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'A')) GROUP BY ALL"""
)
def a27_aggregates_give_way(t):
    """A-27: document-level rows go where class-level rows exist; a flag over the group, no self join."""
    w = Window.partitionBy("l_orderkey")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("own", F.max((F.col("l_returnflag") != "A").cast("int")).over(w))
    return rows.where(~((F.col("l_returnflag") == "A") & (F.col("own") == 1))).groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id, CAST(least(40, 10 * count(*)) + CASE WHEN max(value) > 50 THEN 25 ELSE 0 END + CASE WHEN count(DISTINCT event_type) >= 3 THEN 20 ELSE 0 END AS BIGINT) AS score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM events GROUP BY ALL"""
)
def a29_confidence_score(t):
    """A-29, E-49: additive points and levels."""
    points = F.least(F.lit(40), 10 * F.count("*")) + F.when(F.max("value") > 50, 25).otherwise(0) + F.when(F.countDistinct("event_type") >= 3, 20).otherwise(0)
    out = t("events").groupBy("user_id").agg(points.cast("long").alias("score"))
    return out.select("user_id", "score", F.when(F.col("score") >= 70, "HIGH").when(F.col("score") >= 45, "MEDIUM").otherwise("LOW").alias("level"))


@query(
    """WITH d AS (SELECT o_custkey, CAST(date_diff('month', TIMESTAMP '1990-01-01', o_orderdate) AS INTEGER) AS m FROM orders), c AS (SELECT o_custkey, m, count(*) AS n FROM d GROUP BY ALL),
 w AS (SELECT o_custkey, m, sum(n) OVER (PARTITION BY o_custkey ORDER BY m RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS pair FROM c)
SELECT o_custkey, m AS start_month, CAST(pair AS BIGINT) AS n FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pair DESC, m) = 1"""
)
def a30_richest_window(t):
    """A-30: the two-month window with the most rows, the earliest on ties."""
    month = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("int")
    c = t("orders").groupBy("o_custkey", month.alias("m")).agg(F.count("*").alias("n"))
    both = c.withColumn("both", F.sum("n").over(Window.partitionBy("o_custkey").orderBy("m").rangeBetween(0, 1)))
    best = both.groupBy("o_custkey").agg(F.max_by(F.struct("m", "both"), F.struct("both", -F.col("m"))).alias("x"))
    return best.select("o_custkey", F.col("x.m").alias("start_month"), F.col("x.both").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(*) FILTER (event_type = 'error') AS n_errors, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2) AS rate FROM events")
def a31_totals(t):
    """A-31, A-32: totals in one aggregation."""
    return t("events").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.sum(F.col("value").isNull().cast("long")).alias("n_missing"), F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 2).alias("rate"),
    )


@query("SELECT * FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders)")
def s14_table_counts(t):
    """S-14: rows of each table; every count is read from the footers."""
    out = None
    for name in ("region", "nation", "supplier", "part", "orders"):
        one = t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT l_orderkey, CAST(greatest(0, least(2, sum((l_returnflag = 'R')::INT))) + greatest(0, least(2, sum((l_linestatus = 'O')::INT))) + greatest(0, least(2, count(*) - 1)) AS BIGINT) AS total, bool_or(l_tax > 0.079) AS hard_fail, NOT hard_fail AND total >= 4 AS passed FROM lineitem GROUP BY ALL"""
)
def a34_rubric(t):
    """A-34: clamped dimensions, a total, and hard failures."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(2), x))
    total = clamp(F.sum((F.col("l_returnflag") == "R").cast("long"))) + clamp(F.sum((F.col("l_linestatus") == "O").cast("long"))) + clamp(F.count("*") - 1)
    out = t("lineitem").groupBy("l_orderkey").agg(total.cast("long").alias("total"), F.bool_or(F.col("l_tax") > 0.079).alias("hard_fail"))
    return out.withColumn("passed", ~F.col("hard_fail") & (F.col("total") >= 4))
