"""Catalog queries: parts stand for share classes, line items for their fee facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions import rules, text
from factloom.operators.selection import by_precedence, first_per, latest_version, preferred_fact, stage_counts
from factloom.plans.catalog_search import FEE_PRECEDENCE, catalog, search
from factloom.queries.base import query


def classes(t):
    return t("part").select(
        F.col("p_partkey").alias("record_id"), F.col("p_name").alias("class_name"), F.col("p_brand").alias("product_name"), F.col("p_type").alias("kind"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 6 + 1).alias("risk_grade"), F.when(F.col("p_size") % 7 != 0, F.col("p_type").isin("ECONOMY", "PROMO")).alias("is_online"),
    )


def fees(t):
    ordinal = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")
    return t("lineitem").select(F.col("l_partkey").alias("record_id"), F.col("l_returnflag").alias("fee_type"), F.col("l_tax").alias("rate"), F.col("l_shipdate").alias("as_of"), ordinal.alias("ordinal"))


def records(t):
    return catalog(classes(t), fees(t))


CATALOG = """
WITH fees AS (
  SELECT l_partkey AS record_id, l_tax AS total_fee FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END,
    l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax) = 1
), n AS (SELECT l_partkey AS record_id, count(*) AS n_fees FROM lineitem GROUP BY ALL
), base AS (
  SELECT p_partkey AS record_id, p_name AS class_name, p_brand AS product_name, p_type AS kind, CASE WHEN p_size % 10 <> 0 THEN p_size % 6 + 1 END AS risk_grade,
         CASE WHEN p_size % 7 <> 0 THEN p_type IN ('ECONOMY', 'PROMO') END AS is_online FROM part
), records AS (
  SELECT base.*, total_fee, n_fees, CASE risk_grade WHEN 1 THEN 'VERY_AGGRESSIVE' WHEN 2 THEN 'AGGRESSIVE' WHEN 3 THEN 'MODERATE_AGGRESSIVE' WHEN 4 THEN 'MODERATE'
    WHEN 5 THEN 'CONSERVATIVE' WHEN 6 THEN 'VERY_CONSERVATIVE' END AS risk_bucket
  FROM base LEFT JOIN fees USING (record_id) LEFT JOIN n USING (record_id)
)
"""


@query(CATALOG + "SELECT * FROM records")
def a02_catalog_records(t):
    """A-02, A-03, J-01: classes with the preferred fee of each."""
    return records(t)


@query(
    CATALOG
    + """, hit AS (SELECT * FROM records WHERE risk_grade <= 4 AND coalesce(is_online, false) AND total_fee IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY total_fee, class_name, record_id) = 1)
SELECT record_id, product_name, class_name, total_fee, risk_grade FROM hit ORDER BY total_fee, product_name, class_name, record_id LIMIT 10"""
)
def t01_catalog_search_by_fee(t):
    """T-01, F-03, F-05, F-06, W-03, T-03: the flagship search, cheapest classes first, one per product."""
    return search(records(t), grade_max=4, online=True, sort_by="total_fee", limit=25).select("record_id", "product_name", "class_name", "total_fee", "risk_grade")


@query(
    CATALOG
    + """, hit AS (SELECT * FROM records WHERE total_fee IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY total_fee, class_name, record_id) = 1)
SELECT record_id, product_name, class_name, total_fee FROM hit ORDER BY total_fee DESC, product_name DESC, class_name DESC, record_id DESC LIMIT 5"""
)
def t01_catalog_search_by_fee_descending(t):
    """T-01: a descending sort also turns its tie-breaks."""
    return search(records(t), sort_by="total_fee", descending=True).select("record_id", "product_name", "class_name", "total_fee")


@query(
    CATALOG
    + """, hit AS (SELECT * FROM records WHERE risk_bucket IN ('MODERATE', 'CONSERVATIVE', 'MODERATE_AGGRESSIVE')
  QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY class_name, record_id) = 1)
SELECT record_id, product_name, risk_bucket FROM hit ORDER BY product_name, class_name, record_id LIMIT 10"""
)
def f04_tolerance_search(t):
    """F-04, T-02: allowed buckets of a tolerance; unknown buckets stay out."""
    return search(records(t), tolerance="moderate", limit=10).select("record_id", "product_name", "risk_bucket")


@query(CATALOG + "SELECT record_id, total_fee FROM records WHERE record_id IN (1, 5, 8, 13, 21, 34)")
def f01_scope_filter(t):
    """F-01: a candidate scope; it reaches the scan of both tables."""
    ids = [1, 5, 8, 13, 21, 34]
    own = fees(t).where(F.col("record_id").isin(ids))
    return catalog(classes(t).where(F.col("record_id").isin(ids)), own).select("record_id", "total_fee")


@query(
    CATALOG
    + """SELECT count(*) AS n_input, CAST(sum(CASE WHEN risk_grade <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS after_grade,
  CAST(sum(CASE WHEN risk_grade <= 3 AND coalesce(is_online, false) THEN 1 ELSE 0 END) AS BIGINT) AS after_online,
  CAST(sum(CASE WHEN risk_grade <= 3 AND coalesce(is_online, false) AND total_fee IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS after_fee FROM records"""
)
def f07_stage_trace(t):
    """F-07: rows left after every filter, in one pass."""
    return stage_counts(records(t), {"after_grade": F.col("risk_grade") <= 3, "after_online": F.col("is_online"), "after_fee": F.col("total_fee").isNotNull()})


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n_versions,
  string_agg(o_orderkey, ',') OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS versions
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"""
)
def a01_latest_version(t):
    """A-01: the latest order of each customer with all versions, newest first."""
    out = latest_version(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "n_versions", F.concat_ws(",", F.transform("versions", lambda x: x.cast("string"))).alias("versions"))


@query("SELECT l_partkey, max(l_shipdate) AS as_of, arg_max(l_discount, (l_shipdate, -l_orderkey, -l_linenumber, -l_suppkey, -l_extendedprice)) AS value FROM lineitem WHERE upper(l_returnflag) = 'A' AND lower(l_linestatus) = 'o' GROUP BY ALL")
def a04_latest_performance(t):
    """A-04: the latest value of one metric and period, compared without case; ties to the first."""
    own = t("lineitem").where((F.upper("l_returnflag") == "A") & (F.lower("l_linestatus") == "o"))
    order = F.struct("l_shipdate", -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_suppkey"), -F.col("l_extendedprice"))
    return own.groupBy("l_partkey").agg(F.max("l_shipdate").alias("as_of"), F.max_by("l_discount", order).alias("value"))


@query(
    """SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY p) AS flags FROM (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_partkey, l_suppkey)) AS p FROM lineitem GROUP BY ALL)
  GROUP BY ALL"""
)
def a05_ordered_distinct(t):
    """A-05, U-01: distinct values in the order of their first occurrence."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    first = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min(place).alias("p"))
    inorder = F.array_sort(F.collect_list(F.struct("p", "l_returnflag")))
    return first.groupBy("l_orderkey").agg(F.concat_ws(",", F.transform(inorder, lambda x: x["l_returnflag"])).alias("flags"))


@query(
    CATALOG
    + """SELECT record_id, product_name, total_fee,
  CASE WHEN total_fee IS NOT NULL THEN row_number() OVER (PARTITION BY kind, total_fee IS NULL ORDER BY total_fee, record_id) END AS fee_rank,
  CASE WHEN risk_grade IS NOT NULL THEN row_number() OVER (PARTITION BY kind, risk_grade IS NULL ORDER BY risk_grade DESC, record_id) END AS grade_rank FROM records"""
)
def w02_fee_and_grade_ranks(t):
    """W-02: positions among rows that have the value; null where there is none."""
    r = records(t)

    def rank(c, order):
        w = Window.partitionBy("kind", F.col(c).isNull()).orderBy(order, "record_id")
        return F.when(F.col(c).isNotNull(), F.row_number().over(w).cast("long"))

    return r.select("record_id", "product_name", "total_fee", rank("total_fee", F.col("total_fee")).alias("fee_rank"), rank("risk_grade", F.col("risk_grade").desc()).alias("grade_rank"))


@query(
    CATALOG
    + """SELECT record_id, product_name, CAST(CASE WHEN risk_bucket IN ('CONSERVATIVE', 'VERY_CONSERVATIVE') THEN 2 WHEN risk_bucket = 'MODERATE' THEN 1 ELSE 0 END AS INTEGER) AS risk_match,
  CAST((risk_grade IS NOT NULL)::INT + (total_fee IS NOT NULL)::INT + (is_online IS NOT NULL)::INT + coalesce(n_fees > 20, false)::INT AS INTEGER) AS evidence_score
  FROM records ORDER BY risk_match DESC, coalesce(total_fee, 1e9), evidence_score DESC, product_name, record_id LIMIT 50"""
)
def w04_recommendation_order(t):
    """W-04, C-13, C-14: risk match, fee, evidence, name."""
    r = records(t).withColumn("risk_match", rules.risk_match(F.col("risk_bucket"), "conservative"))
    r = r.withColumn("evidence_score", rules.evidence_score(F.col("risk_grade").isNotNull(), F.col("total_fee").isNotNull(), F.col("is_online").isNotNull(), F.col("n_fees") > 20))
    order = [F.desc("risk_match"), F.coalesce("total_fee", F.lit(1e9)), F.desc("evidence_score"), "product_name", "record_id"]
    return r.orderBy(*order).limit(50).select("record_id", "product_name", "risk_match", "evidence_score")


@query(
    CATALOG
    + """SELECT record_id, CASE WHEN n_fees IS NULL THEN 2 WHEN n_fees > 25 THEN 0 ELSE 1 END AS status_rank, total_fee FROM records
  ORDER BY status_rank, total_fee DESC NULLS LAST, product_name, class_name, record_id LIMIT 40"""
)
def w05_verified_first(t):
    """W-05: verified rows first, then the value; the direction does not turn the names."""
    r = records(t).withColumn("status_rank", F.when(F.col("n_fees").isNull(), 2).when(F.col("n_fees") > 25, 0).otherwise(1))
    return r.orderBy("status_rank", F.desc_nulls_last("total_fee"), "product_name", "class_name", "record_id").limit(40).select("record_id", "status_rank", "total_fee")


@query(
    """SELECT p_partkey, p_name FROM part WHERE (contains(regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g'), 'red') OR contains(regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g'), 'blue'))
  AND contains(regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g'), 'bolt')"""
)
def f08_name_constraints(t):
    """F-08: any of the aliases and all of the tokens in the folded name."""
    name = text.fold(F.col("p_name"))
    aliases, needed = F.array(F.lit("red"), F.lit("blue")), F.array(F.lit("bolt"))
    hit = F.exists(aliases, lambda a: F.contains(name, a)) & F.forall(needed, lambda a: F.contains(name, a))
    return t("part").where(hit).select("p_partkey", "p_name")


@query(
    """SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') AND NOT contains(p_type, 'ECONOMYX') THEN 'ultra_short' WHEN contains(p_type, 'PROMO') THEN 'mid' WHEN contains(p_type, 'SMALL') THEN 'short'
  WHEN contains(p_type, 'LARGE') THEN 'long' END AS tenor FROM part"""
)
def f09_tenor(t):
    """F-09: exclusive substrings in order of length."""
    has = lambda s: F.contains(F.col("p_type"), F.lit(s))
    tenor = F.when(has("ECONOMY") & ~has("ECONOMYX"), "ultra_short").when(has("PROMO"), "mid").when(has("SMALL"), "short").when(has("LARGE"), "long")
    return t("part").select("p_partkey", tenor.alias("tenor"))


@query(
    """WITH q AS (SELECT event_id, 'compare ' || CASE event_id % 3 WHEN 0 THEN 'Brand#' || (1 + event_id % 25) WHEN 1 THEN 'brand' ELSE 'nothing' END || ' fees' AS question FROM events),
 exact AS (SELECT q.event_id, b.p_brand FROM q JOIN (SELECT DISTINCT p_brand FROM part) b
   ON contains(' ' || regexp_replace(lower(question), '[^0-9a-z ]+', '', 'g') || ' ', ' ' || regexp_replace(lower(p_brand), '[^0-9a-z]+', '', 'g') || ' '))
SELECT q.event_id, CASE WHEN e.p_brand IS NOT NULL THEN 'EXACT' WHEN contains(lower(question), 'brand') THEN 'FAMILY' ELSE 'NONE' END AS resolution, e.p_brand FROM q LEFT JOIN exact e USING (event_id)"""
)
def f10_identity_resolution(t):
    """F-10, J-19: an exact name in the question, else the family, else nothing; never another product.

    Words of the question are exploded and joined by equality, so names are not tried one by one.
    """
    k = F.col("event_id") % 3
    question = F.concat(F.lit("compare "), F.when(k == 0, F.concat(F.lit("Brand#"), (1 + F.col("event_id") % 25).cast("string"))).when(k == 1, "brand").otherwise("nothing"), F.lit(" fees"))
    q = t("events").select("event_id", question.alias("question"))
    words = q.select("event_id", F.explode(F.split(F.regexp_replace(F.lower("question"), "[^0-9a-z ]+", ""), " ")).alias("word"))
    brands = t("part").select("p_brand").distinct().withColumn("word", text.fold(F.col("p_brand")))
    exact = words.join(brands, "word").select("event_id", "p_brand").distinct()
    how = F.when(F.col("p_brand").isNotNull(), "EXACT").when(F.contains(F.lower("question"), F.lit("brand")), "FAMILY").otherwise("NONE")
    return q.join(exact, "event_id", "left").select("event_id", how.alias("resolution"), "p_brand")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_tax >= 0.08) AND l_quantity IS NOT NULL"""
)
def f14_drop_examples(t):
    """F-14, F-15: example fees and empty rows are dropped; both filters reach the scan."""
    kept = t("lineitem").where(~((F.col("l_returnflag") == "A") & (F.col("l_tax") >= 0.08)) & F.col("l_quantity").isNotNull())
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    """SELECT l_partkey, CAST(round(100 * l_tax) AS INTEGER) AS value, l_returnflag FROM lineitem WHERE l_partkey % 5 IN (0, 1, 2, 3, 4)
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax) = 1"""
)
def a26_fee_dedup(t):
    """A-26: one fee per class by a given precedence of types."""
    one = preferred_fact(t("lineitem"), ["l_partkey"], "l_returnflag", ["N", "R"], "l_shipdate", [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")])
    return one.select("l_partkey", F.round(100 * F.col("l_tax")).cast("int").alias("value"), "l_returnflag")


@query(
    """SELECT p_partkey, p_brand, CASE WHEN n > 1 THEN p_brand || '__' || n ELSE p_brand END AS class_key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"""
)
def w12_key_suffix(t):
    """W-12: the second and later uses of a key get a number."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = t("part").select("p_partkey", "p_brand", n.alias("n"))
    return rows.select("p_partkey", "p_brand", F.when(F.col("n") > 1, F.concat_ws("__", "p_brand", F.col("n").cast("string"))).otherwise(F.col("p_brand")).alias("class_key"))


__all__ = ["FEE_PRECEDENCE", "by_precedence", "first_per"]
