"""Rule and calculation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.queries.base import query

POLICY = {"limit": 250_000, "rate": 0.12, "low_rate": 0.15, "surcharge": 0.10, "threshold": 2000, "ratio": 0.10, "cap": 20_000}


def dec(x):
    return F.lit(x).cast("decimal(18,6)")


@query(
    """SELECT o_orderkey, CAST(greatest(0, 200000 - CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS gap FROM orders"""
)
def c01_income_gap(t):
    """C-01: what is missing to a target, never below zero."""
    return t("orders").select("o_orderkey", rules.income_gap(F.lit(200_000), F.col("o_totalprice")).cast("decimal(18,2)").alias("gap"))


CREDIT = """SELECT o_orderkey, o_totalprice, c_acctbal, CASE WHEN c_acctbal <= 2000 THEN 'lower_income' ELSE 'standard' END AS band,
  CAST(CASE WHEN c_acctbal <= 2000 THEN 0.1650 ELSE 0.1320 END AS DECIMAL(12,4)) AS effective_rate,
  CAST(round(least(CAST(o_totalprice AS DECIMAL(18,2)), 250000) * CASE WHEN c_acctbal <= 2000 THEN CAST(0.1650 AS DECIMAL(12,4)) ELSE CAST(0.1320 AS DECIMAL(12,4)) END, 0) AS DECIMAL(20,0)) AS credit
FROM orders JOIN customer ON c_custkey = o_custkey"""


def credits(t):
    wide = t("orders").join(t("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    low = F.col("c_acctbal") <= POLICY["threshold"]
    rate = F.when(low, dec(POLICY["low_rate"])).otherwise(dec(POLICY["rate"]))
    return wide.select(
        "o_orderkey", "o_totalprice", "c_acctbal", F.when(low, "lower_income").otherwise("standard").alias("band"), rules.effective_rate(rate, dec(POLICY["surcharge"])).alias("effective_rate"),
        rules.tax_credit(F.col("o_totalprice"), F.lit(POLICY["limit"]), rate, dec(POLICY["surcharge"])).alias("credit"),
    )


@query(CREDIT)
def c02_tax_credit(t):
    """C-02: base below a limit, rate by income band, surcharge, half-even rate and half-up amount."""
    return credits(t)


@query(
    f"""SELECT band, count(*) AS n, sum(credit) AS total, max(credit) AS most FROM ({CREDIT}) GROUP BY ALL"""
)
def c03_credit_summary(t):
    """C-03: what each band sums up to."""
    return credits(t).groupBy("band").agg(F.count("*").alias("n"), F.sum("credit").alias("total"), F.max("credit").alias("most"))


@query(
    """SELECT o_orderkey, CAST(round(least(CAST(o_totalprice AS DECIMAL(18,2)) * 0.1, 20000), 0) AS DECIMAL(20,0)) AS extra, CAST(least(CAST(o_totalprice AS DECIMAL(18,2)), 250000) AS DECIMAL(18,2)) AS allowed FROM orders"""
)
def c04_transfer_extra(t):
    """C-04, C-05: a share of a transfer up to a cap; contributions up to a limit."""
    return t("orders").select(
        "o_orderkey", rules.transfer_extra(F.col("o_totalprice"), dec(POLICY["ratio"]), F.lit(POLICY["cap"])).alias("extra"),
        F.least(rules.money(F.col("o_totalprice")), rules.money(F.lit(POLICY["limit"]))).cast("decimal(18,2)").alias("allowed"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'CLARIFY' WHEN year(o_orderdate) < 1996 THEN 'UNSUPPORTED_POLICY_VERSION' WHEN o_totalprice - 50000 < 0 THEN 'INVALID_INPUT' ELSE 'OK' END AS status FROM orders"""
)
def c06_calculation_status(t):
    """C-06: outcomes as a column, in order of precedence."""
    policy = F.when(F.year("o_orderdate") >= 1996, F.lit(1))
    return t("orders").select("o_orderkey", rules.calculation_status([F.nullif(F.col("o_orderstatus"), F.lit("P"))], [F.col("o_totalprice") - 50_000], policy).alias("status"))


@query(
    f"""SELECT o_orderkey, credit = CAST(round(CAST(CASE WHEN o_totalprice > 250000 THEN 250000 ELSE o_totalprice END AS DECIMAL(18,2)) * (CASE WHEN band = 'standard' THEN CAST(0.132 AS DECIMAL(6,4)) ELSE CAST(0.165 AS DECIMAL(6,4)) END), 0) AS DECIMAL(20,0)) AS agrees FROM ({CREDIT})"""
)
def c08_recomputed(t):
    """C-08: an independent second computation, compared row by row."""
    base = F.when(F.col("o_totalprice") > POLICY["limit"], F.lit(POLICY["limit"]).cast("double")).otherwise(F.col("o_totalprice")).cast("decimal(18,2)")
    rate = F.when(F.col("band") == "standard", dec("0.132")).otherwise(dec("0.165")).cast("decimal(6,4)")
    return credits(t).select("o_orderkey", (F.col("credit") == F.round(base * rate, 0).cast("decimal(20,0)")).alias("agrees"))


STATEMENTS = "CASE event_id % 5 WHEN 0 THEN 'IRP 가입 가능' WHEN 1 THEN 'IRP 가입 불가' WHEN 2 THEN '퇴직연금 클래스' WHEN 3 THEN 'IRP 전용. 하지만 IRP 가입 불가' ELSE '개인형 퇴직연금 가입 대상' END"
TYPES = "CASE event_id % 7 WHEN 0 THEN 'DB형 가입자 전용' WHEN 1 THEN '개인형 퇴직연금' WHEN 2 THEN '개인퇴직계좌' WHEN 3 THEN 'C-P2e' END"


@query(
    f"""WITH e AS (SELECT event_id, event_type = 'signup' AS coded, {STATEMENTS} AS s FROM events),
 v AS (SELECT event_id, coded OR event_id % 5 IN (0, 3, 4) OR event_id % 7 IN (1, 2) AS yes, event_id % 5 IN (1, 3) OR event_id % 7 = 0 AS no FROM e)
SELECT event_id, CASE WHEN yes AND NOT no THEN 'ELIGIBLE' WHEN no AND NOT yes THEN 'INELIGIBLE' ELSE 'UNRESOLVED' END AS status FROM v"""
)
def c10_eligibility(t):
    """C-10, F-02: explicit affirmation or denial; a conflict stays unresolved."""
    codes = F.when(F.col("event_type") == "signup", F.array(F.lit("irp ")))
    return t("events").select("event_id", rules.eligibility(codes, F.expr(STATEMENTS), types=(F.expr(TYPES),)).alias("status"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax IS NULL THEN 'UNIT_MISSING' WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 'SOURCE_CONFLICT' WHEN abs(l_extendedprice) > 99000 THEN 'SCALE_MISMATCH' WHEN l_linestatus = 'F' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status FROM lineitem"""
)
def c11_value_audit(t):
    """C-11: the state of a value by the first rule that applies."""
    status = (
        F.when(F.col("l_tax").isNull(), "UNIT_MISSING").when((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07), "SOURCE_CONFLICT")
        .when(F.abs("l_extendedprice") > 99_000, "SCALE_MISMATCH").when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("UNVERIFIED")
    )
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))


@query(
    """SELECT user_id, CASE WHEN bool_and(event_type IN ('view', 'click', 'purchase', 'signup')) THEN array_to_string(list_sort(list(DISTINCT upper(event_type))), ',') END AS kinds FROM events GROUP BY ALL"""
)
def c12_normalised_kinds(t):
    """C-12: every value must be known, else nothing."""
    out = t("events").groupBy("user_id").agg(F.bool_and(F.col("event_type").isin("view", "click", "purchase", "signup")).alias("ok"), F.array_sort(F.collect_set(F.upper("event_type"))).alias("k"))
    return out.select("user_id", F.when(F.col("ok"), F.concat_ws(",", "k")).alias("kinds"))


QUESTION = "'위험등급 ' || (1 + event_id % 6) || '등급 ' || CASE event_id % 4 WHEN 0 THEN '이하' WHEN 1 THEN '미만' WHEN 2 THEN '이상' ELSE '초과' END || ' 상품 ' || (event_id % 14) || '개 ' || CASE event_id % 3 WHEN 0 THEN '보수 낮은 순' WHEN 1 THEN '수수료 비싼 순' ELSE '' END"


@query(
    f"""WITH q AS (SELECT event_id, {QUESTION} AS question, 1 + event_id % 6 AS g, event_id % 4 AS k, event_id % 3 AS f, event_id % 14 AS n FROM events)
SELECT event_id, CAST(CASE WHEN k = 0 THEN g WHEN k = 1 AND g > 1 THEN g - 1 END AS INTEGER) AS grade_max, CAST(CASE WHEN k = 2 THEN g WHEN k = 3 THEN g + 1 END AS INTEGER) AS grade_min, CAST(least(10, greatest(1, n)) AS INTEGER) AS lim,
  n NOT BETWEEN 1 AND 10 AS clamped, CASE f WHEN 0 THEN 'total_fee' WHEN 1 THEN 'total_fee' ELSE 'product_name' END AS sort_by, CASE f WHEN 1 THEN 'desc' ELSE 'asc' END AS sort_order FROM q"""
)
def c15_question_to_spec(t):
    """C-15, T-03: a question's grade limits, number of rows and fee order."""
    q = F.col("question")
    grade = F.regexp_extract(q, r"(\d+)\s*등급", 1).try_cast("int")
    word = F.regexp_extract(q, r"\d+\s*등급\s*(이하|이내|까지|미만|이상|초과)", 1)
    n = F.regexp_extract(q, r"(\d+)\s*(?:개|종)", 1).try_cast("int")
    fee = q.rlike("총보수|총비용|보수|수수료")
    asc, desc = fee & q.rlike(r"(낮은|적은|저렴한)\s*순|(?<!비)싼\s*순|오름차순"), fee & q.rlike(r"(높은|많은|비싼)\s*순|내림차순")
    top = F.when(word == "미만", F.when(grade > 1, grade - 1)).when(word.isin("이상", "초과"), None).otherwise(grade)
    low = F.when(word == "이상", grade).when(word == "초과", grade + 1)
    s = t("events").select("event_id", F.expr(QUESTION).alias("question"))
    return s.select(
        "event_id", top.alias("grade_max"), low.alias("grade_min"), F.least(F.lit(10), F.greatest(F.lit(1), n)).alias("lim"), (~n.between(1, 10)).alias("clamped"),
        F.when((asc | desc) & ~(asc & desc), "total_fee").otherwise("product_name").alias("sort_by"), F.when(desc & ~asc, "desc").otherwise("asc").alias("sort_order"),
    )
