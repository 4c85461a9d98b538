"""Values as readers see them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import display as D
from factloom.queries.base import query

UNITS = ["percent_per_year", " PERCENT", "krw", "Basis_Point", "DECIMAL", "shares"]


@query(
    r"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, nullif(l_discount * 100, 0) AS value, l_returnflag = 'R' AS doubtful, regexp_replace(printf('%.6f', l_discount * 100), '\.?0+$', '') AS number FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN value IS NULL THEN '확인된 값 없음' WHEN doubtful THEN '수익률 값의 단위/스케일 확인이 필요합니다' ELSE
CASE l_linenumber WHEN 1 THEN '연 ' || number || '%' WHEN 2 THEN number || '%' WHEN 3 THEN number || '원' WHEN 4 THEN number || 'bp' WHEN 5 THEN number || ' (소수, 단위 확인 필요)' ELSE number || ' (단위 확인 필요)' END END AS shown FROM v"""
)
def e37_shown_values(t):
    """E-37: stored numbers as readers see them, by unit and status; no unit from the seventh line of an order on."""
    unit = F.get(F.array(*map(F.lit, UNITS)), F.col("l_linenumber").cast("int") - 1)
    status = F.when(F.col("l_returnflag") == "R", "SOURCE_CONFLICT").when(F.col("l_returnflag") == "A", "VERIFIED")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.shown_value(F.nullif(F.col("l_discount") * 100, F.lit(0.0)), unit, status).alias("shown"))
