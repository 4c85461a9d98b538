"""Values as readers see them."""

from pyspark.sql import functions as F

from factloom.functions import display as D


def test_units_and_states(spark):
    rows = [
        (None, "KRW", None, "확인된 값 없음"), (None, None, "UNVERIFIED", "확인된 값 없음"), (1.5, "PERCENT", "UNIT_MISSING", "수익률 값의 단위/스케일 확인이 필요합니다"), (1.5, " percent_per_year ", None, "연 1.5%"),
        (0.25, "PERCENT_PER_MONTH", "VERIFIED", "월 0.25%"), (1000000.0, "won", "", "1000000원"), (10.0, "bp", None, "10bp"), (-0.5, "DECIMAL", None, "-0.5 (소수, 단위 확인 필요)"), (0.0, "PERCENT", None, "0%"),
        (7.0, "", None, "7 (단위 확인 필요)"), (7.1234567, None, None, "7.123457 (단위 확인 필요)"), (7.0, "shares", None, "7 (단위 확인 필요)"),
    ]
    got = spark.createDataFrame(rows, "v double, u string, s string, want string").select(D.shown_value(F.col("v"), F.col("u"), F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
