"""Tables: rows of fees, performance and risks by hand, columns' roles by all assignments."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.operators import tables as T


def table(spark, rows, f, kind="array<string>"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


FEES = [
    (["수수료선취-온라인(Ae)", "납입금액의 1.0% 이내", "0.55", "0.30", "0.6", "1,807", "107", "326"], ("수수료선취-온라인(Ae)", "납입금액의 1.0% 이내", "0.55", "0.30", "0.6", "1.807")),
    (["종류A", "-", "0.1", "0.2", "0.3", "1,807,000"], ("종류A", "-", "0.1", "0.2", "", "0.3")),
    (["종류A", "없음", "0.1", "0.2", "1,807", "0.3"], None),  # two rates, then money
    (["구분", "수수료미징구", "-온라인 (S)", "0.1", "0.2", "0.3", "0.4", "0.5"], ("수수료미징구-온라인(S)", "", "0.1", "0.2", "0.3", "0.4")),
    (["종류A", "2025.01.03", "0.1", "0.2", "0.3"], None),
    (["비교지수", "0.1", "0.2", "0.3"], None),
    (["투자신탁", "", None, "0.1", " 0.2 ", "0.3"], ("투자신탁", "", "0.1", "0.2", "", "0.3")),
    (["not a class", "0.1", "0.2", "0.3"], None),
    (["x" * 90, "종류C1", "해당 없음", "0.1", "0.2", "0.3"], ("종류C1", "해당 없음", "0.1", "0.2", "", "0.3")),
    ([], None), (None, None), (["", None], None), (["종류A", "-", "a", "0.1", "b", "0.2"], None),
]


def test_fee_rows(spark):
    got = table(spark, [c for c, _ in FEES], T.fee_row)
    assert [tuple(x) if x else None for x in got] == [w for _, w in FEES]


PERFORMANCE = [
    (["종류A", "25.1.3", "1.0", "-", "3.0"], ("종류A", "2025-1-3", ["1.0", "", "3.0", "", ""])),
    (["비교지수", "", "1", "2", "3", "4", "5", "6", ""], ("비교지수", "", ["1", "2", "3", "4", "5"])),
    (["투자실적추이", "수익률 변동성", "1.5", "", "2"], ("수익률 변동성", "", ["1.5", "", "2", "", ""])),
    (["투자실적추이", "anything", "1.5"], None), (["2024.01.01", "종류A", "1.0"], None), (["종류A", "-", "1.0"], None),
    (["종류A", "납입금액의 1% 이내", "1.0"], None), (["Ae", "수수료선취-온라인(Ae)", "2020/01/02", "1,234.5"], ("수수료선취-온라인(Ae)", "2020-01-02", ["1234.5", "", "", "", ""])),
    (["연평균수익률", "2020.01.02", "1.0"], None), (["plain", "text", "1.0"], None), (["펀드", "1.0", "–", "2.0"], ("펀드", "", ["1.0", "", "2.0", "", ""])),
    ([], None), (None, None), ([None, ""], None),
]


def test_performance_rows(spark):
    got = table(spark, [c for c, _ in PERFORMANCE], T.performance_row)
    assert [(x.subject, x.inception, x.rates) if x else None for x in got] == [w for _, w in PERFORMANCE]


def test_wrapped_rows(spark):
    rows = [
        [["수수료선취-", "0.1"], ["온라인(Ae)"], ["", None], ["종류A", "0.2"]],
        [["수수료미징구", "0.1"], ["-온라인(S)", "0.2", "0.3"], ["수수료후취(C)", "1"], ["온라인", "2"]],
        [["온라인"], ["a"]], [], [["x"]],
    ]
    assert table(spark, rows, T.unwrapped, "array<array<string>>") == [
        [["수수료선취-온라인(Ae)", "0.1"], ["종류A", "0.2"]], [["수수료미징구-온라인(S)", "0.1", "0.2", "0.3"], ["수수료후취(C)", "1"], ["온라인", "2"]], [["온라인"], ["a"]], [], [["x"]],
    ]


def test_risks_of_a_table(spark):
    head = ["구분", "투자위험의 주요내용"]
    rows = [
        [["예시", ""], head, ["시장위험", "가격이"], ["", "변한다"], ["금리 및", "이자가"], ["환율위험", None], head, ["신용위험", "부도"], ["", ""]],
        [["구분", "다른"], ["시장위험", "x"]], [head], [head, ["no such word", "text"]], [],
    ]
    got = table(spark, rows, T.risk_rows, "array<array<string>>")
    assert [[tuple(p) for p in x] if x else None for x in got] == [[("시장위험", "가격이 변한다"), ("금리 및 환율위험", "이자가"), ("신용위험", "부도")], None, None, None, None]


def test_kinds_of_tables(spark):
    rows = [[FEES[0][0], PERFORMANCE[0][0]], [["총보수", "x"], ["a", "b"]], [["최근", "1년"], ["a"]], [["구분", "투자위험의 주요내용"], ["시장위험", "t"]], [["a"]], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, rows array<array<string>>")
    got = {r.i: r for r in T.reconstructed(df).collect()}
    assert [got[i].kind for i in range(7)] == ["fees+performance", "fees", "performance", "risk", "other", "other", "other"]
    assert got[1].headers == ["총보수", "x"] and got[1].body == [["a", "b"]] and got[0].headers is None


@pytest.mark.parametrize("roles", [1, 2, 3, 4])
def test_roles_by_all_assignments(spark, roles):
    random.seed(roles)
    grids = [[[random.choice([0, 0, 1, 2, 500, 1000]) for _ in range(width)] for _ in range(roles)] for width in (0, 1, 2, 3, 5, 6) for _ in range(12)]
    want = []
    for g in grids:
        width, ways = len(g[0]), []
        for at in product(range(width + 1), repeat=roles):
            used = [a for a in at if a]
            if len(used) == len(set(used)) and all(not a or g[r][a - 1] for r, a in enumerate(at)):
                ways.append((-sum(g[r][a - 1] for r, a in enumerate(at) if a), [a or 99 for a in at], list(at)))
        want.append(min(ways)[2])
    assert table(spark, grids, lambda c: T.assigned(c, roles), "array<array<long>>") == want


def test_tables_of_texts(spark):
    df = spark.createDataFrame([(1, "a | b | c\nd | e |  f  g | h\n\nx | y | z\nno"), (2, None), (3, ""), (4, "a | b")], "doc_id long, text string")
    got = [tuple(r) for r in T.text_tables(df, "doc_id", "text").orderBy("doc_id", "table_no", "row_no").collect()]
    assert got == [(1, 1, 1, ["a", "b", "c"]), (1, 1, 2, ["d", "e", "f g", "h"]), (1, 2, 1, ["x", "y", "z"])]


def test_running_ids_are_never_cut(spark, tmp_path):
    from factloom.queries import QUERIES

    spark.range(1200).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "'t' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    ids = [r.chunk_id for r in QUERIES["w07_sequence_numbers"](spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 1200 and "s_en_007" in ids and "s_en_1200" in ids


def test_wrapped_rows_take_one_shuffle(spark):
    from factloom.queries import QUERIES

    df = QUERIES["w10_wrapped_rows"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_fee_row_is_built_once(spark):
    """A filter on what a row gives would be pushed below and build each row a second time."""
    from factloom.queries import QUERIES

    plan = QUERIES["x04_fee_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("투자신탁") == 1
