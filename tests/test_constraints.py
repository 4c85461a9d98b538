"""Rule tables on nested records: places, dependencies, what is switched off, states of fields."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import constraints as C

SCHEMA = "id int, name string, grade int, fees array<struct<cls:string,rate:double,refs:array<string>>>, evidence array<string>"
ROWS = [
    (1, "a", 3, [("A", 0.5, ["e1"]), ("B", 120.0, ["e1", "e9"])], ["e1", "e2"]),
    (2, " ", None, [], []),
    (3, None, 9, None, None),
    (4, "d", 1, [("A", None, None), ("A", 1.0, [])], ["e1"]),
]
RULES = [
    C.Rule("fees", "fees", lambda v: F.size(v) > 0, C.INFO),
    C.Rule("name", "name", C.present, C.ERROR),
    C.Rule("rate", "fees[].rate", C.within(-1.0, 100.0), after=("fees",)),
    C.Rule("refs", "fees[].refs", lambda v: v.isNull() | (F.size(F.array_except(v, "evidence")) == 0), C.ERROR, after=("fees",)),
    C.Rule("one", "fees", C.distinct(lambda x: x["cls"]), after=("fees",)),
    C.Rule("last", "grade", C.present, after=("rate", "refs")),
]


def rules():
    return [*RULES, C.Rule("grade", "grade", C.within(1, 6), when=F.col("name").isNotNull())]


def test_states_places_and_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: r for r in C.judged(df, rules()).collect()}
    states = {i: {c.rule: (c.state, c.places) for c in r.checks} for i, r in got.items()}
    off, ok = ("NOT_APPLICABLE", []), ("OK", [])
    assert states[1] == {"fees": ok, "name": ok, "rate": ("FAILED", [2]), "refs": ("FAILED", [2]), "one": ok, "last": off, "grade": ok}
    assert states[2] == {"fees": ("FAILED", [0]), "name": ("FAILED", [0]), "rate": off, "refs": off, "one": off, "last": off, "grade": ok}
    assert states[3] == {"fees": ("FAILED", [0]), "name": ("FAILED", [0]), "rate": off, "refs": off, "one": off, "last": off, "grade": off}
    assert states[4] == {"fees": ok, "name": ok, "rate": ok, "refs": ok, "one": ("FAILED", [0]), "last": ok, "grade": ok}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["failed", "failed", "failed", "warning"]
    assert C.judged(df.where("false"), rules()).count() == 0
    assert [c.rule for c in got[1].checks] == [r.name for r in rules()]


def test_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "r"))
    plan = C.judged(spark.read.parquet(str(tmp_path / "r")), rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_wrong_tables_raise(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for wrong in ([C.Rule("a", "name", C.present, after=("b",)), C.Rule("b", "name", C.present, after=("a",))], [C.Rule("a", "name", C.present), C.Rule("a", "grade", C.present)], [C.Rule("a", "name", C.present, after=("x",))]):
        with pytest.raises(ValueError):
            C.judged(df, wrong)


def test_dangling_references_go(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: r.x for r in df.select("id", C.without_dangling(F.col("fees"), "refs", F.coalesce("evidence", F.array().cast("array<string>"))).alias("x")).collect()}
    assert [x.refs for x in got[1]] == [["e1"], ["e1"]] and got[2] == [] and got[3] is None and [x.refs for x in got[4]] == [[], []]


def test_states_of_fields(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "rejected"), (3, None, "ambiguous"), (4, None, None), (5, None, "nonsense"), (6, None, "absent")], "id int, v string, owner string")
    fields = [C.Field("v", F.col("v").isNotNull(), F.col("owner"), F.col("owner") == "absent"), C.Field("w", F.lit(None).cast("boolean"))]
    got = {r.id: r.m for r in df.select("id", C.field_status(fields).alias("m")).collect()}
    assert [got[i]["v"] for i in range(1, 7)] == ["FOUND", "NOT_FOUND", "AMBIGUOUS", "NOT_FOUND", "NOT_FOUND", "NOT_APPLICABLE"] and got[1]["w"] == "NOT_FOUND"
