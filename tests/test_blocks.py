"""Nested blocks, roles of lines, the seven structures and records, by hand and by plain loops."""

import random

from pyspark.sql import functions as F

from factloom.operators import blocks as B


def test_blocks_nest_and_cover(spark):
    random.seed(5)
    texts = [[random.choice(["1", "2", "3", "x", ""]) for _ in range(random.randrange(1, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)] + [(98, ""), (99, None)], "doc_id long, text string")
    got = {}
    for r in B.blocks(df, "doc_id", "text", lambda x: x.try_cast("int")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert 99 not in got and [tuple(r)[1:] for r in got[98]] == [(1, 1, 0, 1, None)]
    for i, lines in enumerate(texts):
        want, n = [], len(lines)
        heads = [(k + 1, int(x)) for k, x in enumerate(lines) if x.isdigit()]
        if not lines[0].isdigit():
            heads.insert(0, (1, 0))
        for at, level in heads:
            stop = next((k - 1 for k, x in heads if k > at and (x <= level or level == 0)), n)
            around = [k for k, x in heads if k < at and 0 < x < level and all(y > x for z, y in heads if k < z <= at)]
            want.append((at, stop, level, len(around) + 1, around[-1] if around else None))
        assert [tuple(r)[1:] for r in sorted(got[i], key=lambda r: r.start)] == want
        leaf = [max(r.start for r in got[i] if r.start <= k <= r.stop) for k in range(1, n + 1)]
        assert leaf == sorted(leaf)  # every line is in a block, the innermost ones follow each other


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_roles_of_lines(spark):
    lines = ["투자위험", "1. 집합투자기구의 투자위험", "가. 일반위험", "발생 원인", "손실 내용", "위험관리 방안", "투자위험의 설명", "시장위험", "손실 가능성", "plain", "", None, "위험" + "x" * 60]
    assert column(spark, lines, "string", B.Lexicon().role) == ["section", "section", "category", "cause", "impact", "mitigation", "description", "name", "name", "other", "other", "other", "other"]


def test_seven_structures(spark):
    rows = [
        (["시장위험"], ["구분", "투자위험의 주요내용"], 2, False), (["x"], ["위험명", "원인", "영향"], 3, False), (["시장위험", "text"], None, 0, True), (["- 시장위험이 있다 그리고 이것은 아주 긴 줄이라서 이름이라고는 할 수 없는 줄이다 마흔 글자를 넘으니까"], None, 0, False),
        (["이 상품에는 시장위험, 그리고 다른 것이 있으며 이것은 아주 긴 줄이라서 이름이라고는 할 수 없는 줄이다 마흔 글자를 넘는다"], None, 0, True), (["시장위험", "text"], ["구분"], 1, False), (["text"], ["구분", "비고"], 2, True), ([], None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lines array<string>, heads array<string>, width int, boxed boolean")
    kind = B.structure(F.col("lines"), F.col("heads"), F.coalesce("width", F.lit(0)), F.coalesce("boxed", F.lit(False)))
    assert [r.k for r in df.select("i", kind.alias("k")).orderBy("i").collect()] == ["TABLE_2COL", "TABLE_MULTI_COL", "VERTICAL_PAIR", "BULLET", "INLINE", "HEADING_PARAGRAPH", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_records_across_lines(spark):
    lines = [["before", "금리변동", "변동위험", "", "금리가  오르면", "가격이 내린다", "신용위험", "투자위험", "lost", "환율위험", "말한다"], ["시장위험"], [], None]
    got = column(spark, lines, "array<string>", B.records)
    assert [[tuple(x) for x in r] if r is not None else None for r in got] == [[("변동위험", "금리가 오르면 가격이 내린다"), ("환율위험", "말한다")], [], [], None]
