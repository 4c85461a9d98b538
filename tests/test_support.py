"""Band joins against all pairs, staged search, phrases against plain search."""

import random

from pyspark.sql import functions as F

from factloom.operators import support as S


def test_band_join_is_the_theta_join(spark):
    random.seed(2)
    facts = [(i, random.choice("ab"), random.choice([0.0, -0.0005, 0.0005, 0.001, None, round(random.uniform(-0.01, 0.01), 4), random.uniform(-0.01, 0.01)])) for i in range(400)]
    cells = [(i, random.choice("abc"), random.choice([0.0, 0.0005, 0.0010, None, round(random.uniform(-0.01, 0.01), 4), random.uniform(-0.01, 0.01)])) for i in range(400)]
    f, c = spark.createDataFrame(facts, "f int, k string, value double"), spark.createDataFrame(cells, "c int, k string, cell double")
    got = sorted((r.f, r.c) for r in S.within(f, c, ["k"], "value", "cell").select("f", "c").collect())
    want = sorted((i, j) for i, k, v in facts for j, m, x in cells if k == m and v is not None and x is not None and abs(v - x) <= 5e-4)
    assert got == want and len(want) > 1000
    assert S.within(f, c.where("false"), ["k"], "value", "cell").count() == 0


def test_rank_of_support(spark):
    facts = spark.createDataFrame([("A", 1.0, 5)] * 3 + [("B", 2.0, 1), ("C", None, 1)], "cls string, rate double, page int")
    rows = [("A", 1.0003, 5, True, True, 9, 1), ("A", 1.0, 90, False, False, 1, 2), ("A", 1.0, 80, None, True, 1, 3), ("A", 1.0, 6, False, True, 1, 4), ("A", 1.0, 4, False, True, 7, 5), ("A", 1.0, 4, False, True, 7, 6), ("B", 2.001, 1, True, True, 1, 7)]
    cells = spark.createDataFrame(rows, "cls string, cell double, at int, fees boolean, heads boolean, width int, id int")
    got = S.supporting_rows(facts, cells, ["cls"], "rate", "cell", "page", "at", F.col("fees"), F.col("heads"), "width", ["id"]).collect()
    assert [(r.cls, tuple(r.support)) for r in got] == [("A", (True, False, True, 1, 7, 5))]


def test_stages_of_a_performance_row(spark):
    rows = spark.createDataFrame([("t", 1, "A", "class", 1.0), ("t", 2, "index", "benchmark", 2.0), ("t", 3, "B", "class", 3.0), ("t", 4, "C", "class", 3.0), ("t", 5, "A", "class", 9.0), ("u", 1, None, None, None)], "t string, row int, label string, k string, cell double")
    facts = spark.createDataFrame(
        [(1, "t", "benchmark", "A", 1.0), (2, "t", "volatility", "A", 1.0), (3, "t", None, "A", 3.0), (4, "t", None, None, 1.0002), (5, "t", None, None, 3.0), (6, "t", None, None, 2.0), (7, "u", None, "A", 1.0), (8, "v", None, None, None)],
        "f int, t string, k string, name string, value double",
    )
    got = {r.f: (r.row, r.stage) for r in S.performance_row(facts, rows, "f", "t", "row", "label", "k", "name", "value", "cell").collect()}
    assert got == {1: (2, "benchmark"), 2: (None, None), 3: (1, "class"), 4: (1, "value"), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_phrases_by_plain_search(spark):
    random.seed(4)
    word = lambda: random.choice(["a", "b", "c", "é", "d1"])
    texts = [(i, " ".join(word() for _ in range(random.randrange(0, 60)))) for i in range(40)] + [(98, None), (99, "A--b,\nC! é")]
    phrases = [(i, " ".join(word() for _ in range(random.randrange(0, 5)))) for i in range(30)] + [(50, None), (51, "b c"), (52, "B, C"), (53, "a " * 17)]
    t, p = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(phrases, "p int, phrase string")
    found = S.phrases_in(t, p, "d", "p", "text", "phrase")
    clean = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split(" ") if w]
    want = []
    for d, x in texts:
        words = clean(x)
        want += [(d, q, i + 1, len(clean(y))) for q, y in phrases for i in range(len(words)) if 0 < len(clean(y)) <= 16 and words[i : i + len(clean(y))] == clean(y)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 100
    kept = {}
    for r in S.longest_first(found, "d", "p").collect():
        kept.setdefault(r.d, []).append((r.at, r.p, r.n_words))
    for d in {w[0] for w in want}:
        end, own = 0, []
        for at in sorted({w[2] for w in want if w[0] == d}):
            if at > end:
                n, q = max((w[3], -w[1]) for w in want if w[0] == d and w[2] == at)
                own.append((at, -q, n))
                end = at + n - 1
        assert sorted(kept[d]) == own


def test_words_are_put_together_only_where_a_phrase_may_begin(spark):
    t, p = spark.createDataFrame([(1, "a b c")], "d int, text string"), spark.createDataFrame([(1, "b c")], "p int, phrase string")
    found = S.phrases_in(t, p, "d", "p", "text", "phrase")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2, 2)] and "slice(lambda" not in found._jdf.queryExecution().optimizedPlan().toString() and "_ahead" not in found._jdf.queryExecution().analyzed().toString()
