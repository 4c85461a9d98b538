"""The fold by windows against a loop over turns."""

import datetime
import random

from pyspark.sql import functions as F

from factloom.operators.session_fold import session_fold

START = datetime.datetime(2024, 1, 1)


def loop(rows, ttl):
    """``(key, n) -> state`` turn by turn."""
    out, state = {}, {}
    for key, n, ask, who, topic, a, b, ts in sorted(rows, key=lambda r: (r[0], r[1])):
        s = state.setdefault(key, {"session": 0, "ts": None})
        if s["ts"] and ts and (ts - s["ts"]).total_seconds() > ttl:
            s = state[key] = {"session": s["session"] + 1, "ts": None}
        s["ts"], s["n"] = ts or s["ts"], s.get("n", 0) + 1
        before = [x for x in "ab" if s.get(x) is None]
        action = None
        if who:
            for name, value in (("topic", topic), ("a", a), ("b", b)):
                s[name] = value if value is not None else s.get(name)
            s["q"] = s["n"] if ask else s.get("q")
            lacks = [x for x in "ab" if s.get(x) is None]
            fills = s["q"] is not None and len(lacks) < len(before)
            action = ("CLARIFY" if lacks else "ANSWER" if ask else "RESUME") if ask or fills else "ANSWER"
        out[key, n] = (s["session"], s.get("topic"), s.get("q"), s.get("a"), s.get("b"), [x for x in "ab" if s.get(x) is None], action)
    return out


def fold(spark, rows, **more):
    turns = spark.createDataFrame(rows, "k int, n int, ask boolean, who boolean, topic string, a string, b string, ts timestamp")
    got = session_fold(turns, "k", ["n"], F.col("who"), F.col("ask"), F.col("topic"), {"a": F.col("a"), "b": F.col("b")}, **more)
    return got, {(r.k, r.n): (r.session, r.last_topic, r.question_at, r.a, r.b, r.missing, r.action) for r in got.collect()}


def test_equal_to_the_loop_with_silences_and_nulls(spark):
    rng = random.Random(11)
    rows = []
    for key in range(120):
        now = START
        for n in range(rng.randrange(12)):
            now += datetime.timedelta(seconds=rng.choice([5, 600, 1800, 1801, 4000]))
            pick = lambda share, value: value if rng.random() < share else None
            rows.append((key, n, rng.choice([True, False, None]), rng.choice([True, True, False, None]), pick(0.4, f"t{rng.randrange(3)}"), pick(0.3, f"a{n}"), pick(0.2, f"b{n}"), pick(0.9, now)))
    want = loop(rows, 1800)
    assert fold(spark, rows, at="ts")[1] == want
    assert {x[6] for x in want.values()} == {None, "CLARIFY", "RESUME", "ANSWER"} and max(x[0] for x in want.values()) > 1
    assert fold(spark, rows)[1] == loop([(*r[:7], None) for r in rows], 1800)
    assert fold(spark, rows[:0], at="ts")[1] == {}


def test_one_shuffle_and_a_long_conversation(spark):
    rows = [(1, n, n == 0, True, None, "x" if n == 9_000 else None, "y" if n == 19_999 else None, START + datetime.timedelta(seconds=n)) for n in range(20_000)]
    got, state = fold(spark, rows, at="ts")
    assert state[1, 0][6] == "CLARIFY" and state[1, 9_000][6] == "CLARIFY" and state[1, 9_001][6] == "ANSWER" and state[1, 19_999] == (0, None, 1, "x", "y", [], "RESUME")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the adaptive plan shows it in its initial and final form
