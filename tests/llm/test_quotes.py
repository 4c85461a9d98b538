import duckdb
import pytest

from factloom.llm import quote_threads as Q
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "First question, line one\nand line two"), (1, 1, "assistant", "Another thing"), (1, 2, "user", "On Monday someone wrote:\n> First question,  LINE one\n> and line two\n\nMy answer"),
    (1, 3, "assistant", "> > First question, line one\n> My answer\nnested reply"), (1, 4, "user", "> words nobody said\nstill here"), (1, 5, None, None), (1, 6, "user", ">>My answer\n> changed text\nthe end"),
    (2, 0, "user", "thanks"), (2, 1, "user", "> thanks\nthanks"), (2, 2, "user", "> thanks"), (2, 5, "user", "gap before"), (None, 1, "user", "no conversation"), (3, None, "user", "> no turn"),
    (4, 1, "user", "> quotes the future"), (4, 2, "user", "quotes the future"),
    (5, 0, "user", "A long first line of the message that goes on\n\nSecond paragraph of it\nin two lines\n\nEnd"), (5, 1, "assistant", "An answer, at length"),
    (5, 2, "user", "> A long first line of\n> the message that goes on\nYes.\n> Second paragraph of it in\n> two lines\nNo."), (5, 3, "assistant", "> An answer,\n>  at length\nWell"),
    (5, 4, "user", ">> Second paragraph\n>> of it in two lines\n> nothing that was said\nHm"), (5, 5, "assistant", "plain"), (5, 6, "user", "> Yes.\nGood"), (5, 7, "user", "> Yes.\n> No.\nBad"),
    (6, 0, "user", "root"), (6, 1, "a", "> root\none"), (6, 2, "b", "> root\ntwo"), (6, 3, "c", "> one\nthree"), (6, 4, "d", "> root\nfour"), (6, 5, "e", "> one\nfive"), (6, 6, "f", "> three\nsix"), (6, 7, "g", "> five\nseven"),
    (6, 8, "h", "> three\neight"), (6, 10, "i", "another thread"), (6, 11, "j", "> another thread\nreply"),
]


def test_links_threads_and_clean_texts(spark):
    got = {(r.conv_id, r.turn): r for r in Q.linked_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert len(got) == len(ROWS)
    r = got[1, 2]
    assert (r.text, r.parent_turn, r.linked_by, r.thread_turn, r.depth, r.n_quoted) == ("My answer", 0, "quote", 0, 1, 2)
    r = got[1, 3]
    assert (r.text, r.parent_turn, r.thread_turn, r.depth) == ("nested reply", 2, 0, 2)
    assert (got[1, 4].text, got[1, 4].linked_by, got[1, 4].parent_turn) == ("still here", "order", 3)
    assert (got[1, 5].text, got[1, 5].role, got[1, 5].formatted) == ("", "user", "<|user|>\n\n")
    assert (got[1, 6].parent_turn, got[1, 6].linked_by) == (2, "quote")
    assert [got[5, i].parent_turn for i in range(8)] == [None, 0, 0, 1, 0, 4, 2, 2] and got[5, 5].linked_by == "order" and got[5, 5].depth == 2
    order = sorted((k for k in got if k[0] == 6), key=lambda k: (got[k].thread_turn, got[k].reply_key))
    assert [t for _, t in order] == [0, 1, 3, 6, 8, 5, 7, 2, 4, 10, 11]
    assert got[2, 2].parent_turn == 0 and got[2, 5].parent_turn is None and got[2, 5].linked_by is None
    assert got[4, 1].linked_by is None and got[None, 1].text == "no conversation" and got[3, None].text == ""


def as_rows(rows, names):
    return sorted([tuple(str(r[i]) for i in range(len(names))) for r in rows])


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_against_sql(spark, which):
    df = spark.createDataFrame([r for r in ROWS if None not in r[:2]], SCHEMA) if which == "fixture" else spark.read.parquet(f"{SF}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    found = con.execute(Q.OP2_SQL)
    names = [d[0] for d in found.description]
    assert as_rows(found.fetchall(), names) == as_rows(Q.linked_conversations(df).select(*names).collect(), names)


def test_no_python_in_the_plan(spark):
    plan = Q.linked_conversations(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def preorder(parents):
    children = {}
    for t, p in sorted(parents.items()):
        children.setdefault(p, []).append(t)
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        t = stack.pop()
        out.append(t)
        stack += reversed(children.get(t, []))
    return out


def test_reply_order_is_depth_first_on_random_trees(spark):
    import random

    rng = random.Random(3)
    rows = [(c, t, "user", f"said {t}" if t == 0 else f"> said {rng.randrange(t)}\nsaid {t}") for c in range(12) for t in range(60)]
    got = Q.linked_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    for c in range(12):
        own = [r for r in got if r.conv_id == c]
        order = [r.turn for r in sorted(own, key=lambda r: (r.thread_turn, r.reply_key))]
        assert order == preorder({r.turn: r.parent_turn for r in own})


def test_very_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "\n".join(f"line {i} of many" for i in range(5_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "\n".join("> " + x for x in long.split("\n")) + "\nshort"), (1, 2, "user", "x" * 500_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("lines", "own", "clean", "hash", "origin", "parent", "root", "depth", "path"):
        df = df.withColumn(c, F.lit("own"))
    got = {r.turn: r for r in Q.linked_conversations(df).collect()}
    assert (got[1].parent_turn, got[1].linked_by, got[1].text, got[1].n_quoted) == (0, "quote", "short", 5_000) and len(got[2].text) == 500_000


def test_long_chains_repeats_and_empty(spark):
    chain = [(1, i, "user", f"> message {i - 1} says\nmessage {i} says") for i in range(40)]
    got = {r.turn: r for r in Q.linked_conversations(spark.createDataFrame(chain, SCHEMA)).collect()}
    assert all((got[i].parent_turn, got[i].thread_turn, got[i].depth) == (i - 1, 0, i) for i in range(1, 40))
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], SCHEMA)
    assert Q.linked_conversations(twice).count() == 2
    assert Q.linked_conversations(twice.where("false")).count() == 0
