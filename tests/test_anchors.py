"""Approximate anchors against an edit table over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import anchors as A
from factloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(passage, words):
    """The span by whole tables of edits: the first end with the fewest, then the shortest start."""
    m, at = len(passage), np.arange(len(passage) + 1)

    def last(p, ws, free):
        col, out = at.copy(), []
        for j, w in enumerate(ws, 1):
            new = np.minimum(col + 1, np.concatenate(([0 if free else j], col[:-1] + np.array([x != w for x in p]))))
            new[0] = 0 if free else j
            col = np.minimum.accumulate(new - at) + at
            out.append(int(col[-1]))
        return out

    costs = last(passage, words, True)
    cost = min(costs, default=m)
    end = costs.index(cost) + 1 if costs else 0
    n = last(passage[::-1], words[:end][::-1], False).index(cost) + 1 if cost < m else 0
    return cost, end - n, n


def brute(passages, sources, percent):
    out = set()
    for pid, p in passages:
        for sid, s in sources:
            if p and pid is not None and sid is not None and len(s) >= 1:
                found = table(p, s)
                if found[0] <= (100 - percent) * len(p) // 100:
                    out.add((pid, sid, *found))
    return out


def frames(spark, passages, sources):
    make = lambda rows, key: spark.createDataFrame([(i, None if w is None else ", ".join(w), "x") for i, w in rows], f"{key} long, text string, edits string")
    return make(passages, "p"), make(sources, "s")


def test_equal_to_all_pairs_at_every_share(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(40), rng.randrange(40))}"
    sources = [(i, [word() for _ in range(rng.randrange(60))]) for i in range(60)]
    passages = []
    for i in range(40):
        s = rng.choice(sources)[1]
        at = rng.randrange(len(s) + 1)
        cut = s[at : at + rng.randrange(1, 25)]
        passages.append((i, [word() if rng.random() < 0.2 else w for w in cut if rng.random() > 0.1]))
    passages += [(100, None), (101, []), (102, ["nowhere"]), (103, ["w1"] * 9), (104, ["w1"])]
    sources += [(100, None), (101, []), (102, ["w1"] * 5)]
    p, s = frames(spark, passages, sources)
    plain = [(i, w or []) for i, w in passages], [(i, w or []) for i, w in sources]
    for percent in (58, 80, 100):
        rows = [tuple(r) for r in A.approximate_spans(p, s, "p", "s", "text", percent).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(*plain, percent), percent
    assert A.approximate_spans(p.where("false"), s, "p", "s", "text").count() == 0
    assert A.approximate_spans(p, s.where("false"), "p", "s", "text").count() == 0


def test_long_passages_and_status(spark):
    long = [f"a{i}" for i in range(3000)]
    changed = ["start", *long[:1000], "odd", *long[1001:], "end"]
    p, s = frames(spark, [(1, long), (2, ["a7", "a8"]), (3, ["none"]), (4, None), (5, ["a5", "a7", "a8"])], [(1, changed), (2, changed), (None, changed)])
    found = A.approximate_spans(p, s, "p", "s", "text")
    assert {tuple(r) for r in found.collect() if r.p == 1} == {(1, 1, 1, 1, 3000), (1, 2, 1, 1, 3000)}
    rows = {tuple(r) for r in A.anchor_status(p, found, "p", "s", "text").collect()}
    assert rows == {(1, 0, 2, 1, "NEAR"), (2, 2, 0, 1, "SUPPORTED"), (3, 0, 0, None, "UNSUPPORTED"), (4, 0, 0, None, "SKIPPED"), (5, 0, 2, 1, "NEAR")}


def test_query_is_equal_to_all_pairs(spark):
    split = lambda name, key: [(r[key], r.w) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, A.word_list(F.col("text")).alias("w")).collect()]
    docs, items = split("documents", "doc_id"), split("benchmark", "item_id")
    rows = {tuple(r) for r in QUERIES["x17_approximate_anchors"](spark, SF).collect()}
    width = max(len(p) for _, p in items)
    at = np.arange(width + 1)
    codes = {w: i for i, w in enumerate({w for _, ws in [*docs, *items] for w in ws})}
    grid = np.full((len(items), width), -1)
    for i, (_, p) in enumerate(items):
        grid[i, : len(p)] = [codes[w] for w in p]
    sizes = np.array([len(p) for _, p in items])
    most = 42 * sizes // 100
    want = {}
    for did, words in docs:
        col, low = np.tile(at, (len(items), 1)), sizes.copy()
        for w in words:
            new = col + 1
            new[:, 0] = 0
            new[:, 1:] = np.minimum(new[:, 1:], col[:, :-1] + (grid != codes[w]))
            col = np.minimum.accumulate(new - at, axis=1) + at
            low = np.minimum(low, col[np.arange(len(items)), sizes])
        want |= {(items[i][0], did): int(low[i]) for i in range(len(items)) if sizes[i] and low[i] <= most[i]}
    assert {(r[0], r[1]): r[2] for r in rows} == want and len(rows) == len(want) > 0
    text = {i: w for i, w in docs}, {i: w for i, w in items}
    for item, doc, *found in list(rows)[:20]:
        assert tuple(found) == table(text[1][item], text[0][doc])


def test_only_windows_with_enough_runs_are_aligned(spark):
    """A passage at every place of a long source is found across the borders of windows; a source that says one of its runs again and again is not read."""
    p = [f"p{i}" for i in range(20)]
    other = lambda n: [f"o{i}" for i in range(n)]
    sources = [(i, [*other(i), *p[:9], "new", *p[10:], *other(70)]) for i in range(60)] + [(100, ["p3", "p4", "and"] * 300)]
    found = A.approximate_spans(*frames(spark, [(1, p)], sources), "p", "s", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(1, i, 1, i, 20) for i in range(60)]
    assert "_least" in found._jdf.queryExecution().optimizedPlan().toString()
