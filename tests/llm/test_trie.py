import random
from hashlib import sha256
from zlib import crc32

import pytest

from factloom.llm import prefix_trie as P
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    """Every prefix of every conversation in a dictionary. ``rows`` hold no ties of turn but equal rows."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        convs = {c: convs.get(c - c % 20, [])[: crc32(str(c).encode()) % 4] + v[crc32(str(c).encode()) % 4 :] for c, v in convs.items()}
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        words = len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(P.op11_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize("limit", [2, 40])
def test_random_tries_of_any_limit(spark, limit):
    """Copies, long common beginnings and hot first turns, split down to single turns or not at all."""
    random.seed(limit)
    rows = []
    for c in range(40):
        n = random.choice([1, 2, 3, 5, 9])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} a b" if random.random() < 0.9 else f"x{random.randrange(3)} c") for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = P.turns(df)
    assert found(P.trie(own if limit == 2 else P.rebuilt(own), limit)) == brute(rows, rebuild=limit != 2)


def test_nulls_repeats_and_turnless(spark):
    rows = [(20, None, "user", "first"), (20, 0, None, "second one"), (20, 1, "user", None), (20, 1, "user", None), (21, 5, "a", "only"), (45, 0, "a", "gone when no base"), (None, 0, "u", "no conversation"), (46, 0, "b", ""), (47, 0, "b", " \n\t")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(P.trie(P.rebuilt(P.turns(df.selectExpr("*", "'own' as pos", "1 as digest", "2 as `a``b c`"))))) == brute(rows)


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "u", f"w{t}") for c in (1, 2, 3) for t in range(3000 + (c == 3))]
    got = {(r.conv_id, r.depth): r for r in P.trie(P.turns(spark.createDataFrame(rows, SCHEMA)), 500).collect()}
    assert len(got) == 3002 and got[1, 0].saved_tokens == 6000 and got[1, 1500].saved_tokens == 2 * 1501 and got[1, 3000].n_children == 1 and got[3, 3001].parent_conv_id == 1
    assert got[1, 3000].ends_sha256 == sha256(b"1,2").hexdigest() and {r.n_leaves for r in got.values()} == {1}


def test_empty_table(spark):
    assert P.trie(P.rebuilt(P.turns(spark.createDataFrame([], SCHEMA)))).count() == 0
