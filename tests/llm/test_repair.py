import random
import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest

from factloom.llm import turn_repair as R
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(items):
    """(cost, audit, repaired) by a plain program over prefixes: the best (cost, audit) for each state, all audits compared as strings. ``items``: (role, text, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def spread(best):
        for _ in range(4):
            for q, (cost, audit, out) in list(best.items()):
                for r in "ua":
                    to = step.get((q, r))
                    new = (cost + 5, audit + "I", out + [("user" if r == "u" else "assistant") + ":"])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    best = spread({"": (0, "", [])})
    for role, text, fault in items:
        after = {}

        def offer(q, new):
            if q is not None and (q not in after or new[:2] < after[q][:2]):
                after[q] = new

        for q, (cost, audit, out) in best.items():
            offer(q, (cost + 2, audit + "D", out))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                offer(step.get((q, role[:1])), (cost + extra, audit + "K", out + [f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    offer(step.get((q, r[0])), (cost + extra + 1, audit + "R", out + [f"{r}:{text}"]))
        best = spread(after)
    return min(best[q] for q in ("", "a") if q in best)


def test_smallest_audit_by_all_audits():
    """Against every audit up to a length, by the definition."""
    machine = R.Automaton()
    for n in range(4):
        for rows in product(["s", "u", "a", "o", "u!", "ux"], repeat=n):
            symbols = "".join(chr(65 + 4 * "suao".index(r[0]) + (3 if r.endswith("!") else 2 if r.endswith("x") else 0)) for r in rows)
            cost, audit, tokens = machine.repair(symbols)
            found = []
            for k in range(n, n + 5):
                for letters in product("DIKR", repeat=k):
                    if sum(x != "I" for x in letters) != n or letters.count("I") > 4:
                        continue
                    total, rest, states = 0, iter(rows), {""}
                    for x in letters:
                        row = None if x == "I" else next(rest)
                        if x == "D":
                            total += 2
                            continue
                        if x == "I":
                            total += 5
                        elif row.endswith("x"):
                            states = set()
                            break
                        else:
                            total += (x == "R") + 5 * row.endswith("!")
                        states = {s + r for s in states for r in ([row[0]] if x == "K" else "ua")}
                    if any(re.fullmatch("(s?(ua)+)?", s) for s in states):
                        found.append((total, "".join(letters)))
                if found and k > n + 1 and min(found)[0] <= 5 * (k - n):
                    break
            assert (cost, audit) == min(found), rows
            assert len(tokens) == n + 1


def brute(rows):
    """The contract by plain loops. ``rows`` hold no ties of turn but equal rows."""
    convs, out = {}, {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        convs.setdefault(c, []).extend([((t is not None, t or 0), "user" if kind == 4 else r, x, t)] * {0: 0, 3: 2}.get(kind, 1))
    for c, v in convs.items():
        v.sort(key=lambda y: y[0])
        seen, items = set(), []
        for _, r, x, _ in v:
            body = x.strip(SPACE)
            items.append((r, x, "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((r, x))
        turns = [t for *_, t in v if t is not None]
        cost, audit, lines = cheapest(items)
        count = [sum(f == k for *_, f in items) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(R.op12_turn_repair(spark, sf)) == brute(rows)


def test_random_conversations_nulls_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    random.seed(3)
    texts = ["Fine.", "cut", " ", "", None, "What?\n\t", "Fine.", "line\n\nend!", "ünï.", ":", "a.b"]
    rows = [(random.choice([0, 1, 2, None, *range(3, 40)]), t, random.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), random.choice(texts)) for t in range(900)]
    rows += [(50, None, "user", "no turn."), (50, None, "user", "no turn."), (50, 3, "assistant", "three.")] + [(51, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", "'own' as said", "1 as pos", "2 as c", "3 as `x.y`")
    assert found(R.with_all(df, R.repaired(R.damaged(df)))) == brute(rows)


def test_nothing_left_and_empty(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "x")], SCHEMA)
    assert found(R.with_all(df, R.repaired(R.damaged(df)))) == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    none = spark.createDataFrame([], SCHEMA)
    assert R.with_all(none, R.repaired(R.damaged(none))).count() == 0


def test_few_vectors():
    machine = R.Automaton()
    random.seed(1)
    machine.repair("".join(chr(65 + random.randrange(16)) for _ in range(50_000)))
    assert len(machine.vectors) < 200 and len(machine.table) < 3200
