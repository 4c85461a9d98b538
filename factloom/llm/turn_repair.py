"""Repair of a conversation's structure by the cheapest edits of its turns.

A conversation should read ``(system? (user assistant)+)?``. Keeping a turn costs nothing, a new role 1, deleting 2, inserting an empty turn 5,
and a truncated turn that stays 5 more; blank and duplicate turns must go.

The cheapest edits are a shortest path in a weighted automaton with four states (at the start, behind a system, user, assistant turn). It is determinised
lazily: the costs to get from each state to the end form a vector; less its smallest entry it is one of few vectors, which are the states of a
deterministic automaton whose steps (vector, turn's symbol) -> (vector, cost) are cached in a table. A scan over the symbols from the last turn to the first looks
each up and gives all costs. The trace back along the scan, from the first turn to the last, follows tight arcs, the one with the smallest letter first, so of all
cheapest audits it is the least in ASCII; its steps are cached too.

Turns are numbered and compared by digests, without their texts. A conversation's symbols, one byte a turn, meet in one task, as its audit is one value; a text
is read once more only if its turn stays.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table
from factloom.llm.ordering import numbered, sequence_digests

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns whose symbols travel as one row.
BLOCK = 1024
#: Where an inserted or relabelled turn leads from each state, and the role that it gets: 0 start, 1 system, 2 user, 3 assistant.
NEXT, ROLE = (2, 2, 3, 2), "uuau"
#: Where a turn leads that keeps its role, by the role's initial.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
CLASSES, FAULTS = "suao", ("", "blank", "duplicate", "truncated")
OPEN = 1 << 40


class Automaton:
    """The lazily determinised automaton. A vector of state costs, normalised to a smallest entry of 0, is numbered when it is first met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, str, int]] = {}
        self.end, self.end_cost = self.number([0, OPEN, OPEN, 0])

    def number(self, costs: list[int]) -> tuple[int, int]:
        for _ in range(3):  # an inserted turn leads on without a symbol
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of what may be done with a turn."""
        role, fault = CLASSES[(ord(symbol) - 65) // 4], FAULTS[(ord(symbol) - 65) % 4]
        out = [("D", DELETE, state)]
        if fault in ("", "truncated"):
            extra = TRUNCATED if fault else 0
            if state in KEEP[role]:
                out.append(("K", extra, KEEP[role][state]))
            out.append(("R", RELABEL + extra, NEXT[state]))
        return out

    def step(self, at: int, symbol: str) -> tuple[int, int]:
        """(the number of the costs before the turn, what their smallest entry rises by)."""
        got = self.table.get((at, symbol))
        if got is None:
            ahead = self.vectors[at]
            got = self.table[at, symbol] = self.number([min(c + ahead[q] for _, c, q in self.edits(symbol, state)) for state in range(4)])
        return got

    def tight(self, at: int, symbol: str, state: int) -> tuple[str, str, int]:
        """(audit letters, token, next state) up to the end of the turn before costs ``at``, along tight arcs, smallest letter first."""
        got = self.arcs.get((at, symbol, state))
        if got is None:
            ahead, (before, rise) = self.vectors[at], self.step(at, symbol)
            here, letters, token, q = self.vectors[before], "", "", state
            while True:
                fits = {letter: to for letter, cost, to in self.edits(symbol, q) if here[q] + rise == cost + ahead[to]}
                if "D" not in fits and here[q] == INSERT + here[NEXT[q]]:
                    letters, token, q = letters + "I", token + ROLE[q], NEXT[q]
                    continue
                letter = min(fits)
                letters += letter
                token += ROLE[q].upper() if letter == "R" else letter
                got = self.arcs[at, symbol, state] = (letters, token, fits[letter])
                break
        return got

    def repair(self, symbols: str) -> tuple[int, str, list[str]]:
        """(cost, audit, a token for each turn and one for the end). A token: roles of inserted turns (u, a), then K, D, or the new role (U, A)."""
        at, cost, passed = self.end, self.end_cost, []
        table, step = self.table, self.step
        for symbol in reversed(symbols):
            passed.append(at)
            at, rise = table.get((at, symbol)) or step(at, symbol)
            cost += rise
        cost += self.vectors[at][0]
        letters, tokens, q = [], [], 0
        arcs, tight = self.arcs, self.tight
        for at, symbol in zip(reversed(passed), symbols):
            more, token, q = arcs.get((at, symbol, q)) or tight(at, symbol, q)
            letters.append(more)
            tokens.append(token)
        last = ""
        while q not in (0, 3):
            last, q = last + ROLE[q], NEXT[q]
        return cost, "".join(letters) + "I" * len(last), [*tokens, last]


@cache
def automaton() -> Automaton:
    return Automaton()


def _scan(batches):
    """Blocks of symbols, sorted by conversation and place, to one row for each block: its tokens, and with the last block the conversation's totals."""
    conv, parts, machine = None, None, automaton()

    def done():
        symbols = "".join(parts)
        cost, audit, tokens = machine.repair(symbols)
        roles = [CLASSES[(ord(x) - 65) // 4] for x in symbols]
        counts = [sum(symbols.count(chr(65 + 4 * c + f)) for c in range(4)) for f in (1, 2, 3)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        at = 0
        for k, part in enumerate(parts):
            end = len(tokens) if k == len(parts) - 1 else at + len(part)
            out.append((conv, at, ",".join(tokens[at:end]), *((*counts, illegal, cost, audit) if k == len(parts) - 1 else (None,) * 6)))
            at = end

    out = []
    for batch in batches:
        for c, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if parts is None or c != conv:
                if parts:
                    done()
                conv, parts = c, []
            parts.append(symbols)
        yield from _batches(out)
        out = []
    if parts:
        done()
    yield from _batches(out)


def _batches(rows):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*KINDS.values()])], [*KINDS])


KINDS = {"conv_id": pa.int64(), "at": pa.int64(), "tokens": pa.string()} | {c: pa.int64() for c in ("blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": pa.string()}
SCANNED = "conv_id long, at long, tokens string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's.

    Nulls are one space, in the key as well as in role and text.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("_d <> 0").select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_d")
    return rows.withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_d", "_n")


def _identity() -> Column:
    """What tells rows apart: conversation, turn, role, text."""
    blank = F.lit(" ")
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank), _said()), 256).substr(1, 32))


def _said() -> Column:
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).substr(1, 32)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (``conv_id, turn, role, text``, the last two without nulls): its faults, cost, audit and repaired text's digest.

    Turns go by ``turn`` (nulls first; equal ones by the digest of role and text). A null ``conv_id`` is a conversation like any other. Equal rows are
    duplicates of each other. A role counts by its first character. Other columns are not read. An empty table gives no rows.
    """
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    role = F.substring("role", 1, 1)
    shape = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    thin = rows.select("conv_id", "turn", F.unhex(_said()).alias("said"), _identity().alias("own"), shape.alias("shape"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    thin = stored(numbered(thin, "conv_id", F.col("turn").asc_nulls_first(), F.col("said"), name="said"), "numbered")

    first = thin.groupBy("conv_id", "said").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.lit(True).alias("new"))
    met = thin.join(first, thin["conv_id"].eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    symbol = F.char(F.lit(65) + 4 * (F.instr(F.lit(CLASSES), F.col("shape")) - 1) + fault)
    blocks = met.select("conv_id", "pos", symbol.alias("symbol")).groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    blocks = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
    scanned = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "symbols").mapInArrow(_scan, SCANNED)
    scanned = stored(scanned, "scanned")

    token = scanned.select("conv_id", "at", F.posexplode(F.split("tokens", ",")).alias("k", "token")).select("conv_id", (F.col("at") + F.col("k") + 1).alias("pos"), "token").where("token not in ('D', '')")
    keys = thin.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "own")
    token = token.join(keys, token["conv_id"].eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left").select("conv_id", "pos", "token", "own")
    texts = rows.select(_identity().alias("own"), "role", "text").groupBy("own").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    said = stored(token.where(F.col("token").rlike("[KUA]$")), "stays").join(texts, "own").unionByName(token.where(~F.col("token").rlike("[KUA]$")), allowMissingColumns=True)
    edit = F.substring("token", -1, 1)
    new = F.concat(F.when(edit == "U", "user").when(edit == "A", "assistant").when(edit == "K", F.col("role")), F.lit(":"), "text")
    inserted = F.transform(F.split(F.regexp_replace("token", "[KDUA]", ""), ""), lambda x: F.when(x == "u", "user:").when(x == "a", "assistant:"))
    line = F.concat_ws("\n", inserted, new)
    lines = said.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"), "pos", F.encode(line, "utf-8").alias("line"))
    digests = sequence_digests(lines, ["none", "conv_id"], "pos", "line", b"\n").select(F.when(~F.col("none"), F.col("conv_id")).alias("conv_id"), F.col("sha256").alias("repaired_sha256"))

    spans = thin.groupBy("conv_id", "turn").count().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    totals = scanned.where("cost is not null").drop("at", "tokens")
    for other in (spans, digests):
        other = other.withColumnRenamed("conv_id", "c")
        totals = totals.join(other, totals["conv_id"].eqNullSafe(F.col("c")), "left").drop("c")
    return totals.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def with_all(conversations: DataFrame, result: DataFrame) -> DataFrame:
    """``result`` with a row for each conversation of which no turn is left: zeros, no audit, the digest of nothing."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    met = ids.join(result, F.col("c").eqNullSafe(result["conv_id"]), "left").drop("conv_id").withColumnRenamed("c", "conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return with_all(conversations, repaired(damaged(conversations)))
