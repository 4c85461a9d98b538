"""Packing of tokenised documents into fixed windows by minimum bin slack.

Every partition packs its own documents, so nothing is shuffled and no task waits for another. A document's whole
windows leave at once; the rest, shorter than a window, waits in a pool of remaining lengths. When the pool
holds ``POOL`` tokens, windows are filled: the longest piece opens a window, a subset-sum dynamic program over the
multiset of remaining lengths (bitsets, counts split in powers of two) finds the filling closest to the
capacity, and backtracking gives how many pieces of each length it takes. The same filling is used as often as the pool's
counts allow. If no filling meets the capacity, one more piece is cut to close the gap and its rest returns to the pool.
What is left at the end of a partition goes into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

CAPACITY, POOL, END_ID = 1024, 1 << 21, 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Characters on which both encoders of the byte-level vocabulary split alike; other texts take the slower encoder.
ODD = re.compile(r"[^\t\n\r -~\xa1-ɏͰ-ԯ‐-‧₠-₿぀-ヿ一-鿿가-힣]|<\|endoftext\|>")


@lru_cache(4)
def encoders(name: str):
    """(fast, exact): two encoders of one byte-level vocabulary; ``name`` is its file without the ending."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    exact.no_truncation()
    exact.no_padding()
    return fast, exact


def encode(text: str | None, name: str = "byte_bpe_50k") -> list[int]:
    """Token ids of a whole text (null: of the empty text), without added special tokens."""
    fast, exact = encoders(name)
    if not text:
        return []
    return exact.encode(text, add_special_tokens=False).ids if ODD.search(text) else fast.encode_ordinary(text)


def closest_filling(counts: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many pieces of each length come closest to ``target`` from below. ``counts``: (length, pieces), longest first."""
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for length, pieces in counts:
        if length > target:
            continue
        left, take = min(pieces, target // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def fill(pool: dict[int, list], capacity: int, last: bool):
    """Take windows out of ``pool`` (pieces by length, each (document, start, ids, document's tokens)).

    Yields lists of pieces that fill a window. Leaves less than a window unless ``last``; then windows shrink to powers of two.
    """
    total = sum(length * len(pieces) for length, pieces in pool.items())
    while total >= capacity or (last and total):
        window = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        lengths = sorted((x for x in pool if pool[x]), reverse=True)
        first = next((x for x in lengths if x <= window), 0)
        used = defaultdict(int, {first: 1} if first else {})
        counts = [(x, len(pool[x]) - used[x]) for x in lengths]
        for length, n in closest_filling([c for c in counts if c[1]], window - first).items():
            used[length] += n
        used = {k: v for k, v in used.items() if v}
        gap = window - sum(k * v for k, v in used.items())
        donor = max((x for x in lengths if x > gap and len(pool[x]) > used.get(x, 0)), key=lambda x: len(pool[x]) - used.get(x, 0)) if gap else 0
        times = min(len(pool[x]) // (used.get(x, 0) + (x == donor)) for x in {*used, donor} if x)
        for _ in range(times if window == capacity else 1):
            pieces = [pool[x].pop() for x, n in used.items() for _ in range(n)]
            if gap:
                doc, start, ids, doc_tokens = pool[donor].pop()
                pieces.append((doc, start, ids[:gap], doc_tokens))
                pool[donor - gap].append((doc, start + gap, ids[gap:], doc_tokens))
            total -= window
            yield pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", pool_tokens: int = POOL) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids`` (little-endian unsigned 32 bits), ``doc_tokens, sequence_id, offset``.

    A document is its token ids and then id 0; a null text is empty, so such a document is the one id 0. Rows that
    repeat a document id are packed each for itself. ``sequence_id`` has the partition in its upper bits. An empty table gives no rows. Other
    columns are not read.
    """

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        pool: dict[int, list] = defaultdict(list)
        waiting, rows = 0, []

        def put(pieces):
            nonlocal number
            offset = 0
            for doc, start, ids, doc_tokens in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), doc_tokens, number, offset))
                offset += len(ids)
            number += 1

        def drain(least):
            nonlocal rows
            while len(rows) > least:
                part, rows = rows[:4096], rows[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), TYPES)], NAMES)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text, vocabulary), END_ID], "<u4")
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    put([(doc, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids):
                    pool[len(ids) - whole].append((doc, whole, ids[whole:].copy(), len(ids)))
                    waiting += len(ids) - whole
                if waiting >= pool_tokens:
                    for pieces in fill(pool, capacity, last=False):
                        put(pieces)
                    waiting = sum(x * len(p) for x, p in pool.items())
                yield from drain(4096)
        for pieces in fill(pool, capacity, last=True):
            put(pieces)
            yield from drain(4096)
        yield from drain(0)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def op1_packing(spark, sf_dir):
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
