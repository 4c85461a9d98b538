"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole. A byte-level token covers a known number of bytes, so the running
sum of token widths gives every token's span; an interval join with the sections' spans (a binary search, as both are
ordered) attributes it. A token that crosses a boundary belongs to the section that holds its first byte, or with
``rule="most"`` to the one that holds most of its bytes (the first of those, if several do). So every token counts once, and the sections' counts add up to
the document's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.packing import encode, encoders

SEPARATOR = "\n"
NAMES = ["doc_id", "field", "section", "start_byte", "end_byte", "n_tokens", "n_crossing"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


@lru_cache(4)
def widths(vocabulary: str) -> np.ndarray:
    """Bytes that each token id covers."""
    fast, exact = encoders(vocabulary)
    size = exact.get_vocab_size(with_added_tokens=True)
    out = np.zeros(size, np.int64)
    for i in range(size):
        try:
            out[i] = len(fast.decode_single_token_bytes(i))
        except KeyError:  # an added token stands for its own text
            out[i] = len(exact.id_to_token(i).encode())
    return out


def attribute(ids: np.ndarray, bounds: np.ndarray, vocabulary: str, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross the section's end) by section. ``bounds``: the sections' ends, ascending; they cover the text."""
    w = widths(vocabulary)[ids]
    ends = np.cumsum(w)
    starts = ends - w
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    home = first.copy()
    for t in np.flatnonzero(first < last) if rule == "most" else ():
        cuts = np.concatenate(([starts[t]], bounds[first[t] : last[t]], [ends[t]]))
        home[t] += int(np.argmax(np.diff(cuts)))
    n = len(bounds)
    return np.bincount(home, minlength=n), np.bincount(first[first < last], minlength=n)


def token_counts(docs: DataFrame, fields: list[str], id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k", rule: str = "first") -> DataFrame:
    """A row for each section (a line with its line end) of each field: ``doc_id, field, section`` (from 0), ``start_byte, end_byte,
    n_tokens, n_crossing``.

    Fields are joined by a line end, which belongs to the field before it. A null or empty field has one section without bytes (but
    for that line end). Each row of ``docs`` is attributed for itself; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for doc, *texts in zip(batch.column(0).to_pylist(), *columns):
                owners, sizes = [], []
                for k, (name, text) in enumerate(zip(fields, texts)):
                    own = (text or "") + (SEPARATOR if k + 1 < len(fields) else "")
                    lines = [x for x in own.split("\n")]
                    parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
                    owners += [(name, i) for i in range(len(parts))]
                    sizes += [len(p.encode()) for p in parts]
                whole = SEPARATOR.join(t or "" for t in texts)
                bounds = np.cumsum(np.array(sizes, np.int64))
                count, cross = attribute(np.array(encode(whole, vocabulary), np.int64), bounds, vocabulary, rule)
                rows += [(doc, *o, b - s, b, n, c) for o, s, b, n, c in zip(owners, sizes, bounds.tolist(), count.tolist(), cross.tolist())]
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields)])
    return frame.mapInArrow(run, "doc_id long, field string, section long, start_byte long, end_byte long, n_tokens long, n_crossing long")


def op5_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "text"])
