"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy arrays.

Every statistic is taken over the whole text. The trees are fitted on the driver over a bounded, documented sample of
labelled rows' statistics (numbers, no texts), with monotonic constraints: more of a bad sign can never raise a score.
For scoring, all trees' nodes lie in flat arrays and a batch of rows walks down all trees at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import appended, others, slices

#: At most about so many labelled rows are fitted.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTERS, UPPER, DIGITS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"[!?.,;:]")
SPACES = " \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The features and the sign of each one's constraint (-1: more of it never raises the score; 0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": -1,
    "mark_share": 0, "bang_share": -1, "pipe_share": -1, "letter_share": 0, "distinct_share": 0, "line_words": 0, "top_word_share": 0,
}


def repeated_words(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Marks the words that stand in a three-word window which occurs at least twice. ``ids``: a number for each word."""
    marked = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return marked
    pairs = ids[:-1] * distinct + ids[1:]  # below distinct ** 2
    _, pair_ids = np.unique(pairs, return_inverse=True)
    _, at, n = np.unique(pair_ids[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[at] > 1)
    for k in range(3):
        marked[twice + k] = True
    return marked


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the five counts, the features) of a whole text. Words stand between ASCII white space; null: a text without words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    symbols = len(SYMBOLS.findall(text))
    repeated = int(repeated_words(ids, len(known)).sum())
    counts = [n, chars, symbols, len(lines) - len(set(lines)), repeated]
    per_char, per_word = 1 / max(1, chars), 1 / max(1, n)
    most = int(np.bincount(ids).max()) if n else 0
    features = [
        np.log1p(n), chars * per_word, symbols * per_char, counts[3] / max(1, len(lines)), repeated * per_word,
        len(UPPER.findall(text)) * per_char, len(DIGITS.findall(text)) * per_char, len(MARKS.findall(text)) * per_char, text.count("!") * per_word,
        text.count("|") * per_word, sum(map(len, LETTERS.findall(text))) * per_char, len(known) * per_word, n / max(1, len(lines)), most * per_word,
    ]
    return counts, features


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 4.0) -> Forest:
    """Second-order boosting of the logistic loss over binned features.

    A split on a constrained feature must keep its children's values in order, and both sides' later values stay on
    their side of the middle, so every tree is monotone. No rows or one class: a forest without trees.
    """
    f: list[int] = []
    c: list[float] = []
    le: list[int] = []
    r: list[int] = []
    v: list[float] = []
    roots: list[int] = []
    p0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p0 / (1 - p0)))
    if len(set(y.tolist())) == 2:
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(q, col, side="left") for q, col in zip(cuts, x.T)], 1)
        margin = np.full(len(y), base)

        def grow(rows, grad, hess, level, low, high):
            node = len(f)
            g, h = grad[rows].sum(), hess[rows].sum()
            own = float(np.clip(-g / (h + ridge), low, high))
            f.append(0), c.append(np.inf), le.append(node), r.append(node), v.append(own * rate)
            best = (1e-3, None)
            for j, sign in enumerate(signs if level < depth else []):
                k = len(cuts[j]) + 1
                b = binned[rows, j]
                gl, hl = np.cumsum(np.bincount(b, grad[rows], k))[:-1], np.cumsum(np.bincount(b, hess[rows], k))[:-1]
                gr, hr = g - gl, h - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2) + g * own + 0.5 * (h + ridge) * own**2
                fits = (hl >= least / 4) & (hr >= least / 4) & (sign * (wr - wl) >= 0)
                if fits.any():
                    s = int(np.argmax(np.where(fits, gain, -np.inf)))
                    if gain[s] > best[0]:
                        best = (gain[s], (j, s, wl[s], wr[s], sign))
            if best[1]:
                j, s, wl, wr, sign = best[1]
                middle = (wl + wr) / 2
                goes = binned[rows, j] <= s
                f[node], c[node] = j, float(cuts[j][s])
                le[node] = grow(rows[goes], grad, hess, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
                r[node] = grow(rows[~goes], grad, hess, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
            return node

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            start = len(f)
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
            one = Forest(np.array([start]), *(np.array(a) for a in (f, c, le, r, v)), 0.0, depth)
            margin += one.margins(x)
    return Forest(np.array(roots, np.int64), *(np.array(a) for a in (f or [0], c or [np.inf], le or [0], r or [0], v or [0.0])), base, depth)


def measured(docs: DataFrame, text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """All columns of ``docs`` with the five counts and either ``features`` or, given a forest, ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(forest)
    extra = [pa.field(c, pa.int64()) for c in COUNTS] + [pa.field("score", pa.float64()) if forest else pa.field("features", pa.list_(pa.float64()))]
    frame = docs.select(*others(docs, *(f.name for f in extra)))
    place = [c.lower() for c in frame.columns].index(text_col.lower())

    def run(batches):
        for part in slices(batches):
            both = [statistics(t) for t in part.column(place).to_pylist()]
            x = np.array([b for _, b in both], np.float64).reshape(-1, len(FEATURES))
            last = pa.array(held.value.probabilities(x)) if held.value else pa.array(x.tolist(), pa.list_(pa.float64()))
            counts = [pa.array(c, pa.int64()) for c in zip(*(a for a, _ in both))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), *counts, last], schema=pa.schema([*part.schema, *extra]))

    return appended(frame, run, *(f"{c} long" for c in COUNTS), "score double" if forest else "features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on up to about ``sample`` labelled ids, chosen by a hash of the id, one row of statistics for each.

    Null labels and labels without a document are not used; of several labels of one id the smaller counts, of several rows the one with the smallest statistics.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))  # bounded, so its join is a broadcast
    joined = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "label_id")
    rows = measured(joined).groupBy("label_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    rows = rows.toPandas().sort_values("label_id", kind="stable")
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return boost(x, rows["quality"].to_numpy(np.float64), list(FEATURES.values()))


def judged(docs: DataFrame, forest: Forest, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, the five counts, ``base_failed``, ``score`` and ``kept``. A row for each row.

    Null and empty texts fail the base rules (with ``min_words`` of 1 or more). Columns of ``docs`` that have one of these names give way.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured(docs.select(*others(docs, "base_failed", "kept")), text_col, forest)
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_AT))


def op9_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, forest).select("doc_id", *COUNTS, "base_failed", "kept", "score")
