"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's embedding is the sum of the rows that its text, its first five letters, its first four and its last four hash to, so
that inflected and made-up forms share what was learnt. Filters of several widths slide over the words; max pooling keeps the
strongest responses of each filter over the whole text (the best ``TOP``, so that one stray word and several are told
apart); a logistic layer gives the score. Training runs on the driver over a bounded, documented sample of labelled rows. The
decision threshold of each language is the one that best separates all labelled rows of that language that were not fitted; language only
picks the threshold and is no input of the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import appended, others, slices, stored

#: At most about so many labelled rows of each class are fitted, and no text of more bytes.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
#: Steps of a score in calibration; rows of either class that a language needs for its own threshold; most languages that have one.
BINS, LEAST, LANGUAGES = 1000, 5, 1000
BUCKETS, DIM, WIDTHS, FILTERS, TOP = 1 << 15, 12, (1, 2, 3), 8, 2
WORD = re.compile(r"[^\W\d_]+")
#: Words that are scored at once; pooling joins the blocks of a longer text.
BLOCK = 1 << 14


@lru_cache(1 << 15)
def rows_of(word: str) -> tuple[int, int, int, int]:
    """The embedding rows of a word."""
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, "<" + word[:5], "<" + word[:4], word[-4:] + ">"))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width, dim, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    sample: int = SAMPLE
    training_rows: object = None

    def weights(self) -> Model:
        """What scoring needs."""
        return replace(self, training_rows=None)

    def pooled(self, vectors: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``TOP`` responses of every filter, before the rectifier, and where they are. ``index``: a text's words in ``vectors``."""
        best, where = [], []
        flat = np.ascontiguousarray(vectors.T)
        for width, w in self.filters.items():
            padded = np.concatenate([index, np.full(width - 1 + TOP, len(vectors) - 1)])  # the last vector is padding
            n = len(index) + TOP
            response = (w[0].T @ flat).take(padded[:n], axis=1)  # a row for each filter
            for k in range(1, width):
                response += (w[k].T @ flat).take(padded[k : k + n], axis=1)
            each = np.arange(len(response))
            for _ in range(TOP):
                at = response.argmax(axis=1)
                best.append(response[each, at])
                where.append(at)
                response[each, at] = -np.inf
        order = [k + TOP * f for k in range(TOP) for f in range(len(self.filters))]
        return tuple(np.concatenate([x[i] for i in order]).reshape(TOP, -1) for x in (best, where))

    def vectors(self, words: list[str]) -> np.ndarray:
        rows = np.array([rows_of(w) for w in words], np.int64).reshape(-1, 4)
        return np.concatenate([self.embedding[rows].sum(1), np.zeros((1, self.embedding.shape[1]), np.float32)])

    def score(self, text: str | None) -> float:
        """0 to 1. A text without words is scored as padding alone."""
        words, best = words_of(text), None
        step = BLOCK - max(self.filters) + 1
        for i in range(0, max(1, len(words)), step):
            block = words[i : i + BLOCK]
            known: dict[str, int] = {}
            index = np.fromiter((known.setdefault(w, len(known)) for w in block), np.int64, len(block))
            found, at = self.pooled(self.vectors(list(known)), index)
            if i:  # positions that the block before has seen are not counted twice
                found = np.sort(np.concatenate([best, found]), axis=0)[::-1][:TOP]
            best = found
        z = float((np.maximum(best + self.bias, 0) * self.out).sum() + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit by Adam on single texts' gradients in small batches; classes weigh alike. Fewer than two classes: a constant model."""
    rng = np.random.default_rng(seed)
    docs = []
    df = np.zeros((2, BUCKETS), np.float64)
    for text, y in zip(texts, labels):
        known: dict[str, int] = {}
        index = np.fromiter((known.setdefault(w, len(known)) for w in words_of(text)), np.int64)
        rows = np.array([rows_of(w) for w in known], np.int64).reshape(-1, 4)
        docs.append((index, rows))
        df[int(y), np.unique(rows)] += 1
    share = (labels == 1).mean() if len(labels) else 0.0
    n = np.maximum(1, np.bincount(labels.astype(int), minlength=2))
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    sure = np.clip(odds, -3, 6) * np.minimum(1, df.sum(0) / 4)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = 0.1 * np.where(df.sum(0) >= 2, sure, 0)  # starts from the words' log odds
    total = FILTERS * len(WIDTHS)
    m = Model(embedding, {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(total, np.float32), np.zeros((TOP, total), np.float32), 0.0)
    for w in m.filters.values():
        w[0, 0, : FILTERS // 2] = 1.0
    m.bias[:] = -0.3
    m.out[0], m.out[1] = rng.normal(0, 0.05, total), rng.normal(0.2, 0.05, total)
    if share in (0.0, 1.0):
        m.out[:] = 0
        m.out_bias = 30.0 * (2 * share - 1) if len(labels) else 0.0
        return m
    m.out_bias = -1.0
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    dense = [*m.filters.values(), m.bias, m.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in dense]
    e2 = np.full((BUCKETS, 1), 1e-3, np.float32)
    b2, step = [0.0, 0.0], 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        lr = rate * (1 - epoch / epochs) + 1e-3
        for start in range(0, len(order), 16):
            grads, gb = [np.zeros_like(p) for p in dense], 0.0
            touched: dict[int, np.ndarray] = {}
            batch = order[start : start + 16]
            for i in batch:
                index, rows = docs[i]
                vec = np.concatenate([embedding[rows].sum(1), np.zeros((1, DIM), np.float32)])
                best, where = m.pooled(vec, index)
                act = np.maximum(best + m.bias, 0)
                p = 1 / (1 + np.exp(-np.clip((act * m.out).sum() + m.out_bias, -30, 30)))
                g = np.float32((p - labels[i]) * weight[i] / len(batch))
                gb += g
                grads[-1] += g * act
                back = g * m.out * (best + m.bias > 0)
                grads[-2] += back.sum(0)
                gvec = np.zeros_like(vec)
                at = 0
                for f, (width, w) in enumerate(m.filters.items()):
                    padded = np.concatenate([index, np.full(width - 1 + TOP, len(vec) - 1)])
                    part, place = back[:, at : at + FILTERS], where[:, at : at + FILTERS]
                    for k in range(width):
                        ids = padded[place + k]
                        grads[f][k] += np.einsum("tfd,tf->df", vec[ids], part)
                        np.add.at(gvec, ids.ravel(), (part[:, :, None] * w[k].T[None]).reshape(-1, DIM))
                    at += FILTERS
                for j in np.flatnonzero(np.abs(gvec[:-1]).sum(1)):
                    for r in rows[j]:
                        touched[r] = touched.get(r, 0) + gvec[j]
            step += 1
            for p, g, mom in zip(dense, grads, moments):
                mom[0] += 0.1 * (g - mom[0])
                mom[1] += 0.01 * (g * g - mom[1])
                p -= 0.2 * lr * (mom[0] / (1 - 0.9**step)) / (np.sqrt(mom[1] / (1 - 0.99**step)) + 1e-6) + 1e-4 * lr * p
            b2[0] += 0.1 * (gb - b2[0])
            b2[1] += 0.01 * (gb * gb - b2[1])
            m.out_bias -= float(0.2 * lr * (b2[0] / (1 - 0.9**step)) / (np.sqrt(b2[1] / (1 - 0.99**step)) + 1e-6))
            if touched:
                r = np.fromiter(touched, np.int64)
                g = np.array([touched[x] for x in r], np.float32)
                e2[r] += (g * g).mean(1, keepdims=True)
                embedding[r] -= lr * g / np.sqrt(e2[r])
    return m


def threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of its gap; one half where a class is missing.

    ``bins``: scores in units of 1 / ``BINS``, with the number of clean and of toxic rows at each.
    """
    if not clean.sum() or not toxic.sum():
        return 0.5
    order = np.argsort(-bins, kind="stable")
    s, good, bad = bins[order], clean[order], toxic[order]
    gain = np.cumsum(bad) / bad.sum() - np.cumsum(good) / good.sum()
    k = int(np.argmax(gain))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2 / BINS)


def labelled(labels: DataFrame, training_rows=None, id_col: str = "doc_id") -> DataFrame:
    """``label_id, toxic``: one row for each labelled id that may be learnt from. Null labels are not used; of several labels of one id the smaller counts."""
    allowed = F.lit(True) if training_rows is None else training_rows
    own = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    return own.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min("toxic").alias("toxic"))


def sampled(own: DataFrame, sample: int) -> DataFrame:
    """Those of ``own`` that are fitted: up to about ``sample`` ids of each class, by a hash of the id, and never all, so that some are left for the thresholds."""
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    part = lambda y: F.lit(min(0.8, sample / max(1, sizes.get(y, 0))))
    share = F.when(F.col("toxic") == 1, part(1)).otherwise(part(0))
    return own.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < share * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, training_rows=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the sample. ``training_rows``: a condition on the labels' ``doc_id``. Labels without a document are not used.

    One text for each id, and none of over ``SAMPLE_BYTES`` bytes, so what reaches the driver is bounded in rows and bytes. The documents meet only
    the chosen ids, whose number is bounded, so that join is a broadcast.
    """
    chosen = sampled(labelled(labels, training_rows), sample)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "label_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).toPandas().sort_values("label_id", kind="stable")
    model = train(rows["text"].tolist(), rows["toxic"].to_numpy(np.float64))
    model.sample, model.training_rows = sample, training_rows
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``. Null and empty texts are scored as texts without words. A column called ``score`` gives way."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights())
    frame = docs.select(*others(docs, "score"))
    place = [c.lower() for c in frame.columns].index(text_col.lower())

    def run(batches):
        m = held.value
        for part in slices(batches):
            scores = np.fromiter((m.score(x.as_py()) for x in part.column(place)), np.float64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(scores)], schema=pa.schema([*part.schema, pa.field("score", pa.float64())]))

    return appended(frame, run, "score double")


def calibrated(scores: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", lang_col: str = "lang", **_) -> dict[str, float]:
    """The threshold of each language, and under '' the one over all, from every labelled row that was not fitted.

    ``scores``: rows with id, language and ``score``; only (language, score in ``BINS`` steps, label) counts leave the cluster. Languages with fewer than ``LEAST``
    rows of either class take the threshold over all, and so do all beyond the ``LANGUAGES`` with the most labels.
    """
    own = labelled(labels, model.training_rows)
    own = own.join(sampled(own, model.sample).select("label_id"), "label_id", "left_anti")
    at = F.floor(F.col("score") * BINS).cast("long")
    rows = scores.select(F.col(id_col).cast("long").alias("label_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), at.alias("bin"))
    count = lambda y: F.count_if(F.col("toxic") == y)
    bins = stored(rows.join(own, "label_id").groupBy("lang", "bin").agg(count(0).alias("clean"), count(1).alias("toxic")), "bins")
    per = bins.groupBy("lang").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where((F.col("c") >= LEAST) & (F.col("t") >= LEAST) & (F.col("lang") != ""))
    some = per.orderBy((F.col("c") + F.col("t")).desc(), "lang").limit(LANGUAGES)
    overall = bins.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("lang", F.lit(""))
    found = bins.join(F.broadcast(some), "lang", "left_semi").unionByName(overall).toPandas()
    return {"": 0.5} | {lang: threshold(*(rows[c].to_numpy(np.float64) for c in ("bin", "clean", "toxic"))) for lang, rows in found.sort_values(["lang", "bin"]).groupby("lang")}


def rejecting(scores: DataFrame, thresholds: dict[str, float], lang_col: str = "lang") -> DataFrame:
    """``scores`` with ``predicted`` (score >= 0.5) and ``rejected`` (at or above the language's threshold; unknown languages take the one over all)."""
    cuts = F.create_map(*(F.lit(x) for pair in sorted(thresholds.items()) for x in pair))
    cut = F.coalesce(F.try_element_at(cuts, F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), F.lit(thresholds[""]))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("rejected", F.col("score") >= cut)


def classify(docs: DataFrame, model: Model, thresholds: dict[str, float], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` and ``score``, ``predicted``, ``rejected``. Columns of ``docs`` with one of these names give way."""
    return rejecting(scored(docs.select(*others(docs, "predicted", "rejected")), model, text_col), thresholds, lang_col)


def fold(id_col: str = "doc_id") -> F.Column:
    """0 for the rows that are held out of all training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, training_rows=fold() != 0)
    scores = stored(scored(docs, model).drop("text"), "scores")
    judged = rejecting(scores, calibrated(scores, labels, model))
    return judged.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "rejected")
