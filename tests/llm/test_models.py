import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality_gbt as Q
from factloom.llm import toxicity_cnn as X
from tests.llm.helpers import SF, documents


def slow_counts(text):
    """The contract's counts by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\ny\nx\n \nx ", "# $ % & | < > *", "é 한   \x85 \x1c z", "a b a b a b a b", "same line\nsame line\n" * 30, "word " * 3000]


def test_counts():
    rng = random.Random(2)
    more = ["".join(rng.choices("ab \n#", k=rng.randint(0, 80))) for _ in range(200)]
    for t in [*TEXTS[:-1], *more]:
        assert Q.statistics(t)[0] == slow_counts(t), t


def test_counts_of_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op9_quality(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        if len(docs[r.doc_id]) < 3000:
            assert [r[c] for c in Q.COUNTS] == slow_counts(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def data(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 1] < 0.7) ^ (rng.random(n) < 0.05)).astype(float)
    return x, y


def test_forest_learns_and_is_monotone():
    x, y = data()
    f = Q.boost(x, y, [-1, 0, 0, -1])
    hx, hy = data(seed=1)
    assert ((f.probabilities(hx) > 0.5) == hy).mean() > 0.93
    for j in (0, 3):
        low, high = hx.copy(), hx.copy()
        high[:, j] = low[:, j] + np.random.default_rng(3).random(len(hx))
        assert (f.margins(high) <= f.margins(low) + 1e-12).all()


def test_flat_arrays_match_a_walk():
    x, y = data(400)
    f = Q.boost(x, y, [0] * 4, trees=10)

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.cut[node] else f.right[node]
        return f.value[node]

    assert np.allclose(f.margins(x[:50]), [f.base + sum(walk(r, row) for r in f.roots) for row in x[:50]])


@pytest.mark.parametrize("y", [[], [1.0] * 20, [0.0] * 20])
def test_forest_without_two_classes(y):
    f = Q.boost(np.zeros((len(y), 4)), np.array(y), [0] * 4)
    assert np.isfinite(f.probabilities(np.zeros((3, 4)))).all()


def test_quality_edges(spark):
    docs = documents(spark, *TEXTS, extra=True)
    forest = Q.boost(*(a[:200] for a in (np.random.default_rng(0).random((200, len(Q.FEATURES))), np.arange(200) % 2.0)), list(Q.FEATURES.values()))
    rows = Q.judged(docs, forest).collect()
    assert len(rows) == len(TEXTS) and all(isinstance(r.kept, bool) and not r.kept for r in rows if r.n_words < 50)
    assert Q.judged(docs.where("false"), forest).count() == 0
    labels = spark.createDataFrame([(0, None), (None, 1), (99, 0)], "doc_id long, quality int")
    assert Q.fit(docs, labels).roots.size == 0
    assert Q.fit(docs.where("false"), labels.where("false")).roots.size == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in Q.op9_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.25


def test_toxicity_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in X.op10_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_toxicity_takes_several_words_and_whole_texts():
    rng = random.Random(1)
    words = ["tala", "miro", "sen", "vado", "kel", "runa", "pesh", "dorn"]
    clean = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(120)]
    toxic = []
    for t in clean[:60]:
        w = t.split()
        for _ in range(2):
            w.insert(rng.randrange(len(w)), "zorgf" + rng.choice(["en", "ut", "ik", "ol"]))
        toxic.append(" ".join(w))
    one = [t + " zorgfen" for t in clean[60:80]]
    m = X.train(toxic + one + clean[80:], np.array([1.0] * 60 + [0.0] * 60), epochs=20)
    assert m.score("tala miro zorgfax sen zorgfem vado kel") > 0.5 > m.score("tala miro sen vado kel")
    long = " ".join(rng.choices(words, k=2 * X.BLOCK))
    assert m.score(long) < 0.5 < m.score(long + " zorgfen tala zorgfut")
    assert m.score(None) == m.score("") == m.score("... 123")
    split = "tala " * (X.BLOCK - 1) + "zorgfen zorgfut tala"  # over the border of two blocks
    assert m.score(split) > 0.5


def test_toxicity_edges(spark):
    m = X.train([], np.array([]))
    assert 0 <= m.score("anything at all") <= 1
    assert X.train(["a", "b"], np.array([1.0, 1.0])).score("a") > 0.5
    docs = documents(spark, *TEXTS, extra=True)
    rows = X.classify(docs, m, {"": 0.5}).collect()
    assert len(rows) == len(TEXTS) and {type(r.rejected) for r in rows} == {bool}
    assert X.classify(docs.where("false"), m, {"": 0.5}).count() == 0
    labels = spark.createDataFrame([(0, None), (None, 1), (99, 0), (3, 1), (3, 1)], "doc_id long, toxic int")
    for table in (docs, docs.where("false"), docs.unionAll(docs)):
        m = X.fit(table, labels)
        assert m.score("x") >= 0
        assert X.calibrated(X.scored(table, m), labels, m) == {"": 0.5}


def test_threshold_is_by_language():
    s, good, bad = np.array([900, 800, 300, 200]), np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])
    assert 0.3 < X.threshold(s, good, bad) < 0.8
    assert X.threshold(s, good * 0, bad) == 0.5


def test_thresholds_come_from_all_labelled_rows_but_the_fitted(spark):
    rows = [(i, "de" if i % 2 else "en", (0.9 if i % 4 < 2 else 0.6) if i % 2 else (0.4 if i % 4 < 2 else 0.1)) for i in range(2000)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(2000)], "doc_id long, toxic int")
    m = X.train([], np.array([]))
    m.sample = 100
    found = X.calibrated(scores, labels, m)
    assert 0.6 < found["de"] < 0.9 and 0.1 < found["en"] < 0.4 and "" in found
    kept = X.rejecting(scores, found).where("not rejected").count()
    assert kept == 1000
    fitted = {r.label_id for r in X.sampled(X.labelled(labels), 100).collect()}
    assert 100 < len(fitted) < 300
    odd = scores.withColumn("score", F.when(F.col("doc_id").isin(*fitted), 1 - F.col("score")).otherwise(F.col("score")))
    assert X.calibrated(odd, labels, m) == found


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = documents(spark, "good words", "bad words", "x " * X.SAMPLE_BYTES)
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, toxic int")
    seen = []
    original, X.train = X.train, lambda texts, y: seen.append(texts) or original(texts, y)
    try:
        X.fit(docs.unionAll(docs).unionAll(docs), labels)
    finally:
        X.train = original
    assert len(seen[0]) <= 2 and max(map(len, seen[0]), default=0) < 20


def test_labels_language_and_ids_do_not_enter_the_score(spark):
    docs = documents(spark, "some text", "other text")
    m = X.train(["bad bad", "good one"], np.array([1.0, 0.0]))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 100).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("zz"))
    assert sorted(r.score for r in X.classify(docs, m, {"": 0.5}).collect()) == sorted(r.score for r in X.classify(moved, m, {"": 0.5}).collect())
