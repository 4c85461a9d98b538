import corpus_pipeline
from factloom.llm import packing
from factloom.llm import quality_gbt as Q
from factloom.llm import simhash_similar as M
from factloom.llm import toxicity_cnn as X
from tests.llm.helpers import SF, classes, documents

BIG = SF.replace("0.001", "0.01")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def brute_classes(rows, shingle=5, similarity=0.8):
    """Classes by all pairs of exact shingle sets; also the number of pairs of different texts."""
    sets, by = {}, {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", low) if w]
        sets[i] = frozenset(" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else frozenset()
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    empty = sorted(i for i in sets if not sets[i])
    return classes(near + list(zip(empty, empty[1:])), sets), near


def test_stages_against_brute_force(spark):
    """Each stage's decisions, recomputed row by row in plain Python from what the stage before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    model = X.fit(docs, labels)
    cuts = X.calibrated(X.scored(docs, model), labels, model)
    assert ids(clean) == sorted(r.doc_id for r in docs.collect() if model.score(r.text) < cuts.get(r.lang, cuts[""]))
    good = corpus_pipeline.quality(spark, clean, SF)
    forest = Q.fit(clean, labels)
    expected = []
    for r in clean.collect():
        counts, features = Q.statistics(r.text)
        if counts[0] and 100 * counts[4] <= 50 * counts[0] and forest.probabilities(__import__("numpy").array([features]))[0] >= 0.5:
            expected.append(r.doc_id)
    assert good.columns == docs.columns and ids(good) == sorted(expected)
    single = corpus_pipeline.near_duplicates(spark, good, SF)
    assert single.columns == docs.columns
    brute, _ = brute_classes([(r.doc_id, r.text) for r in good.collect()])
    assert ids(single) == sorted(set(brute.values()))
    pieces = corpus_pipeline.packed(spark, single, SF)
    assert sorted({r.doc_id for r in pieces.collect()}) == ids(single)
    again = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {x[0] for x in again} == set(ids(single))
    assert sum(x[2] for x in again) == sum(len(packing.encode(r.text)) + 1 for r in single.collect())


def test_labelled_documents_keep_or_leave(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    clean = set(ids(corpus_pipeline.toxicity(spark, docs, BIG)))
    toxic, fine = [i for i in labels if labels[i].toxic == 1], [i for i in labels if labels[i].toxic == 0]
    assert sum(i in clean for i in toxic) <= 0.05 * len(toxic) and sum(i in clean for i in fine) >= 0.98 * len(fine)
    good = set(ids(corpus_pipeline.quality(spark, docs, BIG)))
    assert sum(i in good for i in labels if labels[i].quality == 1) >= 0.97 * sum(labels[i].quality == 1 for i in labels)
    assert sum(i in good for i in labels if labels[i].quality == 0) <= 0.15 * sum(labels[i].quality == 0 for i in labels)


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute, _ = brute_classes(rows)
    for dense in (2, M.DENSE):
        got = {r.doc_id: r.component_id for r in M.near_duplicates(docs, dense=dense).collect()}
        missed = [i for i in brute if brute[i] != i and got[i] == i]
        assert set(got) == set(brute) and len(missed) <= 0.02 * sum(brute[i] != i for i in brute)
        assert all(got[i] == i for i in brute if brute[i] == i)


def test_plan_of_large_tables_against_all_pairs(spark, monkeypatch):
    """The plan that tables above ``FEW`` fingerprints take, on a small one."""
    monkeypatch.setattr(M, "FEW", 0)
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    brute, near = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs).collect()}
    missed = [i for i in brute if brute[i] != i and got[i] == i]
    print("missed", len(missed), "of", sum(brute[i] != i for i in brute), "pairs", len(near))
    assert set(got) == set(brute) and len(missed) <= 0.05 * sum(brute[i] != i for i in brute)
    assert all(got[i] == i for i in brute if brute[i] == i)


def test_large_groups_of_near_copies_are_whole(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(400):  # each copy has one word changed, so two of them share about nine tenths of their shingles
        copy = list(base)
        copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"y{rng.randrange(5000)}" for _ in range(60)) for _ in range(50)]
    got = [r.component_id for r in sorted(M.near_duplicates(documents(spark, *texts), dense=8).collect())]
    assert got == [0] * 400 + list(range(400, 450))


def test_near_duplicates_on_odd_tables(spark):
    docs = documents(spark, None, "", " \t", "a b", "A  b", "a b c d e", "a b c d e f", extra=True)
    assert sorted((r.doc_id, r.component_id) for r in M.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6)]
    assert M.near_duplicates(docs.where("false")).count() == 0
    assert sorted(r.component_id for r in M.near_duplicates(docs.unionAll(docs)).collect()) == sorted(2 * [0, 0, 0, 3, 3, 5, 6])
    none = docs.withColumn("doc_id", __import__("pyspark").sql.functions.lit(None).cast("long"))
    assert [r.component_id for r in M.near_duplicates(none).collect()] == [None] * 7


def test_stages_on_odd_tables(spark):
    docs = documents(spark, None, "", "a", "a", "word " * 60, "one two three four five six " * 20, extra=True)
    for table in (docs, docs.unionAll(docs), docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= 100
            if name != "packing":  # own columns whose names clash come through unchanged
                assert out.columns == table.columns
                assert {tuple(r)[5:] for r in out.collect()} <= {("own",) * (len(table.columns) - 5)}


def test_same_classes_on_tables_of_any_size(spark, monkeypatch):
    """The number of fingerprints spreads the work and changes no class, candidate or probe."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(400)
    plans, own = [], M.candidates
    monkeypatch.setattr(M, "candidates", lambda fps, plan, dense, *more: (plans.append(plan), own(fps, plan, dense, *more))[1])
    got = []
    for few in (1 << 22, 200):
        monkeypatch.setattr(M, "FEW", few)
        got.append(sorted((r.doc_id, r.component_id) for r in M.near_duplicates(docs).collect()))
    assert got[0] == got[1] and plans[0] == plans[1]
