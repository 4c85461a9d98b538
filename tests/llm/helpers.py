"""Brute-force counterparts used by several tests."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names clash with those that the operators make
        from pyspark.sql import functions as F

        for c in ("score", "kept", "fp", "rank", "n_tokens", "predicted", "features", "n_words", "label_id", "Toxic", "quality", "shingles", "key", "rep", "f0", "_row", "Rejected", "base_failed", "a`b c", "x.y"):
            df = df.withColumn(c, F.lit("own"))
    return df


def classes(pairs, nodes):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
