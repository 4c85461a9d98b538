"""Spans of a source that say a passage with a few words changed, and the status of a passage by them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A span is an anchor if at least so many per cent of the passage's words stay.
PERCENT = 58
#: Longest runs of words by which candidates are found.
LONGEST = 3


def word_list(text: Column) -> Column:
    """The words of a text in lower case, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs(words: Column, length: Column) -> Column:
    """A number for each run of ``length`` words, repeats included; none if there are fewer words."""
    return F.when(F.size(words) >= length, F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), lambda i: F.xxhash64(length, F.slice(words, i, length)))).otherwise(F.array().cast("array<bigint>"))


def edits(where: dict[str, int], m: int, words: Iterable[str], anchored: bool) -> Iterator[int]:
    """After each word the fewest edits from the ``m`` words of a passage (``where``: a word's places as bits) to a span that ends there.

    Spans start anywhere, or at the first word if ``anchored``. A column of the edit table is held as two bit sets of its differences, so a word takes a few operations on whole numbers.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = full, 0, m
    for word in words:
        here = where.get(word, 0)
        vertical = here | down
        across = (((here & up) + up) ^ up) | here
        more, less = down | (full & ~(across | up)), up & across
        cost += 1 if more & top else -1 if less & top else 0
        more, less = ((more << 1) | anchored) & full, (less << 1) & full
        up, down = less | (full & ~(vertical | more)), more & vertical
        yield cost


def best_span(passage: list[str], words: list[str], most: int) -> tuple[int, int, int] | None:
    """``(edits, start, n_words)`` of the span with the fewest edits, at most ``most``: of several the one that ends first, of those the shortest."""
    m, places, back = len(passage), {}, {}
    for i, w in enumerate(passage):
        places[w] = places.get(w, 0) | 1 << i
        back[w] = back.get(w, 0) | 1 << (m - 1 - i)
    cost, end = min(((c, i) for i, c in enumerate(edits(places, m, words, False), 1)), default=(most + 1, 0))
    if cost > most:
        return None
    n = next(i for i, c in enumerate(edits(back, m, reversed(words[max(0, end - m - most) : end]), True), 1) if c == cost)
    return cost, end - n, n


def approximate_spans(passages: DataFrame, sources: DataFrame, passage_id: str, source_id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """``passage_id, source_id, edits, start, n_words``: the best span (see ``best_span``; places count words from 0) of every source that keeps ``percent`` (1 to 100) of a passage's words.

    A passage of m words with at most k edits leaves m - q + 1 - k*q of its runs of q words or more as they are, in a span of m + k words at most; q is the longest for which that is one or more.
    So a source is read in windows of twice that width, one beginning with every width, and only windows that hold so many of the passage's runs are aligned. Nothing is lost. Sources are dealt by id
    once; their runs meet the passages' in an equality join and are counted where they lie, as long as the passages' runs are few enough to go to every task.
    Both ids are unique; rows without one, and passages without words (null too), give no rows.
    """
    spare = 100 - percent
    longest = min(LONGEST, 100 // spare) if spare else LONGEST
    m, k, q = F.size("_p"), F.col("_k"), F.col("_q")
    own = passages.select(F.col(passage_id).alias("_id"), word_list(F.col(text)).alias("_p")).where("_id is not null and size(_p) > 0").withColumn("_k", F.floor(spare * m / 100).cast("int"))
    own = own.withColumn("_q", F.least(F.lit(longest), F.floor(m / (k + 1)).cast("int")))
    asked = own.select("_id", (m - q + 1 - k * q).alias("_least"), (m + k).alias("_wide"), F.explode(F.array_distinct(runs(F.col("_p"), q))).alias("_run"))
    lengths = sorted(r[0] for r in own.select("_q").distinct().collect())  # LONGEST at most
    texts = sources.select(F.col(source_id).alias("_source"), F.col(text).alias("_text")).where("_source is not null").repartition("_source").select("_source", word_list(F.col("_text")).alias("_words"))
    most = max(lengths, default=1)
    ahead = F.arrays_zip(*[F.slice(F.col("_words"), n, F.greatest(F.size("_words"), F.lit(1))).alias(f"_w{n}") for n in range(1, most + 1)])
    words = texts.select("_source", F.posexplode(ahead).alias("_at", "_x")).select("_source", "_at", "_x.*")
    each = [F.when(F.col(f"_w{n}").isNotNull(), F.xxhash64(F.lit(n), F.array(*[f"_w{i}" for i in range(1, n + 1)]))) for n in lengths or [1]]  # as ``runs`` makes them
    met = words.select("_source", "_at", F.explode(F.array(*each)).alias("_run")).join(asked, "_run")
    window = F.floor(F.col("_at") / F.col("_wide")).cast("int")
    held = met.select("_source", "_id", "_least", "_wide", F.explode(F.array(window, window - 1)).alias("_window")).where("_window >= 0")
    full = held.groupBy("_source", "_id", "_window", "_least", "_wide").agg(F.count("*").alias("_n")).where("_n >= _least").groupBy("_source", "_id", "_wide").agg(F.collect_list("_window").alias("_windows"))
    begins = F.transform("_windows", lambda w: w * F.col("_wide"))
    pieces = F.transform("_windows", lambda w: F.slice(F.col("_words"), w * F.col("_wide") + 1, 2 * F.col("_wide")))
    both = full.join(texts, "_source").select("_source", "_id", begins.alias("_begins"), pieces.alias("_pieces")).join(own.select("_id", "_p", "_k"), "_id")

    def align(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for pid, sid, begins, pieces, passage, most in zip(pdf["_id"], pdf["_source"], pdf["_begins"], pdf["_pieces"], pdf["_p"], pdf["_k"]):
                found = [(span[0], int(begin) + span[1], span[2]) for begin, words in zip(begins, pieces) if (span := best_span(list(passage), list(words), int(most)))]
                if found:
                    rows.append((pid, sid, *min(found, key=lambda x: (x[0], x[1] + x[2], x[2]))))
            yield pd.DataFrame(rows, columns=["_id", "_source", "edits", "start", "n_words"])

    kinds = {f.name: f.dataType for f in both.schema.fields}
    shape = T.StructType([T.StructField("_id", kinds["_id"]), T.StructField("_source", kinds["_source"]), *[T.StructField(c, T.LongType()) for c in ("edits", "start", "n_words")]])
    return both.mapInPandas(align, shape).select(F.col("_id").alias(passage_id), F.col("_source").alias(source_id), "edits", "start", "n_words")


def anchor_status(passages: DataFrame, anchors: DataFrame, passage_id: str, source_id: str, text: str) -> DataFrame:
    """``passage_id, n_exact, n_near, best_source, status``: a row for each passage. SKIPPED without words, SUPPORTED if a source has all its words in a row, NEAR if one has most of them, else UNSUPPORTED.

    The best source has the fewest edits, of several the smallest id.
    """
    exact = F.col("edits") == 0
    counts = anchors.groupBy(passage_id).agg(F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_near"), F.min(F.struct("edits", source_id))[source_id].alias("best_source"))
    status = F.when(F.size(word_list(F.col(text))) == 0, "SKIPPED").when(F.col("n_exact") > 0, "SUPPORTED").when(F.col("n_near") > 0, "NEAR").otherwise("UNSUPPORTED")
    rows = passages.select(passage_id, text).join(counts, passage_id, "left").fillna(0, ["n_exact", "n_near"])
    return rows.select(passage_id, "n_exact", "n_near", "best_source", status.alias("status"))
