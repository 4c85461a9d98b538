"""Sections, chunks, table shapes and coverage of extracted documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 3500
#: Headings closer than this to the last kept one are merged with it.
HEADING_GAP = 8


def section_scores(pages: DataFrame, page_id: str, text: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """Each page's section: the one with most keyword hits, the first named on ties; ``none`` without hits."""
    hits = [
        F.struct(F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda n, w: n + F.when(F.contains(text, w), 1).otherwise(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("section"))
        for i, (name, words) in enumerate(keywords.items())
    ]
    best = pages.select(page_id, F.array_max(F.array(*hits)).alias("b"))
    return best.select(page_id, F.when(F.col("b.n") > 0, F.col("b.section")).otherwise("none").alias("section"), F.col("b.n").cast("long").alias("n_hits"))


def heading_spans(pages: DataFrame, page_id: str, text: str, pattern: str) -> DataFrame:
    """``page_id, heading, start, stop`` (0-based characters): a section runs to the next kept heading, the last to the page's end."""

    def spans(frames):
        import re

        import pandas as pd

        find = re.compile(pattern)
        for pdf in frames:
            rows = []
            for pid, body in zip(pdf[page_id], pdf[text].fillna("")):
                kept = []
                for m in find.finditer(body):
                    if not kept or m.start() - kept[-1][0] >= HEADING_GAP:
                        kept.append((m.start(), m.group()))
                ends = [s for s, _ in kept[1:]] + [len(body)]
                rows += [(pid, h, s, e) for (s, h), e in zip(kept, ends)]
            yield pd.DataFrame(rows, columns=[page_id, "heading", "start", "stop"])

    return pages.select(page_id, text).mapInPandas(spans, f"{page_id} long, heading string, start long, stop long")


def packed_chunks(docs: DataFrame, doc_id: str, text: str, limit: int = CHUNK) -> DataFrame:
    """``doc_id, seq, chunk``: paragraphs joined while they fit ``limit`` characters; a longer paragraph is cut hard. Nothing is lost but line ends."""

    def chunks(body):
        held = ""
        for para in body.split("\n"):
            for i in range(0, len(para), limit):
                piece = para[i : i + limit]
                if held and len(held) + 1 + len(piece) > limit:
                    yield held
                    held = ""
                held = f"{held}\n{piece}" if held else piece
        if held:
            yield held

    def made(ids, seqs, found):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int64()), pa.array(found, pa.string())], [doc_id, "seq", "chunk"])

    def run(batches):
        for batch in batches:
            ids, seqs, found, size = [], [], [], 0
            for i in range(batch.num_rows):  # one text is decoded at a time; chunks leave by the megabyte
                did = batch.column(0)[i].as_py()
                for seq, chunk in enumerate(chunks(batch.column(1)[i].as_py() or "")):
                    ids.append(did), seqs.append(seq), found.append(chunk)
                    size += len(chunk)
                    if size >= 1 << 20:
                        yield made(ids, seqs, found)
                        ids, seqs, found, size = [], [], [], 0
            if ids:
                yield made(ids, seqs, found)

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} long, seq long, chunk string")


def merged_rows(rows: DataFrame, table: str, ordinal: str, cells: str) -> DataFrame:
    """Rows whose first cell is empty continue the row before them; their cells are appended, cell by cell.

    A running count of rows that open a new one numbers them; the cells of one number are then joined by position. All happens behind one shuffle by table, also if ``rows`` come
    dealt by table already; a row without cells adds none.
    """
    opens = (F.coalesce(F.trim(F.get(cells, 0)), F.lit("")) != "").cast("int")
    w = Window.partitionBy(table).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.select(table, ordinal, cells).withColumn("_row", F.sum(opens).over(w))
    parts = numbered.groupBy(table, "_row").agg(F.min(ordinal).alias(ordinal), F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(cells).alias("c"))).alias("_parts"))

    def joined(at):
        said = F.filter(F.transform("_parts", lambda r: F.struct(r["o"].alias("o"), F.trim(F.get(r["c"], at)).alias("c"))), lambda x: x["c"] != "")
        return F.nullif(F.concat_ws(" ", F.transform(F.array_sort(said), lambda x: x["c"])), F.lit(""))

    width = F.greatest(F.array_max(F.transform("_parts", lambda r: F.size(r["c"]))), F.lit(1))
    return parts.select(table, ordinal, F.transform(F.sequence(F.lit(0), width - 1), joined).alias(cells))


def contained(spans: DataFrame, sources: DataFrame, span_id: str, source_id: str, text: str) -> DataFrame:
    """``span_id, source_id`` of every span that is a literal part of a source.

    The longest inner word of a span must be a word of the source, so an equality join on words finds the candidates, and the literal
    check decides; no span is tried on every source. Of a span of one or two words the longest must be a whole word of the source. Null and empty spans are in none.
    """
    words = F.split(F.col(text), r"\s+", -1)
    longest = lambda part: F.array_max(F.transform(F.filter(part, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    own = spans.select(span_id, F.col(text).alias("_span"), F.coalesce(longest(inner), longest(words)).alias("_key"))
    every = sources.select(source_id, F.col(text).alias("_text"), F.explode(F.array_distinct(words)).alias("_key"))
    return every.join(own, "_key").where(F.contains("_text", F.col("_span"))).select(span_id, source_id)


def melted(df: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide columns to rows, named anew; nulls leave."""
    return df.unpivot(keys, list(columns), name, value).where(F.col(value).isNotNull()).replace(columns, subset=[name])


def table_quality(cells: Column) -> Column:
    """BROKEN if most cells are empty, SUSPICIOUS if many are or if a cell is very long, else NORMAL."""
    n = F.greatest(F.size(cells), F.lit(1))
    empty = F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""))
    longest = F.array_max(F.transform(cells, lambda c: F.length(F.coalesce(c, F.lit("")))))
    return F.when((F.size(cells) == 0) | (empty / n > 0.6), "BROKEN").when((empty / n > 0.3) | (longest > 300), "SUSPICIOUS").otherwise("NORMAL")


def fallback_cascade(candidates: DataFrame, keys: list[str], priority: str, quality: str) -> DataFrame:
    """The first source by priority, replaced by a later one only if that is NORMAL and the first is not."""
    order = F.struct((F.col(quality) != "NORMAL").cast("int"), F.col(priority))
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(priority, quality), order).alias("x")).select(*keys, "x.*")


def presence(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key which fields have a value, which are missing, and the status."""
    have = df.groupBy(key).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in fields])
    missing = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in fields]))
    return have.select(key, F.concat_ws(",", missing).alias("missing"), F.when(F.size(missing) == 0, "success").when(F.size(missing) < len(fields), "warning").otherwise("failed").alias("status"))
