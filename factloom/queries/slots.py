"""Slots of questions and the second round of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans import second_round as R
from factloom.queries.base import query
from factloom.queries.retrieval import TOKENS

#: Rules for the invented prose: which words of a passage ask for which slot.
RULES = [
    R.SlotRule("named", r"(?i)(^|[^\p{L}])(the|le|der|la)([^\p{L}]|$)", ("re", "en", "ci"), r"[A-Z][a-z]+, [a-z]+"),
    R.SlotRule("listed", r"(?i)(^|[^\p{L}])(and|et|und|que)([^\p{L}]|$)", ("ing", "eau", "ung", "mente"), r"\|"),
    R.SlotRule("short", r"^\S+ \S{1,6} ", (), r"[a-z]{14,}"),
]
SCORE = "sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / mean)))"
LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
WIDE = "right(array_to_string(p[greatest(r.i - 80, 1):r.i - 1], ''), 80) || p[r.i] || left(array_to_string(p[r.i + 1:r.i + 140], ''), 140)"


def state_sql(name: str, hits: str) -> str:
    return f"""{name} AS (SELECT query_id, slot, CASE WHEN n > 0 THEN 'FOUND' ELSE 'MISSING' END AS state, terms, coalesce(n, 0) AS n_quotes FROM slots LEFT JOIN (SELECT query_id, slot, least(count(*), 3) AS n FROM slots JOIN {hits} USING (query_id) JOIN said USING (doc_id)
 WHERE (len(terms) = 0 OR len(list_filter(terms, lambda y: contains(x, y))) > 0) AND regexp_matches(x, value) GROUP BY ALL) USING (query_id, slot))"""


SQL = f"""WITH corpus AS (SELECT doc_id, source AS file, {TOKENS.format('text')} AS k, len(k) AS dl FROM documents), stats AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS mean FROM corpus),
tf AS (SELECT doc_id, file, dl, term, count(*) AS tf FROM (SELECT doc_id, file, dl, unnest(k) AS term FROM corpus) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
words AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
a1 AS (SELECT query_id, term, count(*) AS qtf FROM words GROUP BY ALL), s1 AS (SELECT query_id, doc_id, round({SCORE}, 9) AS score FROM tf JOIN df USING (term) JOIN a1 USING (term), stats GROUP BY ALL),
first AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s1 WHERE score > 0 QUALIFY rank <= 5),
p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?\\n])', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM s1)),
said AS (SELECT doc_id, {WIDE} AS x FROM p, unnest(range(1, len(p) + 1)) r(i) WHERE trim(p[r.i]) <> ''),
slots AS (SELECT item_id AS query_id, slot, terms, value FROM benchmark, (VALUES {", ".join(f"('{r.slot}', '{r.asked}', {LIST(r.terms)}, '{r.value}')" for r in RULES)}) v(slot, asked, terms, value) WHERE regexp_matches(regexp_replace(text, '\\s', ' ', 'g'), asked)),
{state_sql("state", "first")},
a2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, term FROM words WHERE query_id IN (SELECT query_id FROM state WHERE state = 'MISSING') UNION ALL SELECT query_id, unnest({TOKENS.format('t')}) FROM (SELECT query_id, unnest(terms) AS t FROM state WHERE state = 'MISSING')) GROUP BY ALL),
files AS (SELECT DISTINCT query_id, source AS file FROM first JOIN documents USING (doc_id) WHERE rank <= 3),
s2 AS (SELECT query_id, doc_id, round({SCORE}, 9) AS score FROM tf JOIN df USING (term) JOIN a2 USING (term) JOIN files USING (query_id, file), stats GROUP BY ALL),
second AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s2 ANTI JOIN first USING (query_id, doc_id) WHERE score > 0 QUALIFY rank <= 8),
hits AS (SELECT query_id, doc_id FROM first UNION ALL SELECT query_id, doc_id FROM second), {state_sql("final", "hits")}"""


def run(t):
    return R.two_rounds(t("documents"), t("benchmark").select(F.col("item_id").alias("query_id"), "text"), RULES, "source")


@query(SQL + " SELECT query_id, doc_id, 1 AS round, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM first UNION ALL SELECT query_id, doc_id, 2, CAST(rank AS INTEGER), round(score, 6) FROM second")
def r13_second_round(t):
    """R-13: passages of both rounds; the second asks for what the first left missing, among the files of the first three passages."""
    return run(t)[0].select("query_id", "doc_id", "round", "rank", F.round("score", 6).alias("score"))


@query(SQL + " SELECT query_id, slot, state, n_quotes FROM final")
def r20_slot_states(t):
    """R-20, R-15: the state of each slot after both rounds; a document without the value leaves a slot missing."""
    return run(t)[1].select("query_id", "slot", "state", F.greatest(F.coalesce(F.size("quotes"), F.lit(0)), F.lit(0)).cast("long").alias("n_quotes"))
