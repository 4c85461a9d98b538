"""Blocks of texts and pages, structures of regions, records across lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import blocks as B
from factloom.queries.base import query

#: Words for the invented prose, in place of the domain's: what makes a short line a name, and so on.
PROSE = B.Lexicon(
    kept="A-Za-zÀ-ÿ0-9", section="^(The|Les|Der|Los|In|An)$", category="^(Is|Are|Et|Und|Que|To)", cause="worthless|stupid", impact="ingingre|ionión", mitigation="theth", description="^(Of|De|Die|La).*(and|und|et)",
    risk="re|er|ar", possible="(on|en).*ing$", name_heads="^(Th|En|Qu|Ci|In).*$",
)

NESTED = """stop AS (SELECT a.*, coalesce(min(b.i) - 1, any_value(a.n)) AS stop FROM h a LEFT JOIN h b ON a.id = b.id AND b.i > a.i AND (b.level <= a.level OR a.level = 0) GROUP BY ALL),
around AS (SELECT a.id, a.i, a.stop, a.level, count(b.i) + 1 AS depth, max(b.i) AS parent FROM stop a LEFT JOIN stop b ON a.id = b.id AND b.i < a.i AND b.stop >= a.i AND b.level > 0 GROUP BY ALL)"""


def nested(table: str, key: str, text: str, level: str) -> str:
    return rf"""WITH l AS (SELECT {key} AS id, len(x) AS n, r.i AS i, x[r.i] AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS x FROM {table}), unnest(range(1, len(x) + 1)) r(i)),
v AS (SELECT id, n, i, {level} AS level FROM l), h AS (SELECT * FROM v WHERE level IS NOT NULL UNION ALL SELECT id, n, i, 0 FROM v WHERE i = 1 AND level IS NULL), {NESTED}
SELECT id AS {key}, i AS start, stop, level, depth, parent FROM around"""


@query(nested("documents", "doc_id", "text", r"CASE WHEN regexp_matches(line, '^\S{1,24}$') THEN 1 WHEN length(line) BETWEEN 1 AND 60 THEN 2 WHEN contains(line, ' | ') OR length(line) < 200 AND line <> '' THEN 3 END"))
def x15_nested_blocks(t):
    """X-15: nested blocks of documents: a line of one word heads what follows, within it short lines, within these middling ones and rows."""
    n = F.length
    return B.blocks(t("documents"), "doc_id", "text", lambda x: F.when(x.rlike(r"^\S{1,24}$"), 1).when(n(x).between(1, 60), 2).when(x.contains(" | ") | ((n(x) < 200) & (x != "")), 3))


@query(nested("pages", "page_id", "html", "CASE WHEN regexp_matches(line, '<(body|article)') THEN 1 WHEN regexp_matches(line, '<h[1-3]|<nav|<aside|<footer') THEN 2 WHEN regexp_matches(line, '<(p|ul|form)[ >]') THEN 3 END"))
def x15_page_blocks(t):
    """X-15: nested blocks of pages, headed by the tags that open them."""
    return B.blocks(t("pages"), "page_id", "html", lambda x: F.when(x.rlike("<(body|article)"), 1).when(x.rlike("<h[1-3]|<nav|<aside|<footer"), 2).when(x.rlike("<(p|ul|form)[ >]"), 3))


L = PROSE
LETTERS = f"regexp_replace(x, '[^{L.kept}]', '', 'g')"
ROLE = f"""CASE WHEN y = '' THEN 'other' WHEN regexp_matches(y, '{L.section}') THEN 'section' WHEN regexp_matches(y, '{L.category}') THEN 'category' WHEN regexp_matches(y, '{L.cause}') THEN 'cause' WHEN regexp_matches(y, '{L.impact}') THEN 'impact'
 WHEN regexp_matches(y, '{L.mitigation}') THEN 'mitigation' WHEN regexp_matches(y, '{L.description}') THEN 'description' WHEN length(y) <= {L.longest_name} AND (regexp_matches(y, '{L.risk}') OR regexp_matches(y, '{L.possible}')) THEN 'name' ELSE 'other' END"""
HEAD_ROLE = f"CASE WHEN regexp_matches(y, '{L.name_heads}') THEN 'name' WHEN regexp_matches(y, '{L.cause}') THEN 'cause' WHEN regexp_matches(y, '{L.impact}') THEN 'impact' WHEN regexp_matches(y, '{L.mitigation}') THEN 'mitigation' WHEN regexp_matches(y, '{L.description}') THEN 'description' ELSE 'head' END"
CLEAR = r"l AS (SELECT doc_id, i, x, {letters} AS y FROM (SELECT doc_id, r.i AS i, {trim} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS z FROM documents), unnest(range(1, len(z) + 1)) r(i)) WHERE x <> '')"


@query(
    rf"""WITH {CLEAR.format(letters=LETTERS, trim="trim(z[r.i])")}, k AS (SELECT *, {ROLE} AS role FROM l),
d AS (SELECT doc_id, coalesce(bool_or(role = 'name'), false) AS named, coalesce(bool_or(regexp_matches(x, '{B.BULLET}') AND regexp_matches(x, '{L.risk}')), false) AS bullet, coalesce(regexp_matches(string_agg(x, chr(10) ORDER BY i), '[{L.kept}() ]({L.risk})\s*[,，;；/]'), false) AS inline FROM documents LEFT JOIN k USING (doc_id) GROUP BY ALL),
c AS (SELECT doc_id, string_split(z[1], ' | ') AS cells FROM (SELECT doc_id, string_split(text, chr(10)) AS z FROM documents)), e AS (SELECT doc_id, len(cells) AS width, {LETTERS.replace("(x,", "(cells[r.j],")} AS y FROM c, unnest(range(1, len(cells) + 1)) r(j) WHERE len(cells) > 1),
f AS (SELECT doc_id, max(width) AS width, bool_or(role = 'name') AS name, count(DISTINCT role) FILTER (role IN ('cause', 'impact', 'mitigation', 'description')) AS told FROM (SELECT *, {HEAD_ROLE} AS role FROM e) GROUP BY ALL)
SELECT doc_id, CASE WHEN name AND told > 0 THEN CASE WHEN width > 2 OR told > 1 THEN 'TABLE_MULTI_COL' ELSE 'TABLE_2COL' END WHEN named AND source IN ('src1', 'src2') THEN 'VERTICAL_PAIR' WHEN bullet THEN 'BULLET' WHEN inline THEN 'INLINE' WHEN named THEN 'HEADING_PARAGRAPH' ELSE 'UNKNOWN' END AS kind FROM documents JOIN d USING (doc_id) LEFT JOIN f USING (doc_id)"""
)
def x16_region_structures(t):
    """X-16: the seven structures of a region: tables by the roles of their heads, boxed names (two sources have boxes), bullets, names within a line, headings."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cells = F.split(F.get(lines, F.lit(0)), r" \| ", -1)
    kind = B.structure(lines, F.when(F.size(cells) > 1, cells), F.size(cells), F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False)), PROSE)
    return t("documents").select("doc_id", kind.alias("kind"))


@query(
    rf"""WITH {CLEAR.format(letters=LETTERS, trim=r"trim(regexp_replace(z[r.i], '\s+', ' ', 'g'))")}, k AS (SELECT *, {ROLE} AS role FROM l),
o AS (SELECT *, CASE WHEN role IN ('section', 'category') OR (role = 'name' AND coalesce(lag(role) OVER w, '') <> 'name') THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM o)
SELECT doc_id, count(*) AS n_records, string_agg(md5(name || '=' || said), ',' ORDER BY no) AS digests FROM (SELECT doc_id, no, string_agg(x, ' ' ORDER BY i) FILTER (role = 'name') AS name, string_agg(x, ' ' ORDER BY i) FILTER (role NOT IN ('name', 'section', 'category')) AS said FROM g GROUP BY ALL) WHERE name IS NOT NULL AND said IS NOT NULL GROUP BY ALL"""
)
def x16_records(t):
    """X-15, X-16: records assembled across lines: names over several lines, then what is said until the next name or heading."""
    found = t("documents").select("doc_id", B.records(F.split("text", "\n"), PROSE).alias("r")).where(F.size("r") > 0)
    digests = F.transform("r", lambda x: F.md5(F.concat(x["name"], F.lit("="), x["text"])))
    return found.select("doc_id", F.size("r").cast("long").alias("n_records"), F.array_join(digests, ",").alias("digests"))
