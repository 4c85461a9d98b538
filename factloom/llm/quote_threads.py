"""Chat formatting by quotation linking, in DataFrame functions alone.

A message's lines carry nested quote levels (``>``, ``> >`` ...). A passage is a quoted line, a paragraph or a run of lines at one
level, or all that a message quotes at its first level, in lower case and with single spaces, so that a rewrapped quotation is still the same
passage. Its hash is joined to the hashes of the lines, paragraphs and whole texts that messages of the same conversation say
themselves; the original is the first of them. The message whose words are quoted most, at the outermost
level that has any match, is the parent; a message without a match follows the turn before it. The quotes leave the text.

Threads are ordered depth-first without ever holding one in a task: a message's first reply continues its branch, other replies open
branches. Pointer jumping along the branches and then over them gives root, depth and a key that sorts a thread in reply order. The key
grows with the number of branches on the way, not with the depth.

Every passage finds one original at most, as originals are first reduced to one row for each conversation and hash; so a line that
everyone repeats costs no more than its occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

PREFIX = r"^ {0,3}>[> \t]*"
#: Lines that introduce a quotation; they leave with it (fixed values).
INTRODUCES = r"(?i)^.*(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"


def _normal(c: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")))


def _level(line: F.Column) -> F.Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def _bare(line: F.Column) -> F.Column:
    return F.regexp_replace(line, PREFIX, "")


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``lines`` (level, words), ``flat`` (the same with normal words), ``own`` lines and ``clean``: the text without quotes and the lines that introduce them."""
    raw = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    lines = F.transform(raw, lambda x: F.struct(_level(x).alias("level"), _bare(x).alias("words")))
    flat = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), F.translate(_normal(x["words"]), "\x01\x02", "").alias("words")))
    out = messages.withColumn("lines", lines).withColumn("flat", flat)
    says = lambda x, i: (x["level"] == 0) & ~(x["words"].rlike(INTRODUCES) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0))
    kept = F.transform(F.filter("lines", says), lambda x: x["words"])
    return out.withColumn("own", kept).withColumn("clean", F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", ""))


def _runs(flat: F.Column, blank_ends: bool) -> F.Column:
    """(level, words) of each run of neighbouring lines of one level; ``blank_ends``: an empty line ends a run as well. ``flat``: a plain column, as each line looks at the one before."""

    def part(x, i):
        before = F.get(flat, i - 1)
        same = (i > 0) & (before["level"] == x["level"])
        if blank_ends:
            same &= (x["words"] != "") & (before["words"] != "")
        return F.concat(F.when(same, " ").otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))), x["words"])

    runs = F.split(F.array_join(F.transform(flat, part), ""), "\x01")
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, "\x02", 1).try_cast("int").alias("level"), _normal(F.substring_index(r, "\x02", -1)).alias("words")))


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, origin``: the message that each quoting message answers. ``messages``: as from :func:`parsed`."""
    own = F.transform("own", _normal)
    paragraphs = F.transform(F.split(F.array_join(own, "\n"), "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " ")))
    whole = F.array(F.array_join(F.filter(own, lambda x: x != ""), " "))
    said = F.filter(F.array_distinct(F.concat(own, paragraphs, whole)), lambda x: x != "")
    originals = messages.select("conv_id", "turn", F.explode(F.transform(said, lambda x: F.sha2(x, 256))).alias("hash"))
    originals = originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoting = messages.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", "flat")
    each = F.col("flat")
    first = F.filter(each, lambda x: (x["level"] == 1) & (x["words"] != ""))
    every = F.array(F.struct(F.lit(1).alias("level"), F.array_join(F.transform(first, lambda x: x["words"]), " ").alias("words")))
    units = F.array_distinct(F.concat(each, _runs(each, True), _runs(each, False), every))
    units = F.filter(units, lambda x: (x["level"] > 0) & (x["words"] != ""))
    units = F.transform(units, lambda x: F.struct(F.sha2(x["words"], 256).alias("hash"), F.length(x["words"]).alias("chars"), x["level"].alias("level")))
    passages = quoting.select("conv_id", "turn", F.explode(units).alias("u")).select("conv_id", "turn", "u.*")
    found = passages.join(originals, ["conv_id", "hash"]).where("origin < turn")
    per = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"))
    return per.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("chars"), F.col("origin"))).alias("origin"))


def chased(links: DataFrame) -> DataFrame:
    """``conv_id, turn, root, depth, path``: the end of each message's chain of ``up`` links, with depths added and paths joined from the root on."""
    moving = stored(links.select("conv_id", "turn", F.col("up").alias("root"), F.col("depth").cast("long").alias("depth"), "path", F.lit(False).alias("done")), "jump")
    ended = moving.where("done")
    while not moving.isEmpty():  # a message leaves the rounds when its chain has ended, so only long chains take many
        known = moving.unionByName(ended)
        above = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("path").alias("before"), F.col("done").alias("over"))
        again = stored(
            moving.join(above, ["conv_id", "root"], "left").select(
                "conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.concat(F.coalesce("before", F.lit("")), "path").alias("path"), F.coalesce("over", F.lit(True)).alias("done"),
            ),
            "jump",
        )
        ended, moving = ended.unionByName(again.where("done")), again.where("not done")
    return ended.drop("done")


def threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, thread_turn, depth, path, steps`` of each message with a parent. ``parents``: ``conv_id, turn, parent``, one row for each message.

    ``path`` names the branches from the root to the message's own, ``steps`` its place there. Parents come before their replies, so there is no circle.
    """
    firsts = parents.groupBy("conv_id", "parent").agg(F.min("turn").alias("first"))
    sided = stored(parents.join(firsts, ["conv_id", "parent"]), "replies")
    main = sided.where("turn = first").select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth"), F.lit("").alias("path"))
    along = stored(chased(main).select("conv_id", "turn", F.col("root").alias("head"), F.col("depth").alias("steps")), "branches")
    off = sided.where("turn <> first").join(along.withColumnRenamed("turn", "parent"), ["conv_id", "parent"], "left")
    off = off.withColumn("steps", F.coalesce("steps", F.lit(0)))
    opened = F.concat(F.lit("/"), F.lpad((F.lit(9999999999) - F.col("steps")).cast("string"), 10, "0"), F.lit(":"), _sortable(F.col("turn")))
    over = chased(off.select("conv_id", "turn", F.coalesce("head", "parent").alias("up"), (F.col("steps") + 1).alias("depth"), opened.alias("path")))
    over = stored(over.select("conv_id", F.col("turn").alias("head"), F.col("root"), F.col("depth").alias("above"), "path"), "opened")
    every = along.unionByName(off.select("conv_id", "turn", F.col("turn").alias("head"), F.lit(0).cast("long").alias("steps")))
    return every.join(over, ["conv_id", "head"], "left").select(
        "conv_id", "turn", F.coalesce("root", "head").alias("thread_turn"), (F.col("steps") + F.coalesce("above", F.lit(0))).alias("depth"), F.coalesce("path", F.lit("")).alias("path"), "steps"
    )


def _sortable(c: F.Column) -> F.Column:
    """A long as a string that sorts as the number does."""
    return F.lpad((c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (without quotes), ``formatted, parent_turn, linked_by, thread_turn, depth, reply_key, n_quoted``, a row for each message.

    Ordered by (conv_id, thread_turn, reply_key), a conversation reads in reply order, depth-first: a message, then its first reply and all that follows from it, then the next reply. A
    message without a matched quote follows the turn before it (``linked_by`` = 'order'), or nothing if that turn does not exist; then it is the root of a thread. Null
    texts are empty, null roles 'user'; messages without conversation or turn keep their place and link to nothing. If rows repeat a
    conversation and turn, each comes back; they quote and are quoted as one. An empty table gives an empty result. Columns other than the four are not read.
    """
    rows = parsed(messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "text"))
    turns = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    quoted = stored(reply_links(rows), "links")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("by_order"))
    known = turns.join(quoted, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    known = known.select("conv_id", "turn", F.coalesce("origin", "by_order").alias("parent"), F.when(F.col("origin").isNotNull(), "quote").otherwise("order").alias("linked_by"))
    known = stored(known.where("parent is not null"), "parents")
    placed = known.join(threads(known.select("conv_id", "turn", "parent")), ["conv_id", "turn"])
    out = rows.join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("clean").alias("text"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "clean", F.lit("\n")).alias("formatted"),
        F.col("parent").alias("parent_turn"), "linked_by", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.coalesce("path", F.lit("")), F.lit("."), F.lpad(F.coalesce("steps", F.lit(0)).cast("string"), 10, "0")).alias("reply_key"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )


def op2_chat(spark, sf_dir):
    return linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, string_split_regex(coalesce(text, ''), '\r?\n') AS raw FROM conversations
), lines AS (
  SELECT conv_id, turn, i, raw[i] AS line FROM cut, unnest(range(1, len(raw) + 1)) AS r(i)
), leveled AS (
  SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^ {0,3}>[> \t]*'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^ {0,3}>[> \t]*', '') AS words FROM lines
), marked AS (
  SELECT *, level = 0 AND NOT (regexp_matches(words, '(?i)^.*(wrote|schrieb|a écrit|escribió) ?:[ \t]*$')
         AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > 0) AS says,
         lower(trim(regexp_replace(words, '[ \t\r\f\x0B]+', ' ', 'g'))) AS normal FROM leveled
), clean AS (
  SELECT conv_id, turn, coalesce(regexp_replace(string_agg(words, chr(10) ORDER BY i) FILTER (says), '^\s+|\s+$', '', 'g'), '') AS text,
         CAST(count(*) FILTER (level > 0) AS BIGINT) AS n_quoted FROM marked GROUP BY ALL
), blanks AS (
  SELECT *, sum(CASE WHEN normal = '' THEN 1 ELSE 0 END) OVER w AS own_run, sum(CASE WHEN level <> before OR before IS NULL THEN 1 ELSE 0 END) OVER w AS run,
         sum(CASE WHEN level <> before OR before IS NULL OR normal = '' THEN 1 ELSE 0 END) OVER w AS paragraph
  FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM marked) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), owned AS (
  SELECT conv_id, turn, i, normal, sum(CASE WHEN normal = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS paragraph FROM marked WHERE says
), said AS (
  SELECT conv_id, turn, normal FROM owned WHERE normal <> ''
  UNION SELECT conv_id, turn, string_agg(normal, ' ' ORDER BY i) FROM owned WHERE normal <> '' GROUP BY conv_id, turn, paragraph
  UNION SELECT conv_id, turn, string_agg(normal, ' ' ORDER BY i) FROM owned WHERE normal <> '' GROUP BY conv_id, turn
), originals AS (
  SELECT conv_id, normal, min(turn) AS origin FROM said GROUP BY ALL
), units AS (
  SELECT conv_id, turn, level, normal FROM blanks WHERE level > 0 AND normal <> ''
  UNION SELECT conv_id, turn, level, string_agg(normal, ' ' ORDER BY i) FROM blanks WHERE level > 0 AND normal <> '' GROUP BY conv_id, turn, level, run
  UNION SELECT conv_id, turn, level, string_agg(normal, ' ' ORDER BY i) FROM blanks WHERE level > 0 AND normal <> '' GROUP BY conv_id, turn, level, paragraph
  UNION SELECT conv_id, turn, 1, string_agg(normal, ' ' ORDER BY i) FROM blanks WHERE level = 1 AND normal <> '' GROUP BY conv_id, turn
), matched AS (
  SELECT conv_id, turn, level, origin, sum(length(normal)) AS chars FROM units JOIN originals USING (conv_id, normal) WHERE origin < turn GROUP BY ALL
), links AS (
  SELECT conv_id, turn, origin FROM matched QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, origin DESC) = 1
), parents AS (
  SELECT m.conv_id, m.turn, coalesce(l.origin, p.turn) AS parent, CASE WHEN l.origin IS NOT NULL THEN 'quote' WHEN p.turn IS NOT NULL THEN 'order' END AS linked_by
  FROM (SELECT DISTINCT conv_id, turn FROM conversations) m LEFT JOIN links l USING (conv_id, turn)
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1
), sided AS (
  SELECT *, turn = min(turn) OVER (PARTITION BY conv_id, parent) AS continues FROM parents WHERE parent IS NOT NULL
), walk AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS depth, '' AS path, 0 AS steps FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT w.conv_id, s.turn, w.thread_turn, depth + 1,
         CASE WHEN s.continues THEN path ELSE path || '/' || lpad(CAST(9999999999 - steps AS VARCHAR), 10, '0') || ':' || lpad(CAST(s.turn::HUGEINT + 9223372036854775808 AS VARCHAR), 20, '0') END,
         CASE WHEN s.continues THEN steps + 1 ELSE 0 END
  FROM walk w JOIN sided s ON s.conv_id = w.conv_id AND s.parent = w.turn
)
SELECT m.conv_id, m.turn, m.role, c.text, '<|' || m.role || '|>' || chr(10) || c.text || chr(10) AS formatted,
       p.parent AS parent_turn, p.linked_by, w.thread_turn, CAST(w.depth AS BIGINT) AS depth, w.path || '.' || lpad(CAST(w.steps AS VARCHAR), 10, '0') AS reply_key, c.n_quoted
FROM cut m JOIN clean c USING (conv_id, turn) JOIN parents p USING (conv_id, turn) JOIN walk w USING (conv_id, turn)
"""
