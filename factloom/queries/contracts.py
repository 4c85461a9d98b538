"""Input guards, projections, sync jobs, slots and public text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.queries.base import query


@query(
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) > 2000 THEN 'too_long' WHEN turn > 4 THEN 'expired' WHEN turn NOT BETWEEN 0 AND 3 THEN 'bad_limit' ELSE 'ok' END AS status FROM conversations"""
)
def f19_input_guard(t):
    """F-19: the first reason to refuse an input."""
    status = F.when(F.trim("text") == "", "blank").when(F.length("text") > 2000, "too_long").when(F.col("turn") > 4, "expired").when(~F.col("turn").between(0, 3), "bad_limit").otherwise("ok")
    return t("conversations").select("conv_id", "turn", status.alias("status"))


@query("SELECT conv_id, turn, role = 'user' AND length(text) BETWEEN 20 AND 400 AND NOT regexp_matches(text, '[0-9]') AND turn = 0 AS cacheable FROM conversations")
def f20_cacheable(t):
    """F-20: questions whose answers may be cached."""
    ok = (F.col("role") == "user") & F.length("text").between(20, 400) & ~F.col("text").rlike("[0-9]") & (F.col("turn") == 0)
    return t("conversations").select("conv_id", "turn", ok.alias("cacheable"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, json_object('quantity', CAST(l_quantity AS INTEGER), 'flag', l_returnflag) AS public FROM lineitem")
def f21_public_shape(t):
    """F-21: internal fields leave a nested record."""
    record = F.struct(F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("_rank"), F.col("l_suppkey").alias("_source"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", record.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_json(F.col("r").dropFields("_rank", "_source")).alias("public"))


@query("SELECT source, array_to_string(string_split(text, chr(10))[1:4], '|') AS head, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def s09_table_dedup(t):
    """S-09: of tables with one place and the same first four rows the first stays."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 4), "|")
    return t("documents").groupBy("source", head.alias("head")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 30")
def s10_cache_listing(t):
    """S-10: entries of one kind, the newest first."""
    return t("events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id", "ts")


@query("SELECT user_id, string_agg(event_id, '|' ORDER BY event_id) AS ids, json_object('n', count(*), 'most', max(event_id)) AS summary FROM events GROUP BY ALL")
def s18_csv_shape(t):
    """S-13, S-18: lists joined and records as JSON, as a CSV sink takes them."""
    out = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.struct(F.count("*").alias("n"), F.max("event_id").alias("most")).alias("s"))
    return out.select("user_id", F.concat_ws("|", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), F.to_json("s").alias("summary"))


@query(
    """WITH fetched AS (SELECT o_custkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0), stored AS (SELECT o_custkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT DISTINCT o_custkey, o_orderdate, o_orderstatus FROM fetched f WHERE o_orderstatus IN ('O', 'F') AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.o_custkey = f.o_custkey AND s.o_orderdate IS NOT DISTINCT FROM f.o_orderdate AND s.o_orderstatus = f.o_orderstatus)"""
)
def s20_sync(t):
    """S-20: fetched versions that are allowed and not yet stored; null dates are equal to null dates."""
    fetched = t("orders").where("o_custkey % 3 <> 0").where(F.col("o_orderstatus").isin("O", "F")).select("o_custkey", "o_orderdate", "o_orderstatus").distinct()
    stored = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("s")).distinct()
    return fetched.join(stored, (F.col("o_custkey") == F.col("k")) & F.col("o_orderdate").eqNullSafe(F.col("d")) & (F.col("o_orderstatus") == F.col("s")), "left_anti")


@query(
    """WITH q AS (SELECT [x.lower() for x in regexp_extract_all(text, '[A-Za-z]+')] AS k FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, len(list_intersect(list_distinct([x.lower() for x in regexp_extract_all(text, '[A-Za-z]+|[0-9]+')]), k)) AS hits, n_chars FROM documents, q)
SELECT doc_id, hits FROM d WHERE hits > 0 ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 20"""
)
def w13_article_ranking(t):
    """W-13: the most words of a question, then the newest."""
    words = [w.lower() for w in t("benchmark").where("item_id = 0").select(F.array_distinct(X.tokens(F.col("text"))).alias("k")).first()["k"]]
    hits = F.size(F.array_intersect(F.array_distinct(X.tokens(F.col("text"))), F.array(*map(F.lit, words)))).cast("long")
    return t("documents").withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "hits")


@query(
    r"""SELECT doc_id, least(coalesce(nullif(strpos(text, chr(10)), 0), 1000000), coalesce(nullif(strpos(text, '. '), 0), 1000000), length(text) + 1)::BIGINT AS stop, left(text, (least(coalesce(nullif(strpos(text, chr(10)), 0), 1000000), coalesce(nullif(strpos(text, '. '), 0), 1000000), length(text) + 1) - 1)::BIGINT) AS description FROM documents"""
)
def w15_description_bound(t):
    """W-15, W-17: a description ends at the earliest of its stops."""
    at = lambda s: F.coalesce(F.nullif(F.locate(s, F.col("text")), F.lit(0)), F.lit(1_000_000))
    stop = F.least(at("\n"), at(". "), F.length("text") + 1)
    return t("documents").select("doc_id", stop.cast("long").alias("stop"), F.substr(F.col("text"), F.lit(1), stop - 1).alias("description"))


@query(
    """WITH r AS (SELECT l_orderkey AS t, l_linenumber * 100000 + l_partkey AS i, [CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, CAST(l_linenumber AS VARCHAR)] AS c FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, i ORDER BY l_suppkey, l_tax, l_extendedprice) = 1),
 n AS (SELECT *, sum((c[1] <> '')::INT) OVER (PARTITION BY t ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT t, min(i) AS i, coalesce(string_agg(nullif(c[1], ''), ' ' ORDER BY i), '') || '/' || string_agg(c[2], ' ' ORDER BY i) AS cells FROM n GROUP BY t, g"""
)
def w10_wrapped_rows(t):
    """W-10: rows that continue the row before them."""
    from factloom.operators.extraction import merged_rows
    from factloom.operators.selection import first_per

    i = (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("i")
    rows = t("lineitem").select(F.col("l_orderkey").alias("t"), i, F.array(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.col("l_linenumber").cast("string")).alias("c"), "l_suppkey", "l_tax", "l_extendedprice")
    rows = first_per(rows.repartition("t"), ["t", "i"], [F.col("l_suppkey"), F.col("l_tax"), F.col("l_extendedprice")])
    out = merged_rows(rows, "t", "i", "c")
    return out.select("t", "i", F.concat_ws("/", F.coalesce(F.get("c", 0), F.lit("")), F.get("c", 1)).alias("cells"))


@query(
    """SELECT p_name, arg_max(p_type, (length(p_type), -p_partkey)) AS kept, count(*) AS n, string_agg(DISTINCT p_size, ',' ORDER BY p_size) AS evidence FROM part GROUP BY ALL"""
)
def a28_dedup_keep_longest(t):
    """A-28: one row per normalised name: the longest description, all evidence."""
    out = t("part").groupBy("p_name").agg(F.max_by("p_type", F.struct(F.length("p_type"), -F.col("p_partkey"))).alias("kept"), F.count("*").alias("n"), F.array_sort(F.collect_set("p_size")).alias("e"))
    return out.select("p_name", "kept", "n", F.concat_ws(",", F.transform("e", lambda x: x.cast("string"))).alias("evidence"))


@query(
    """SELECT user_id, len(list_filter(list(DISTINCT event_type), lambda x: x IN ('view', 'error'))) AS n_generic, len(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('view', 'error'))) AS n_specific FROM events GROUP BY ALL"""
)
def a35_precision_sets(t):
    """A-35, E-40: generic words apart from those that name something."""
    got = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    generic = F.array(F.lit("view"), F.lit("error"))
    return got.select("user_id", F.size(F.array_intersect("s", generic)).cast("long").alias("n_generic"), F.size(F.array_except("s", generic)).cast("long").alias("n_specific"))


@query(
    """WITH plan AS (SELECT * FROM (VALUES ('click', 'price'), ('click', 'stock'), ('purchase', 'price'), ('purchase', 'invoice')) v(event_type, fact)), have AS (SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'price' WHEN 'signup' THEN 'invoice' END AS fact FROM events WHERE event_type IN ('view', 'signup'))
SELECT e.event_id, p.fact, CASE WHEN h.fact IS NULL THEN 'MISSING' ELSE 'FOUND' END AS status FROM events e JOIN plan p USING (event_type) LEFT JOIN have h ON h.user_id = e.user_id AND h.fact = p.fact"""
)
def r19_fact_plan(t):
    """R-19: the facts that an intent needs, and which are there."""
    plan = F.when(F.col("event_type") == "click", F.array(F.lit("price"), F.lit("stock"))).when(F.col("event_type") == "purchase", F.array(F.lit("price"), F.lit("invoice")))
    need = t("events").select("event_id", "user_id", F.explode(plan).alias("fact"))
    have = t("events").select("user_id", F.when(F.col("event_type") == "view", "price").when(F.col("event_type") == "signup", "invoice").alias("fact")).where("fact IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    return need.join(have, ["user_id", "fact"], "left").select("event_id", "fact", F.when(F.col("hit").isNull(), "MISSING").otherwise("FOUND").alias("status"))


@query(
    r"""WITH l AS (SELECT doc_id, text, [trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''] AS a FROM documents)
SELECT doc_id, len(a) AS n_lines, CASE WHEN len(a) > 1 AND list_sum([length(x) for x in a]) / len(a) < 40 THEN md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) ELSE md5(text) END AS digest FROM l"""
)
def e14_unbroken_text(t):
    """E-14: lines are joined where they are very short on average."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return t("documents").select("doc_id", lines.alias("n_lines"), F.md5(X.unbroken(F.col("text"), 40).cast("binary")).alias("digest"))


@query("SELECT p_partkey, regexp_extract(p_brand, '#(\\d+)$', 1) AS code, lower(regexp_extract(p_brand, '^([A-Za-z]+)', 1)) AS family, CASE WHEN length(p_name) >= 10 THEN p_name ELSE p_brand END AS preferred FROM part")
def e20_class_names(t):
    """E-20, E-21, E-25: code, family and the preferred name of a class."""
    return t("part").select(
        "p_partkey", F.regexp_extract("p_brand", r"#(\d+)$", 1).alias("code"), F.lower(F.regexp_extract("p_brand", "^([A-Za-z]+)", 1)).alias("family"),
        F.when(F.length("p_name") >= 10, F.col("p_name")).otherwise(F.col("p_brand")).alias("preferred"),
    )


RATIOS = "CASE event_id % 3 WHEN 0 THEN '주식 ' || (event_id % 40) || '% ~ ' || (50 + event_id % 40) || '% 투자' WHEN 1 THEN '채권 ' || (event_id % 90) || '% 이상' ELSE '현금 ' || (event_id % 90) || '% 이하' END"


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id % 40 WHEN 1 THEN event_id % 90 END AS DOUBLE) AS low, CAST(CASE event_id % 3 WHEN 0 THEN 50 + event_id % 40 WHEN 2 THEN event_id % 90 END AS DOUBLE) AS high FROM events")
def e28_ratio_mentions(t):
    """E-28: a range first, then one-sided limits."""
    s = F.expr(RATIOS)
    span = r"(\d+(?:\.\d+)?)\s*%?\s*[~∼-]\s*(\d+(?:\.\d+)?)\s*%"
    number = lambda p, g=1: F.regexp_extract(s, p, g).try_cast("double")
    low = F.coalesce(number(span), number(r"(\d+(?:\.\d+)?)\s*%\s*이상"))
    high = F.coalesce(number(span, 2), number(r"(\d+(?:\.\d+)?)\s*%\s*이하"))
    return t("events").select("event_id", low.alias("low"), high.alias("high"))


AMOUNTS = "(2020 + event_id % 7) || '년 총급여 ' || (3000 + event_id % 5000) || '만원, 납입 ' || (event_id % 900) || '만원 ' || CASE event_id % 3 WHEN 0 THEN '세액공제' WHEN 1 THEN 'ISA 이전' ELSE '부족액' END"


@query(
    """SELECT event_id, CAST(2020 + event_id % 7 AS INTEGER) AS policy_year, CASE event_id % 3 WHEN 0 THEN 'tax_credit' WHEN 1 THEN 'isa_transfer' ELSE 'income_gap' END AS kind, CAST((3000 + event_id % 5000) * 10000 AS BIGINT) AS salary, CAST((event_id % 900) * 10000 AS BIGINT) AS contribution FROM events"""
)
def c07_spec_of_a_question(t):
    """C-07, E-32, E-33, E-34: year, kind and the role of each amount by the words before it."""
    s = F.expr(AMOUNTS)
    amount = lambda word: (F.regexp_extract(s, word + r"\s*(\d+)\s*만원", 1).try_cast("long") * 10_000)
    kind = F.when(s.contains("ISA"), "isa_transfer").when(s.contains("세액공제"), "tax_credit").when(s.contains("부족"), "income_gap").otherwise("unknown")
    return t("events").select("event_id", F.regexp_extract(s, r"(20\d{2})\s*년", 1).try_cast("int").alias("policy_year"), kind.alias("kind"), amount("총급여").alias("salary"), amount("납입").alias("contribution"))


STATUTE = "'한도 ' || (900 + event_id % 3) || '만원, 공제율 ' || (12 + event_id % 2) || '퍼센트' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', 총급여 5500만원 이하 15퍼센트' END"


@query(
    """SELECT event_id, event_id % 4 <> 0 AS complete, CASE WHEN event_id % 4 <> 0 THEN CAST((900 + event_id % 3) * 10000 AS BIGINT) END AS credit_limit, CASE WHEN event_id % 4 <> 0 THEN CAST(12 + event_id % 2 AS BIGINT) END AS percent FROM events"""
)
def c09_policy_from_statute(t):
    """C-09: a policy is taken from a statute's text only if every fact is there."""
    s = F.expr(STATUTE)
    limit, rate = F.regexp_extract(s, r"한도\s*(\d+)만원", 1).try_cast("long") * 10_000, F.regexp_extract(s, r"공제율\s*(\d+)퍼센트", 1).try_cast("long")
    salary = F.regexp_extract(s, r"총급여\s*(\d+)만원\s*이하", 1).try_cast("long")
    ok = limit.isNotNull() & rate.isNotNull() & salary.isNotNull()
    return t("events").select("event_id", ok.alias("complete"), F.when(ok, limit).alias("credit_limit"), F.when(ok, rate).alias("percent"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '조세특례법' WHEN 1 THEN '소득세법 시행령' ELSE '소득세법 시행규칙' END AS law, CASE event_id % 3 WHEN 0 THEN '조세특례법' ELSE '소득세법' END AS parent, '제' || (event_id % 99 + 1) || '조' || CASE WHEN event_id % 2 = 0 THEN '의' || (event_id % 5 + 2) ELSE '' END AS article FROM events"""
)
def e51_article_labels(t):
    """E-51: an article's label in one form; a decree's parent law."""
    law = F.when(F.col("event_id") % 3 == 0, "조세특례법").when(F.col("event_id") % 3 == 1, "소득세법 시행령").otherwise("소득세법 시행규칙")
    raw = F.concat(F.lit("제 "), (F.col("event_id") % 99 + 1).cast("string"), F.lit(" 조"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 의 "), (F.col("event_id") % 5 + 2).cast("string"))).otherwise(""))
    return t("events").select("event_id", law.alias("law"), F.regexp_replace(law, r"\s*(시행령|시행규칙)$", "").alias("parent"), F.regexp_replace(raw, r"\s+", "").alias("article"))


@query(
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]{3,60})</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]{3,60})</title>', 1), ''), url) AS name, regexp_extract(html, 'lang="([a-z]{2})"', 1) AS lang, TRY_CAST(regexp_extract(html, '<!-- ad (\d+) -->', 1) AS INTEGER) AS code FROM pages"""
)
def e54_metadata_tiers(t):
    """E-54: a field from the first tier that has it."""
    tier = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    name = F.coalesce(tier("<h1>([^<]{3,60})</h1>"), tier("<title>([^<]{3,60})</title>"), F.col("url"))
    return t("pages").select("page_id", name.alias("name"), F.regexp_extract("html", 'lang="([a-z]{2})"', 1).alias("lang"), F.regexp_extract("html", r"<!-- ad (\d+) -->", 1).try_cast("int").alias("code"))


@query("SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'stock' WHEN 'PROMO' THEN 'bond' END, CASE WHEN p_size > 25 THEN 'mixed' END, CASE WHEN contains(p_name, 'bolt') THEN 'derivative' END, 'other') AS asset_type FROM part")
def e57_asset_type(t):
    """E-57: an alias, then the classification, then the name."""
    by = F.coalesce(F.when(F.col("p_type") == "ECONOMY", "stock").when(F.col("p_type") == "PROMO", "bond"), F.when(F.col("p_size") > 25, "mixed"), F.when(F.contains("p_name", F.lit("bolt")), "derivative"), F.lit("other"))
    return t("part").select("p_partkey", by.alias("asset_type"))


@query(
    r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS i, parts[k] AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) r(k) WHERE trim(parts[k]) <> ''"""
)
def e50_sentences(t):
    """E-50: sentences end at a full stop, a question or exclamation mark that white space follows."""
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return t("documents").select("doc_id", F.posexplode(parts).alias("i", "sentence"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '\?.*$', ''), '^https?://', '') AS shown, contains(url, '?') AS had_query FROM pages"""
)
def e38_public_text(t):
    """E-38: an address without what the public need not see."""
    shown = F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), "^https?://", "")
    return t("pages").select("page_id", shown.alias("shown"), F.contains("url", F.lit("?")).alias("had_query"))


@query("SELECT o_orderkey, list_transform(list_filter(regexp_extract_all(CAST(o_totalprice AS VARCHAR), '\\d+'), lambda x: length(x) > 1), lambda x: CAST(x AS BIGINT))[1] AS first_number FROM orders")
def e42_expected_numbers(t):
    """E-42: the numbers of a text without single digits."""
    found = F.filter(F.regexp_extract_all(F.format_string("%.2f", "o_totalprice"), F.lit(r"(\d+)"), 1), lambda x: F.length(x) > 1)
    return t("orders").select("o_orderkey", F.get(F.transform(found, lambda x: x.cast("long")), 0).alias("first_number"))


@query(
    """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, max(turn) - min(turn) + 1 = count(*) AS gapless, arg_min(role, turn) AS opens FROM conversations GROUP BY ALL"""
)
def d19_conversation_shape(t):
    """D19: turns of a case, without gaps or not, and who opens it."""
    n = F.count("*")
    return t("conversations").groupBy("conv_id").agg(n.alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), (F.max("turn") - F.min("turn") + 1 == n).alias("gapless"), F.min_by("role", "turn").alias("opens"))


@query(
    """SELECT user_id, event_id, version::BIGINT AS version FROM (SELECT user_id, event_id, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS version FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS changed FROM events))"""
)
def d18_source_versions(t):
    """D18, section 2.12: a source's version goes up when its content differs from the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t("events").select("user_id", "event_id", "ts", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int").alias("changed"))
    return rows.select("user_id", "event_id", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), n AS (SELECT conv_id, ws[1] AS word, min(turn) AS a, max(turn) AS b FROM w GROUP BY ALL),
 p AS (SELECT conv_id, turn, i, ws[i] AS word FROM w, unnest(range(2, len(ws) + 1)) r(i)), s AS (SELECT conv_id, turn, min(i) AS stop FROM p JOIN n USING (conv_id, word) WHERE a <> turn OR b <> turn GROUP BY ALL)
SELECT w.conv_id, w.turn, array_to_string(ws[1:coalesce(stop - 1, len(ws))], ' ') AS clipped FROM w LEFT JOIN s USING (conv_id, turn)"""
)
def w17_clipped_at_siblings(t):
    """W-17: a description is clipped where a sibling's name begins.

    Names are reduced to one row for each group and word with their first and last owner, so a word joins at most one row.
    """
    w = t("conversations").select("conv_id", "turn", F.split("text", " ").alias("ws"))
    names = w.groupBy("conv_id", F.get("ws", 0).alias("word")).agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    places = w.select("conv_id", "turn", F.posexplode("ws").alias("i", "word")).where("i > 0")
    stops = places.join(names, ["conv_id", "word"]).where("a <> turn OR b <> turn").groupBy("conv_id", "turn").agg(F.min("i").alias("stop"))
    out = w.join(stops, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.concat_ws(" ", F.slice("ws", F.lit(1), F.coalesce("stop", F.size("ws")))).alias("clipped"))


@query(
    r"""SELECT page_id, contains(regexp_replace(html, '\s+', '', 'g'), '<article>') AND contains(regexp_replace(html, '\s+', '', 'g'), '<h1>') AS has_all, contains(regexp_replace(html, '\s+', '', 'g'), '<aside>') OR contains(regexp_replace(html, '\s+', '', 'g'), '<footer>') AS has_any FROM pages"""
)
def f13_required_values(t):
    """F-13: any or all of the keywords in a text without white space."""
    flat = F.regexp_replace("html", r"\s+", "")
    has = lambda words, f: f(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("flat"), w))
    return t("pages").select("page_id", flat.alias("flat")).select("page_id", has(["<article>", "<h1>"], F.forall).alias("has_all"), has(["<aside>", "<footer>"], F.exists).alias("has_any"))


@query(
    r"""SELECT page_id, printf('p%03d_b%04d', page_id, i) AS block_id, length(blocks[i]) AS n FROM (SELECT page_id, [x for x in regexp_extract_all(html, '<p>([^<]+)</p>', 1) if trim(x) <> ''] AS blocks FROM pages), unnest(range(1, len(blocks) + 1)) r(i)"""
)
def s08_layout_blocks(t):
    """S-07, S-08: a page's blocks in order with their ids; blank ones are dropped."""
    blocks = F.filter(F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), 1), lambda x: F.trim(x) != "")
    rows = t("pages").select("page_id", F.posexplode(blocks).alias("i", "block"))
    return rows.select("page_id", F.format_string("p%03d_b%04d", "page_id", F.col("i") + 1).alias("block_id"), F.length("block").cast("long").alias("n"))
