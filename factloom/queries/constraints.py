"""Validators of nested records and the states of their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import constraints as C
from factloom.queries.base import query


def part_rules() -> list[C.Rule]:
    """The rules that a part with its facts is judged by."""
    return [
        C.Rule("name", "p_name", C.present, C.ERROR),
        C.Rule("size", "p_size", C.within(1, 45)),
        C.Rule("facts", "facts", lambda v: F.size(v) > 0, C.INFO),
        C.Rule("rate", "facts[].rate", C.within(0.0, 0.07), after=("facts",)),
        C.Rule("evidence", "facts[].supplier", C.known(F.col("evidence")), C.ERROR, after=("facts",)),
        C.Rule("lines", "facts", C.distinct(lambda x: F.struct(x["order"], x["line"])), C.ERROR, after=("facts",)),
        C.Rule("price", "p_retailprice", C.within(0, 2000), after=("rate", "evidence")),
        C.Rule("big", "facts[].quantity", C.within(2, 50), when=F.col("p_size") > 25, after=("facts", "size")),
    ]


FACTS = """f AS (SELECT l_partkey AS p_partkey, count(*) AS n, count(*) FILTER (l_tax > 0.07) AS bad_rate, count(*) FILTER (l_discount > 0.09) AS bare, count(DISTINCT (l_orderkey, l_linenumber)) AS lines, count(*) FILTER (l_quantity < 2 OR l_quantity > 50) AS odd FROM lineitem GROUP BY ALL),
v AS (SELECT l_partkey AS p_partkey, count(*) AS unknown FROM lineitem l WHERE l_discount > 0.09 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_partkey = l.l_partkey AND o.l_suppkey = l.l_suppkey AND o.l_discount <= 0.09) GROUP BY ALL),
r AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN trim(p_name) = '' OR p_name IS NULL THEN 1 ELSE 0 END AS name, CASE WHEN p_size BETWEEN 1 AND 45 THEN 0 ELSE 1 END AS size, CASE WHEN n > 0 THEN 0 ELSE 1 END AS facts, bad_rate, coalesce(unknown, 0) AS unknown, n - lines AS repeated, odd FROM part LEFT JOIN f USING (p_partkey) LEFT JOIN v USING (p_partkey))"""


@query(
    f"""WITH {FACTS}, s AS (SELECT p_partkey, name, size, facts, CASE WHEN facts = 0 THEN bad_rate END AS rate, CASE WHEN facts = 0 THEN unknown END AS evidence, CASE WHEN facts = 0 THEN CASE WHEN repeated > 0 THEN 1 ELSE 0 END END AS lines,
 CASE WHEN facts = 0 AND bad_rate = 0 AND unknown = 0 THEN CASE WHEN p_retailprice BETWEEN 0 AND 2000 THEN 0 ELSE 1 END END AS price, CASE WHEN p_size > 25 AND facts = 0 AND size = 0 THEN odd END AS big FROM r),
u AS (SELECT p_partkey, unnest(['name', 'size', 'facts', 'rate', 'evidence', 'lines', 'price', 'big']) AS rule, unnest(['ERROR', 'WARNING', 'INFO', 'WARNING', 'ERROR', 'ERROR', 'WARNING', 'WARNING']) AS severity, unnest([name, size, facts, rate, evidence, lines, price, big]) AS n FROM s)
SELECT p_partkey, rule, CASE WHEN n IS NULL THEN 'NOT_APPLICABLE' WHEN n > 0 THEN 'FAILED' ELSE 'OK' END AS state, coalesce(n, 0) AS n_places, CASE WHEN max(n > 0 AND severity = 'ERROR') OVER w THEN 'failed' WHEN max(n > 0 AND severity = 'WARNING') OVER w THEN 'warning' ELSE 'success' END AS status FROM u WINDOW w AS (PARTITION BY p_partkey)"""
)
def x22_validators(t):
    """X-22: completeness, ranges, references and repeated lines of nested records, judged in one pass over them; rules that depend on others are switched off with them."""
    fact = F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_tax").alias("rate"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"))
    facts = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(fact).alias("facts"), F.collect_set(F.when(F.col("l_discount") <= 0.09, F.col("l_suppkey"))).alias("evidence"))
    records = t("part").join(facts, "p_partkey", "left")
    found = C.judged(records, part_rules()).select("p_partkey", "status", F.inline("checks"))
    return found.select("p_partkey", "rule", "state", F.size("places").cast("long").alias("n_places"), "status")


@query(
    r"""SELECT doc_id, path, state, count(*) OVER (PARTITION BY doc_id) AS n_fields FROM (SELECT doc_id, unnest(['text', 'lang', 'heading', 'table', 'quality']) AS path, unnest([
 CASE WHEN trim(text) <> '' THEN 'FOUND' ELSE 'NOT_FOUND' END, CASE WHEN lang <> '' THEN 'FOUND' ELSE 'NOT_FOUND' END,
 CASE WHEN regexp_matches(text, '^[^\n]{1,40}\n') THEN 'FOUND' WHEN NOT contains(text, chr(10)) THEN 'NOT_APPLICABLE' ELSE 'NOT_FOUND' END,
 CASE WHEN contains(text, ' | ') THEN 'FOUND' WHEN NOT contains(text, '|') THEN 'NOT_APPLICABLE' ELSE 'NOT_FOUND' END,
 CASE WHEN quality = 1 THEN 'FOUND' WHEN toxic = 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END]) AS state FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL) USING (doc_id))"""
)
def x31_field_status(t):
    """X-31: the state of each field of a document: found, its owner's state, or not applicable."""
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    text, owner = F.col("text"), F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 0, "rejected")
    fields = [
        C.Field("text", F.trim(text) != ""), C.Field("lang", F.col("lang") != ""), C.Field("heading", text.rlike(r"^[^\n]{1,40}\n"), not_applicable=~text.contains("\n")),
        C.Field("table", text.contains(" | "), not_applicable=~text.contains("|")), C.Field("quality", F.col("quality") == 1, owner),
    ]
    states = t("documents").join(labels, "doc_id", "left").select("doc_id", C.field_status(fields).alias("m"))
    return states.select("doc_id", F.explode("m").alias("path", "state"), F.size("m").cast("long").alias("n_fields"))
