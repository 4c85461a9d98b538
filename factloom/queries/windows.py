"""Window and streaming-shaped queries: sessions, folds, next rows, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators.temporal import live_entries, sessions
from factloom.queries.base import query


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS seq, source || '_' || lang || '_' || printf('%03d', row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)) AS chunk_id FROM documents")
def w07_sequence_numbers(t):
    """W-07, S-08: ids from a running number in each group."""
    seq = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    rows = t("documents").select("doc_id", "source", "lang", seq.cast("long").alias("seq"))
    return rows.select("doc_id", "source", "seq", F.concat_ws("_", "source", "lang", F.format_string("%03d", "seq")).alias("chunk_id"))


@query(
    """SELECT conv_id, turn, role, lead(role, 1) OVER w AS next_role, CASE WHEN length(text) < 80 THEN text || coalesce(' ' || lead(text, 1) OVER w, '') ELSE text END AS completed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def w11_next_rows(t):
    """W-11: a short text is completed by the row after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    follow = F.coalesce(F.concat(F.lit(" "), F.lead("text").over(w)), F.lit(""))
    return t("conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.when(F.length("text") < 80, F.concat("text", follow)).otherwise(F.col("text")).alias("completed"))


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN split_part(text, ' ', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_topic FROM conversations"""
)
def w16_session_fold(t):
    """W-16, D17: the topic that was last named by the user is carried on."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    topic = F.when(F.col("role") == "user", F.split_part(F.col("text"), F.lit(" "), F.lit(1)))
    return t("conversations").select("conv_id", "turn", F.last(topic, ignorenulls=True).over(w).alias("last_topic"))


@query(
    """WITH m AS (SELECT user_id, ts, coalesce((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) > 1800)::INT, 1) AS n FROM events),
 s AS (SELECT user_id, ts, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM m)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY ALL"""
)
def d17_sessions(t):
    """D17, section 2.12: sessions that end after half an hour of silence."""
    return sessions(t("events"), "user_id", "ts", 1800)


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 40 DAY > TIMESTAMP '2024-02-15' ORDER BY ts DESC, event_id LIMIT 256")
def t07_cache_eviction(t):
    """T-07, D18: unexpired entries, the most recently used 256."""
    e = t("events").withColumn("expires", F.col("ts") + F.expr("INTERVAL 40 DAY"))
    return live_entries(e, "expires", F.lit("2024-02-15").cast("timestamp"), "ts", "event_id", 256).select("event_id", "user_id")


@query(
    """SELECT event_id, source_rank FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END AS source_rank, ts FROM events) ORDER BY ts, source_rank, event_id LIMIT 100"""
)
def t09_method_priority(t):
    """T-09: a sort by position, then by the method's rank."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(9)
    return t("events").withColumn("source_rank", rank).orderBy("ts", "source_rank", "event_id").limit(100).select("event_id", "source_rank")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount <= 0.05 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_tax) = 1")
def t08_best_complete(t):
    """T-08, X-14: the best candidate of those that are complete."""
    own = t("lineitem").where("l_discount <= 0.05")
    order = F.struct("l_quantity", "l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_suppkey"), -F.col("l_tax"))
    best = own.groupBy("l_partkey").agg(F.max_by(F.struct("l_orderkey", "l_linenumber", "l_quantity"), order).alias("x"))
    return best.select("l_partkey", "x.*")


@query(
    """SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n <= 3"""
)
def t06_caps(t):
    """T-06: at most three of a kind in each conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return t("conversations").withColumn("n", n).where("n <= 3").select("conv_id", "turn", "role")
