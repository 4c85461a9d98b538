"""The fold of conversations: question, slots, what is missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.session_fold import session_fold
from factloom.queries.base import query

WINDOW = "(PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CARRIED = lambda value: f"last_value(CASE WHEN role = 'user' THEN {value} END IGNORE NULLS) OVER {WINDOW}"

SQL = rf"""WITH s AS (SELECT conv_id, turn, role, text, coalesce(role = 'user', false) AS said, coalesce(role = 'user' AND contains(text, '?'), false) AS asked, {CARRIED("nullif(split_part(text, ' ', 1), '')")} AS last_topic,
 {CARRIED("nullif(regexp_extract(text, '[0-9]+'), '')")} AS amount, {CARRIED("nullif(regexp_extract(text, '[a-z] ([A-Z][a-z]+)', 1), '')")} AS name, CAST(row_number() OVER {WINDOW.replace(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "")} AS BIGINT) AS n FROM conversations),
m AS (SELECT *, (amount IS NULL)::INT + (name IS NULL)::INT AS lacks, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN name IS NULL THEN 'name' END) AS missing, last_value(CASE WHEN asked THEN n END IGNORE NULLS) OVER {WINDOW} AS question_at FROM s),
b AS (SELECT *, coalesce(lag(lacks) OVER {WINDOW.replace(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "")}, 2) AS before FROM m)
SELECT conv_id, turn, last_topic, question_at, amount, name, missing, CASE WHEN NOT said THEN NULL WHEN (asked OR (question_at IS NOT NULL AND lacks < before)) AND lacks > 0 THEN 'CLARIFY' WHEN NOT asked AND question_at IS NOT NULL AND lacks < before THEN 'RESUME' ELSE 'ANSWER' END AS action FROM b"""


@query(SQL)
def w16_question_and_slots(t):
    """W-16: the pending question, the slots filled so far, those missing and what to do, after each turn."""
    text = F.col("text")
    slots = {"amount": F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit("")), "name": F.nullif(F.regexp_extract(text, "[a-z] ([A-Z][a-z]+)", 1), F.lit(""))}
    topic = F.nullif(F.split_part(text, F.lit(" "), F.lit(1)), F.lit(""))
    rows = session_fold(t("conversations").select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role", "text"], F.col("role") == "user", F.contains(text, F.lit("?")), topic, slots)
    return rows.select("conv_id", "turn", "last_topic", "question_at", "amount", "name", F.concat_ws(",", "missing").alias("missing"), "action")
