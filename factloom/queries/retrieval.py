"""Retrieval queries: benchmark passages ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans import retrieval as R
from factloom.queries.base import query

TOKENS = "[x.lower() for x in regexp_extract_all({}, '[A-Za-z]+|[가-힣]{{2,}}|[0-9]+(?:\\.[0-9]+)?')]"
BM25 = f"""WITH corpus AS (SELECT doc_id, {TOKENS.format('text')} AS k, len(k) AS dl FROM documents), stats AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS mean FROM corpus),
 asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(k) AS term FROM corpus) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 bm25 AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / mean))) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY ALL),
 b AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25 WHERE round(score, 9) > 0 QUALIFY rank <= 80)"""
WORDS = r"regexp_extract_all(lower(text), '[\w\p{L}\p{N}]+')"
TFIDF = rf""",
 grams AS (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
 gtf AS (SELECT doc_id, g, 1 + ln(count(*)) AS tf FROM grams GROUP BY ALL), gdf AS (SELECT g, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM gtf GROUP BY ALL),
 dw AS (SELECT doc_id, g, tf * idf AS w FROM gtf JOIN gdf USING (g)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY ALL),
 qtf AS (SELECT query_id, g, 1 + ln(count(*)) AS tf FROM (SELECT query_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark)) GROUP BY ALL),
 qw AS (SELECT query_id, g, tf * idf AS w FROM qtf JOIN gdf USING (g)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
 dots AS (SELECT query_id, doc_id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (g) GROUP BY ALL),
 cosine AS (SELECT query_id, doc_id, round(dot / dn.n / qn.n, 9) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (query_id)),
 c AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosine WHERE score > 0 QUALIFY rank <= 80)"""


def asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(BM25 + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM b")
def r04_bm25(t):
    """R-04, A-06, A-07, W-01, T-04: BM25 of every passage against all documents, the best 80 of each."""
    out = R.top_n(R.bm25_best(t("documents").select("doc_id", "text"), asked(t), 80), 80)
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(BM25 + TFIDF + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM c")
def r06_word_tfidf(t):
    """R-06, R-07: cosine of word and word-pair tf-idf vectors."""
    out = R.top_n(R.tfidf_best([(R.tfidf_index(t("documents").select("doc_id", "text")), 1.0)], asked(t), 80), 80)
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    BM25 + TFIDF + """, f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS fused, max(CASE WHEN k = 'b' THEN score END) AS most_bm25, max(CASE WHEN k = 'c' THEN score END) AS most_tfidf
  FROM (SELECT 'b' AS k, * FROM b UNION ALL SELECT 'c', * FROM c) GROUP BY ALL)
SELECT query_id, doc_id, round(fused, 6) AS fused, round(most_bm25, 6) AS most_bm25, round(most_tfidf, 6) AS most_tfidf, source FROM f JOIN documents USING (doc_id) WHERE source IN ('src0', 'src1', 'src2')"""
)
def a08_rank_fusion(t):
    """A-08, A-09, F-11, R-08: reciprocal rank fusion; the source filter stands after it, as ranks are over all sources."""
    docs = t("documents").select("doc_id", "text")
    b, c = R.top_n(R.bm25_best(docs, asked(t), 80), 80), R.top_n(R.tfidf_best([(R.tfidf_index(docs), 1.0)], asked(t), 80), 80)
    both = b.withColumn("k", F.lit("b")).unionByName(c.withColumn("k", F.lit("c")))
    most = lambda k: F.round(F.max(F.when(F.col("k") == k, F.col("score"))), 6)
    f = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 6).alias("fused"), most("b").alias("most_bm25"), most("c").alias("most_tfidf"))
    return f.join(t("documents").select("doc_id", "source"), "doc_id").where(F.col("source").isin("src0", "src1", "src2"))


GRAMS = "[' ' || x || ' ' for x in string_split_regex(lower(text), '\\s+') if x <> '']"
CHARS = f"flatten([flatten([[substr(w, i, n) for i in range(1, greatest(length(w) - n + 1, 1) + 1)] for n in range(2, 6) if length(w) >= n OR n = 2]) for w in {GRAMS}])"


@query(
    f"""WITH grams AS (SELECT doc_id, unnest({CHARS}) AS g FROM documents), gtf AS (SELECT doc_id, g, 1 + ln(count(*)) AS tf FROM grams GROUP BY ALL),
 gdf AS (SELECT g, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM gtf GROUP BY ALL), dw AS (SELECT doc_id, g, tf * idf AS w, idf FROM gtf JOIN gdf USING (g)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY ALL),
 qg AS (SELECT query_id, g, 1 + ln(count(*)) AS tf FROM (SELECT item_id AS query_id, unnest({CHARS}) AS g FROM benchmark) GROUP BY ALL), qw AS (SELECT query_id, g, tf * idf AS w FROM qg JOIN gdf USING (g)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
 dots AS (SELECT query_id, doc_id, sum(a.w * b.w) AS dot FROM qw a JOIN dw b USING (g) GROUP BY ALL),
 c AS (SELECT query_id, doc_id, round(dot / dn.n / qn.n, 9) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (query_id))
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score FROM c WHERE score > 0 QUALIFY rank <= 10"""
)
def r05_char_tfidf(t):
    """R-05, R-07: cosine of character n-grams inside words of whole texts; every passage asks."""
    out = R.top_n(R.tfidf_best([(R.tfidf_index(t("documents").select("doc_id", "text"), R.char_grams), 1.0)], asked(t), 10), 10)
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query()
def r11_retrieve(t):
    """R-02, R-03, R-09, R-10, R-11, W-06, T-05: the whole retrieval for every passage."""
    chunks = t("documents").select("doc_id", "text", F.when(F.col("lang") == "en", "docs").otherwise("investment").alias("source_group"), F.col("source").alias("filename"), F.col("doc_id").cast("string").alias("location"))
    return R.retrieve(chunks, asked(t))


QUESTIONS = "CASE event_id % 5 WHEN 0 THEN 'DB와 DC 차이 비교' WHEN 1 THEN 'IRP 세액공제 한도' WHEN 2 THEN '펀드 수수료가 낮은 상품' WHEN 3 THEN '중도인출 요건은?' ELSE 'plain words' END"
TEXTS = "CASE event_id % 3 WHEN 0 THEN 'DB 확정급여형과 DC 확정기여형의 운용' WHEN 1 THEN '질문 리스트: 무엇? 왜? 어떻게?' ELSE 'plain words? of? no? note' END"


@query(
    """WITH m AS (SELECT event_id, event_id % 5 AS q, event_id % 3 AS x FROM events)
SELECT event_id, CASE WHEN q IN (0, 1, 3) THEN CASE event_id % 2 WHEN 0 THEN 1.18 ELSE 0.88 END WHEN q = 2 THEN CASE event_id % 2 WHEN 0 THEN 1.0 ELSE 1.1 END ELSE 1.0 END::DOUBLE AS by_source,
 round((CASE x WHEN 0 THEN 1.0 WHEN 1 THEN 0.45 ELSE 0.62 END
 * CASE q WHEN 0 THEN 1 + 0.35 * CASE x WHEN 0 THEN 2 ELSE 0 END / 4.0 WHEN 4 THEN 1 + 0.35 * CASE x WHEN 2 THEN 2 ELSE 0 END / 2.0 ELSE 1.0 END
 * CASE q WHEN 0 THEN CASE x WHEN 0 THEN 1.12 * 1.12 * 1.25 * 1.2 ELSE 0.72 * 0.72 END WHEN 1 THEN 0.72 * 0.72 WHEN 3 THEN 0.72 ELSE 1.0 END * CASE x WHEN 0 THEN 1.05 ELSE 1.0 END)::DOUBLE, 6) AS by_content FROM m"""
)
def r10_multipliers(t):
    """R-09, R-10: the multipliers of source and content."""
    q, x, group = F.expr(QUESTIONS), F.expr(TEXTS), F.when(F.col("event_id") % 2 == 0, "docs").otherwise("investment")
    return t("events").select("event_id", R.source_multiplier(q, group).alias("by_source"), F.round(R.content_multiplier(q, x), 6).alias("by_content"))


#: Questions of every kind with the intent, the sources and the legal topic that the rules give them.
ASKED = [
    ("지금 즉시 매수 주문을 넣어줘", "action_request", "document", None), ("보유한 상품보다 수익률 높은 순으로 추천", "compound_holding", "document", None),
    ("IRP는 무조건 중도인출이 안 되는 것이 맞나요", "correction", "document+law", "IRP_WITHDRAWAL"), ("이 펀드의 위험평가액은", "product_attribute", "product", None),
    ("실물이전 불가사유 코드를 알려줘", "procedure", "document", None), ("총보수가 가장 낮은 펀드 추천", "product_search", "product", None), ("클래스별 수수료", "product_attribute", "product", None),
    ("연금소득은 어떻게", "tax_calculation", "calculation", None), ("DB형과 DC형의 차이", "institution", "document", "DB"), ("안녕하세요", "general", "document", None),
    ("세액공제 한도는 얼마까지", "tax_calculation", "document+calculation", "TAX_CREDIT"), ("ISA 만기 납입 환급 계산", "tax_calculation", "calculation", None), ("퇴직금 과세이연과 분리과세 선택지", "tax_calculation", "document+law", None),
    ("장외파생 한도는 몇 퍼센트", "general", "document+product", None), ("편입 당시 등급이 바뀌면", "product_attribute", "document", None), ("확정기여형 관련 법령 조문", "general", "law", "DC"),
    ("미래에셋배당커버드콜펀드 클래스 비교해줘", "product_search", "product", None), ("개인형퇴직연금 제도 설명", "institution", "document", "IRP"),
]


@query(
    "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {repr(c) if c else 'NULL'})" for i, (_, a, b, c) in enumerate(ASKED)) + f") v(i, intent, route, topic)) SELECT event_id, intent, route, topic FROM events JOIN k ON event_id % {len(ASKED)} = i"
)
def r16_router(t):
    """R-14, R-16, R-18: intent, sources and legal topic of a question."""
    from factloom.functions import routing as Q

    q = F.element_at(F.array(*(F.lit(x[0]) for x in ASKED)), (F.col("event_id") % len(ASKED) + 1).cast("int"))
    rows = t("events").select("event_id", q.alias("q"))
    return rows.select("event_id", Q.task_intent(F.col("q")).alias("intent"), Q.route(F.col("q")).alias("route"), Q.law_topic(F.col("q"))["topic"].alias("topic"))


@query(
    """SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z]+')) AS word FROM part) WHERE length(word) >= 3 AND word NOT IN ('brand', 'small', 'large')"""
)
def r17_hint_harvest(t):
    """R-17: the catalog's words without generic ones."""
    words = t("part").select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("([a-z]+)"), 1)).alias("word"))
    return words.where((F.length("word") >= 3) & ~F.col("word").isin("brand", "small", "large")).distinct()


LIMIT_TERMS, LIMIT_VALUE = ["비율", "비중", "한도", "담보", "이내", "초과", "100분"], r"\d+(?:\.\d+)?\s*%|\d+\s*분의\s*\d+|\d[\d,]*\s*만\s*원"
STATED = "coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(10) || '담보 한도는 ' || (doc_id % 90) || '% 이내입니다. 다만 예외가 있습니다.' WHEN 1 THEN chr(10) || '한도는 없습니다.' ELSE '' END"


@query(
    rf"""WITH d AS (SELECT doc_id, {STATED} AS x FROM documents), p AS (SELECT doc_id, x, unnest(regexp_extract_all(x, '[^\n.!?]+[.!?]?|[\n.!?]')) AS p, generate_subscripts(regexp_extract_all(x, '[^\n.!?]+[.!?]?|[\n.!?]'), 1) AS i FROM d),
 s AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
 w AS (SELECT doc_id, i, regexp_replace(substr(x, CAST(greatest(pos - 80, 0) + 1 AS BIGINT), CAST(pos + length(p) + 140 - greatest(pos - 80, 0) AS BIGINT)), '^\s+|\s+$', '', 'g') AS w FROM s WHERE p NOT IN (chr(10), '.', '!', '?')),
 f AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w WHERE regexp_matches(w, '비율|비중|한도|담보|이내|초과|100분') AND regexp_matches(w, '[0-9]+(?:\.[0-9]+)?\s*%|[0-9]+\s*분의\s*[0-9]+|[0-9][0-9,]*\s*만\s*원')),
 g AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS n_chars FROM f WHERE k <= 3 GROUP BY ALL)
SELECT doc_id, CASE WHEN n > 0 THEN 'FOUND' ELSE 'MISSING' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_kept, CAST(coalesce(g.n_chars, 0) AS BIGINT) AS n_chars FROM documents LEFT JOIN g USING (doc_id)"""
)
def r20_slots(t):
    """R-20: the sentences, with what stands around them, that fill the slot of a limit; at most three."""
    from factloom.functions import routing as Q

    rows = t("documents").select("doc_id", F.expr(STATED.replace("chr(10)", "'\\n'")).alias("x"))
    found = rows.select("doc_id", Q.slot(F.col("x"), LIMIT_TERMS, LIMIT_VALUE).alias("w"))
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    return found.select("doc_id", F.when(F.size("w") > 0, "FOUND").otherwise("MISSING").alias("status"), F.size("w").cast("long").alias("n_kept"), chars.alias("n_chars"))


CODED = "'머리' || chr(10) || '0' || (1 + event_id % 5) || '. 소규모 펀드 | 잔고 ' || event_id || '억 미만' || chr(10) || '12. 디폴트옵션 전용 | 이전할 수 없음' || chr(10) || '99. 기타 | 그 밖의 소규모 사유' || chr(10) || '12. 디폴트옵션 전용 | 다시'"
ASKS = "CASE event_id % 3 WHEN 0 THEN '소규모 펀드 실물이전 불가사유 코드' WHEN 1 THEN '실물이전 불가사유 코드' ELSE '수익률은?' END"


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE '0' || (1 + event_id % 5) || ':소규모 펀드:잔고 ' || event_id || '억 미만' || CASE event_id % 3 WHEN 1 THEN ';12:디폴트옵션 전용:이전할 수 없음' ELSE '' END END AS rows FROM events"""
)
def r21_code_rows(t):
    """R-21: coded rows that a question's conditions meet, without the catch-all, each code and reason once, the first five by code."""
    from factloom.functions import routing as Q

    rows = t("events").select("event_id", F.expr(CODED.replace("chr(10)", "'\\n'")).alias("text"), F.expr(ASKS).alias("q"))
    found = Q.reject_rows(F.col("q"), F.col("text"))
    return rows.select("event_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["code"], x["reason"], x["detail"])), ";").alias("rows"))
