"""What a question asks for: its intent, the sources that can answer it, its legal topic, coded rows and sentences that fill a slot.

All functions are column in, column out. Each decision is one chain of conditions, the first that holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark what a question is about.
ORDERS = [
    "매수 주문 처리", "지금 즉시 매수", "즉시 매수 주문", "매수해 주세요", "매수해주세요", "매수 주문해", "주문해 주세요", "주문해주세요", "체결해 주세요", "체결해주세요", "매도 주문해", "매도해 주세요"
]
PROCEDURES = [
    "실물이전", "실물 이전", "디폴트옵션", "사전지정", "적용 통지", "옵트인", "자동 매수", "자동매수", "자동 재예치", "불가사유", "가입자 교육", "가입자교육", "과태료", "퇴직연금규약", "규약", "재정검증",
    "최소적립", "평균임금", "중도인출", "담보제공", "지연이자", "통지",
]
INSTITUTIONS = ["제도", "절차", "요건", "자격", "가능한가", "가능한가요", "안 되나", "안되나요", "왜 안", "어떻게 다르", "차이"]
ATTRIBUTES = [
    "벤치마크", "benchmark", "비교지수", "총보수", "보수율", "수수료", "수익률", "위험등급", "위험 등급", "클래스", "투자전략", "모펀드", "편입", "순자산", "위험평가액", "투자 의무", "의무 비율", "운용 한도",
    "투자한도", "편입비율",
]
SEARCHES = ["추천", "보여줘", "찾아줘", "비교해", "낮은 순", "높은 순", "가장 낮", "가장 높", "상위", "저렴"]
CORRECTIONS = ["맞나요", "맞는가요", "맞습니까", "틀린가", "아닌가요", "아닌가", "무조건"]
HOLDINGS = ["보유한", "보유 중", "운용 중", "운용중인", "제 계좌", "내 계좌"]
FUND_STEMS = ["증권자투자신탁", "증권투자신탁", "자투자신탁"]
LIMITS = ["위험평가액", "투자 의무", "의무 비율", "운용 한도", "투자한도", "편입비율"]
PROSPECTUS = ["투자설명서", "약관"]
TAXES = ["세액공제", "납입한도", "납입 한도", "환급", "과세이연", "분리과세", "초과납입", "종합과세", "ISA", "만기 ISA", "사적연금", "연금소득"]
EDUCATION = ["교육", "과태료", "최소적립", "규약"]
TAX_WORDS = ["세금", "과세", "세액공제", "퇴직금", "사적연금", "연금소득"]
TAX_CHOICES = ["이월", "무효", "전환 신청", "선택지", "과세이연", "과세 이연", "종합과세", "분리과세", "영원히", "미뤄", "미루", "이연"]
HELD_RULES = ["기매입", "편입 당시", "사업재편", "정의에서", "규정을 위반", "위험자산 한도", "소비자관련주"]
LIMIT_WORDS = ["한도", "%", "몇 퍼", "몇%", "대조", "비율"]
LIMIT_TOPICS = ["장외파생", "장내", "사모집합", "사모펀드", "운용제한", "운용 제한", "위험평가액", "파생상품"]
CALCULATED = ["세액공제", "납입한도", "납입 한도", "소득공백", "소득 공백", "노후소득", "부족액", "ISA", "만기 ISA"]
CALCULATION_POLICY = ["이월", "신청 절차", "전환 신청"]
CALCULATION_AMOUNT = ["얼마", "환급", "계산", "최대 한도", "총 한도", "맞나요", "얼마까지", "합쳐서"]
HOW_MUCH, PAID = ["한도", "얼마까지", "각각 얼마", "합쳐서", "다 합쳐"], ["납입했", "넣었", "환급받을", "맞나요", "ISA"]
DEFERRED = ["과세이연", "분리과세", "초과납입", "이월", "종합과세"]
COMPARED = ["총보수", "수익률", "비교해", "추천"]
PRODUCT_PREMISE = ["벤치마크", "benchmark", "비교지수", "보수", "수익률", "클래스", "편입비율", "MSCI"]
CREDIT = ["세액공제", "공제율", "환급"]
ROUTE_SEARCH = ["추천", "비교", "가장 낮", "가장 높", "상위", "저렴", "대조", "낮은 순", "높은 순", "오름차순", "내림차순", "보여줘", "찾아줘"]
ROUTE_CONCEPT = ["투자설명서", "총보수", "합성", "모자형", "자펀드", "모투자신탁", "자신탁", "피투자"]
ROUTE_OPERATIONS = [
    "디폴트옵션", "실물이전", "실물 이전", "감독규정", "적용 통지", "불가사유", "불가 사유", "불가사유코드", "자동 매수", "사전지정", "가입자 교육", "가입자교육", "재정검증", "최소적립", "퇴직연금규약"
]
ROUTE_DOCUMENT = ["DB", "DC", "IRP", "퇴직연금", "연금저축", "세액공제", "중도인출", "연금수령", "퇴직급여", "가입", "이전", "제도", "조건", "법정", "가능", "불가", "차이", "무엇", "어떻게", "교육", "과태료"]
ROUTE_STATED_LAW = ["법률", "법령", "시행령", "시행규칙", "조문", "법적", "법적 근거", "근거 규정", "법에서", "법상"]
ROUTE_LAW = [*ROUTE_STATED_LAW, "중도인출", "중도 인출", "감독규정", "규정상", "규정 요건", "한도 제한"]
ROUTE_EXPLAIN = ["설명", "의미", "제도", "쉽게", "알려줘", "알려 주세요"]
FUND_MARKS = ["증권자투자신탁", "증권 투자신탁", "증권투자신탁", "자투자신탁"]
BRANDED_FUND = r"(?:미래에셋|흥국|삼성|한국투자)[가-힣A-Za-z0-9]{2,}(?:투자신탁|펀드|셀렉트[\w가-힣]*|TDF|인덱스)"
REJECT_ROW = r"(\d{2})\.\s*([^|\n]{2,40}?)\s*\|\s*([^\n]{4,220})"
REJECT_REST, REJECT_FOCUS, REJECT_ANY = r"99\.\s*기타", ["소규모", "임의해지", "디폴트옵션", "언번들", "사모펀드", "mmf", "환매수수료", "압류", "질권"], ["소규모", "디폴트", "불가"]
ASKS_CODE, ASKS_TRANSFER = ["불가사유", "불가 사유", "사유 코드", "사유코드", "코드"], ["실물이전", "실물 이전", "이전"]


def says(text: Column, words: list[str], any_case: bool = False) -> Column:
    """Whether a text holds one of the words; never null."""
    either = "|".join(re.escape(w) for w in words)
    return F.coalesce(text.rlike(f"(?iu){either}" if any_case else either), F.lit(False))


def named_fund(question: Column) -> Column:
    return says(question, FUND_MARKS) | F.coalesce(question.rlike(BRANDED_FUND), F.lit(False))


def tax_rule(question: Column) -> Column:
    return says(question, TAX_WORDS) & says(question, TAX_CHOICES)


def limit_rule(question: Column) -> Column:
    return says(question, LIMIT_WORDS) & says(question, LIMIT_TOPICS)


def product_rule(question: Column) -> Column:
    return says(question, HELD_RULES) | limit_rule(question)


def calculable(question: Column) -> Column:
    """A question of amounts; one of policy alone is none."""
    return says(question, CALCULATED) & (~says(question, CALCULATION_POLICY) | says(question, CALCULATION_AMOUNT))


def task_intent(question: Column) -> Column:
    """What kind of work a question asks for; ``general`` for null and empty ones."""
    attribute, search, institution, holding = (says(question, w) for w in (ATTRIBUTES, SEARCHES, INSTITUTIONS, HOLDINGS))
    return (
        F.when(says(question, ORDERS), "action_request")
        .when(holding & (search | attribute) & ~says(question, FUND_STEMS), "compound_holding")
        .when(says(question, CORRECTIONS), "correction")
        .when(says(question, LIMITS) | (attribute & says(question, FUND_STEMS + PROSPECTUS)), "product_attribute")
        .when(says(question, PROCEDURES), "procedure")
        .when(search & ~institution, "product_search")
        .when(attribute & ~institution, "product_attribute")
        .when(holding & search, "compound_holding")
        .when(says(question, TAXES), "tax_calculation")
        .when(institution | says(question, EDUCATION), "institution")
        .otherwise("general")
    )


def route(question: Column, named: Column | None = None) -> Column:
    """The sources that answer a question, joined by ``+`` in the order document, product, law, calculation.

    ``named``: whether the question names a product of the catalog, beside what :func:`named_fund` sees. The four rules of tax, product, limits and amounts
    come first. Orders, taxes and premises then have fixed sources. For all others the intent and the words choose document or product, and words of law add law.
    """
    named = named_fund(question) if named is None else F.coalesce(named, F.lit(False)) | named_fund(question)
    intent = task_intent(question)
    law, search = says(question, ROUTE_LAW, True), says(question, ROUTE_SEARCH, True)
    with_law = lambda one: F.when(law, F.lit(f"{one}+law")).otherwise(one)
    amounts = F.when(says(question, HOW_MUCH) & ~says(question, PAID), "document+calculation").otherwise("calculation")
    premise = (
        F.when(named & says(question, PRODUCT_PREMISE), "product").when(calculable(question) | says(question, CREDIT), "calculation")
        .when(says(question, [*DEFERRED, "사적연금"]), "document+law").otherwise(with_law("document"))
    )
    institutional = intent.isin("procedure", "institution")
    main = (
        F.when((institutional & ~(named & search)) | (intent == "compound_holding"), "document")
        .when(named | (intent == "product_attribute"), "product")
        .when(says(question, ROUTE_OPERATIONS, True), "document")
        .when(search | (intent == "product_search"), "product")
        .when(says(question, ROUTE_CONCEPT, True) | says(question, ROUTE_DOCUMENT, True) | ~law, "document")
        .when(~says(question, ROUTE_STATED_LAW, True) & says(question, ROUTE_EXPLAIN, True), "document")
    )
    return (
        F.when(tax_rule(question), "document+law")
        .when(product_rule(question) & ~says(question, COMPARED), F.when(limit_rule(question), "document+product").otherwise("document"))
        .when(limit_rule(question), "document+product")
        .when(calculable(question), amounts)
        .when(intent == "action_request", F.when(named, "product").otherwise(with_law("document")))
        .when(intent == "tax_calculation", F.when(says(question, DEFERRED), "document+law").otherwise("calculation"))
        .when(intent == "correction", premise)
        .otherwise(F.concat_ws("+", main, F.when(law, F.lit("law"))))
    )


def law_topic(question: Column) -> Column:
    """(topic, source, article) of the law that a question is about; null if none is. The tax topic has no single article."""
    low = F.lower(question)
    found = lambda topic, source, article: F.struct(F.lit(topic).alias("topic"), F.lit(source).alias("source"), F.lit(article).cast("string").alias("article"))
    irp = says(low, ["irp", "개인형퇴직연금", "개인형 퇴직연금"])
    return (
        F.when(irp & says(question, ["인출"]), found("IRP_WITHDRAWAL", "RETIREMENT_BENEFIT_ACT", None))
        .when(irp, found("IRP", "RETIREMENT_BENEFIT_ACT", "제24조"))
        .when(says(question, ["DB형", "확정급여형", "확정급여"]), found("DB", "RETIREMENT_BENEFIT_ACT", "제13조"))
        .when(says(question, ["DC형", "확정기여형", "확정기여"]), found("DC", "RETIREMENT_BENEFIT_ACT", "제19조"))
        .when(says(question, ["세액공제", "연금계좌", "연금저축"]), found("TAX_CREDIT", "TAX", None))
    )


def reject_rows(question: Column, text: Column, most: int = 5) -> Column:
    """(code, reason, detail) of a text's rows ``NN. reason | detail`` that a question about refused transfers asks for, ``most`` by code.

    The catch-all row 99 is never an answer. A question's own conditions must stand in the row; without any, rows of the common kinds count if it asks for codes.
    Both arguments must be plain columns, as rows look at them one by one.
    """
    asked = F.filter(F.array(*map(F.lit, REJECT_FOCUS)), lambda w: F.contains(F.lower(question), w))
    codes = says(question, ASKS_CODE) & says(question, ASKS_TRANSFER)
    found = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({REJECT_ROW})"), 1),
        lambda r: F.struct(*(F.trim(F.regexp_extract(r, REJECT_ROW, i + 1)).alias(n) for i, n in enumerate(("code", "reason", "detail")))),
    )

    def fits(row):
        blob = F.lower(F.concat_ws(" ", row["reason"], row["detail"]))
        own = F.when(F.size(asked) > 0, F.exists(asked, lambda w: F.contains(blob, w))).otherwise(codes & says(blob, REJECT_ANY))
        return (row["code"] != "99") & ~row["reason"].rlike(REJECT_REST) & own

    kept = F.filter(found, fits)
    firsts = F.filter(F.transform(kept, lambda x, i: F.struct(x["code"].alias("code"), i.alias("i"), x["reason"].alias("reason"), x["detail"].alias("detail"))), lambda x: x["code"].isNotNull())
    once = F.array_sort(F.aggregate(firsts, F.array().cast("array<struct<code:string,i:int,reason:string,detail:string>>"), lambda a, x: F.when(F.exists(a, lambda y: (y["code"] == x["code"]) & (y["reason"] == x["reason"])), a).otherwise(F.concat(a, F.array(x)))))
    return F.transform(F.slice(once, 1, most), lambda x: F.struct(x["code"], x["reason"], x["detail"]))


def sentence_windows(text: Column, before: int = 80, after: int = 140, terms: list[str] | None = None) -> Column:
    """Each sentence of a text with so many characters before and after it; with ``terms`` only those that hold one. A text is read once: its windows are cut where the sentences are found."""

    @F.pandas_udf("array<string>")
    def cut(texts):
        piece = re.compile(r"[^\n.!?]+[.!?]?|[\n.!?]")
        holds = (lambda w: any(t in w for t in terms)) if terms else (lambda w: True)

        def windows(x):
            if x is None or not holds(x):
                return []
            spans = (m.span() for m in piece.finditer(x) if m[0][0] not in "\n.!?")
            return [w for start, end in spans if holds(w := x[max(start - before, 0) : end + after])]

        return texts.map(windows)

    return F.filter(F.transform(cut(text), lambda w: F.regexp_replace(w, r"^\s+|\s+$", "")), lambda w: w != "")


def slot(text: Column, terms: list[str], pattern: str | None = None, most: int = 3) -> Column:
    """The first ``most`` sentence windows that hold one of the terms and match the pattern; with no terms any sentence may. Empty: the slot is missing."""
    fits = lambda w: (says(w, terms) if terms else F.lit(True)) & (w.rlike(pattern) if pattern else F.lit(True))
    return F.slice(F.filter(sentence_windows(text, terms=terms), fits), 1, most)
