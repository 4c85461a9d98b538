"""Deterministic rules: risk buckets, eligibility, contribution and tax arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grades from 1 (highest risk) to 6 (lowest), the buckets of each tolerance, and the patterns of affirmed and denied eligibility.
GRADE_LABELS = {1: "매우 높은 위험", 2: "높은 위험", 3: "다소 높은 위험", 4: "보통 위험", 5: "낮은 위험", 6: "매우 낮은 위험"}
GRADE_BUCKETS = {1: "VERY_AGGRESSIVE", 2: "AGGRESSIVE", 3: "MODERATE_AGGRESSIVE", 4: "MODERATE", 5: "CONSERVATIVE", 6: "VERY_CONSERVATIVE"}
TOLERANCE = {
    "conservative": {"preferred": ["CONSERVATIVE", "VERY_CONSERVATIVE"], "acceptable": ["MODERATE"]},
    "moderate": {"preferred": ["MODERATE"], "acceptable": ["CONSERVATIVE", "MODERATE_AGGRESSIVE"]},
    "aggressive": {"preferred": ["AGGRESSIVE", "MODERATE_AGGRESSIVE"], "acceptable": ["VERY_AGGRESSIVE", "MODERATE"]},
}
IRP_LABEL = r"(?:\bIRP\b|개인형\s*퇴직연금|개인\s*퇴직계좌)"
IRP_DENIED = r"(?i)" + IRP_LABEL + r"[^.。;\n]{0,32}?(?:불가|불가능|금지|제외|가입할\s*수\s*없|가입\s*대상[이가]?\s*아[님니]|not\s+(?:eligible|allowed)|ineligible)"
IRP_AFFIRMED = r"(?i)" + IRP_LABEL + r"\s*(?:계좌\s*)?(?:가입\s*(?:가능|허용)|가입할\s*수\s*있|전용|가입자|가입\s*대상|투자\s*가능|매수\s*가능)"
IRP_CLAUSES = r"[.。;\n]|(?:하지만|다만|그러나)"
IRP_CODES = ["IRP", "INDIVIDUAL_RETIREMENT_PENSION", "PERSONAL_RETIREMENT_PENSION"]
IRP_NAMES = ["개인형퇴직연금", "개인퇴직계좌"]
OTHERS_ONLY = r"(?i)(?:DB|DC)\s*형\s*(?:전용|가입자\s*(?:전용|만)|만(?:의|을)?)"


def risk_bucket(label: Column, grade: Column) -> Column:
    """The bucket that a label names, else that of the grade; null if neither is known."""
    bare = F.regexp_replace(label, r"[ \[\]]", "")
    by_label, by_grade = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, name in GRADE_LABELS.items():
        by_label = F.when(bare == name.replace(" ", ""), GRADE_BUCKETS[g]).otherwise(by_label)
        by_grade = F.when(grade == g, GRADE_BUCKETS[g]).otherwise(by_grade)
    return F.coalesce(by_label, by_grade)


def risk_match(bucket: Column, tolerance: str) -> Column:
    """2 for a preferred bucket, 1 for an acceptable one, else 0."""
    rule = TOLERANCE[tolerance]
    return F.when(bucket.isin(rule["preferred"]), 2).when(bucket.isin(rule["acceptable"]), 1).otherwise(0)


def tolerated(bucket: Column, tolerance: str) -> Column:
    """Unknown buckets are not tolerated."""
    return F.coalesce(risk_match(bucket, tolerance) > 0, F.lit(False))


def evidence_score(*facts: Column) -> Column:
    """How many of the facts are there."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in facts), F.lit(0))


def eligibility(codes: Column, *texts: Column, types: tuple[Column, ...] = ()) -> Column:
    """ELIGIBLE only by explicit affirmation, INELIGIBLE by denial or by being for DB or DC members only, UNRESOLVED if both or neither.

    ``types``: texts that name a pension type; the exact name of the type affirms too.
    """
    yes = F.exists(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.upper(F.trim(c)).isin(IRP_CODES))
    no = F.lit(False)
    for name in types:
        yes = yes | F.coalesce(F.upper(F.regexp_replace(name, r"\s+", "")).isin(IRP_CODES + IRP_NAMES), F.lit(False))
    for text in (*texts, *types):
        no = no | F.coalesce(text.rlike(OTHERS_ONLY), F.lit(False))
        clauses = F.split(F.coalesce(text, F.lit("")), IRP_CLAUSES)
        no = no | F.exists(clauses, lambda c: c.rlike(IRP_DENIED))
        yes = yes | F.exists(clauses, lambda c: c.rlike(IRP_AFFIRMED) & ~c.rlike(IRP_DENIED))
    return F.when(yes & ~no, "ELIGIBLE").when(no & ~yes, "INELIGIBLE").otherwise("UNRESOLVED")


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def income_gap(target: Column, expected: Column) -> Column:
    return F.greatest(F.lit(0).cast("decimal(18,2)"), money(target) - money(expected))


def effective_rate(rate: Column, surcharge: Column) -> Column:
    """rate x (1 + surcharge), half-even at four decimals."""
    return F.bround(rate.cast("decimal(10,6)") * (F.lit(1).cast("decimal(10,6)") + surcharge.cast("decimal(10,6)")), 4).cast("decimal(12,4)")


def tax_credit(contribution: Column, limit: Column, rate: Column, surcharge: Column) -> Column:
    """Half-up to whole units of min(contribution, limit) x effective rate."""
    return F.round(F.least(money(contribution), money(limit)) * effective_rate(rate, surcharge), 0).cast("decimal(20,0)")


def transfer_extra(amount: Column, ratio: Column, cap: Column) -> Column:
    return F.round(F.least(money(amount) * ratio.cast("decimal(10,6)"), money(cap)), 0).cast("decimal(20,0)")


def calculation_status(required: list[Column], nonnegative: list[Column], policy: Column) -> Column:
    """CLARIFY for missing inputs, then UNSUPPORTED_POLICY_VERSION, then INVALID_INPUT, else OK."""
    missing, bad = F.lit(False), F.lit(False)
    for c in required:
        missing = missing | c.isNull()
    for c in nonnegative:
        bad = bad | F.coalesce(c < 0, F.lit(False))
    return F.when(missing, "CLARIFY").when(policy.isNull(), "UNSUPPORTED_POLICY_VERSION").when(bad, "INVALID_INPUT").otherwise("OK")
