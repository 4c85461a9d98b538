"""Text, number and date expressions. All are column in, column out, and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word of the index is, what a number is, and the units that a number may carry.
TOKEN = r"[A-Za-z]+|[가-힣]{2,}|\d+(?:\.\d+)?"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
UNITS = r"억\s*원|만\s*원|원|%|퍼센트|영업일|개월|등급|년|월|일|세|시간|분|초|개|건"


def tokens(text: Column) -> Column:
    """Lower-cased words, Hangul runs of two or more syllables and numbers, in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1), F.lower)


def compact(text: Column) -> Column:
    """Without white space; the Korean middle dot is unified."""
    return F.regexp_replace(F.translate(text, "ㆍ", "·"), r"[\s　]+", "")


def fold(text: Column) -> Column:
    """Lower-cased letters, digits and Hangul alone, for comparing names."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z가-힣]+", ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_number(text: Column) -> Column:
    """The first number in a text as double, thousands separators removed; null if there is none."""
    return _number(F.regexp_extract(text, f"({NUMBER})", 1))


def _number(found: Column) -> Column:
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def all_numbers(text: Column) -> Column:
    """All numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), _number)


def nearly(a: Column, b: Column, tolerance: float = 5e-4) -> Column:
    """Equal within a tolerance; never true for nulls, never null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def trimmed_number(x: Column, places: int) -> Column:
    """A number with at most ``places`` decimals and no zeros at its end."""
    return F.regexp_replace(F.format_string(f"%.{places}f", x), r"\.?0+$", "")


def date_spellings(day: Column) -> Column:
    """The ways in which a date may be written in a source."""
    forms = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy.M.d", "yyyy-M-d", "yyyy년 M월 d일", "yyyy년M월d일")
    return F.array(*[F.date_format(day, f) for f in forms])


def mentions_date(text: Column, day: Column) -> Column:
    return F.exists(date_spellings(day), lambda s: F.contains(text, s))


def long_date(text: Column) -> Column:
    """``YY.MM.DD`` and four-digit forms as ``20YY-MM-DD``; other texts unchanged."""
    short = F.regexp_replace(text, r"^(\d{2})[./-](\d{2})[./-](\d{2})$", "20$1-$2-$3")
    return F.regexp_replace(short, r"^(\d{4})[./](\d{2})[./](\d{2})$", "$1-$2-$3")


def block_overlap(a: Column, b: Column) -> Column:
    """Share of the blocks of ``a`` that ``b`` holds; a block is a quarter of ``a``, 6 to 12 characters, without overlap."""
    width = F.greatest(F.lit(6), F.least(F.lit(12), F.floor(F.length(a) / 4).cast("int")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(a) - width + 1, F.lit(1)), width)
    blocks = F.transform(starts, lambda s: F.substr(a, s, width))
    return F.when(F.length(a) == 0, 0.0).otherwise(F.size(F.filter(blocks, lambda x: F.contains(b, x))) / F.size(blocks))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set's size; 0 for an empty set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def supported(claim: Column, source: Column, share: float = 0.85) -> Column:
    """A claim is supported by a source that holds it as a substring or holds ``share`` of its distinct tokens."""
    own = F.array_distinct(tokens(claim))
    held = F.size(F.array_intersect(own, tokens(source)))
    return F.coalesce(F.contains(compact(source), compact(claim)) | ((F.size(own) > 0) & (held >= share * F.size(own))), F.lit(False))


def suspicious_encoding(text: Column) -> Column:
    """Too many replacement or Latin-1 mis-decoding marks for the text's length."""
    marks = F.length(F.regexp_replace(text, "[^�ÃÂ]", ""))
    return (F.length(text) > 0) & ((marks >= 5) | (marks / F.greatest(F.length(text), F.lit(1)) > 0.02))


def unbroken(text: Column, least: int = 8) -> Column:
    """Lines joined if they are very short on average, as a bad text layer gives them."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    mean = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.trim(x))) / F.greatest(F.size(lines), F.lit(1))
    return F.when((F.size(lines) > 1) & (mean < least), squeeze(text)).otherwise(text)


def safe_id(name: Column) -> Column:
    """A file name without its ending, other characters as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[^0-9A-Za-z가-힣_-]+", "_")


def severity(message: Column) -> Column:
    """Class of a message by its leading words."""
    low = F.lower(message)
    return (
        F.when(low.rlike("^(error|fatal|failed)"), "error")
        .when(low.rlike("^(warn|missing|ambiguous)"), "warning")
        .when(low.rlike("^(debug|trace|diagnostic)"), "diagnostic")
        .otherwise("info")
    )


def numeric_facts(text: Column) -> Column:
    """Distinct (value, unit) that a text states: dates and times by their parts, numbers without zeros at their end, won and percent in one form.

    Names of files, numbers of list items and codes of letters and digits state nothing.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\S+\.(?:pdf|docx|json)(?![\p{L}\p{N}_])", "")
    plain = F.regexp_replace(plain, r"(?m)^\s*\d+[.)]\s+", "")
    plain = F.regexp_replace(plain, r"100\s*분의\s*(\d+(?:\.\d+)?)", "$1%")
    joint = r"(?<!\d)20\d{2}[-./]\d{1,2}[-./]\d{1,2}|(?<![\p{L}\p{N}_])\d{1,2}:\d{2}(?![\p{L}\p{N}_])"

    def moment(x):
        parts = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), lambda n: n.cast("int").cast("string"))
        return F.struct(F.array_join(parts, ":").alias("value"), F.when(F.contains(x, F.lit(":")), "time").otherwise("date").alias("unit"))

    moments = F.transform(F.regexp_extract_all(plain, F.lit(f"({joint})"), 1), moment)
    rest = F.regexp_replace(plain, joint, "")
    rest = F.regexp_replace(rest, r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z0-9_-]*\d[A-Za-z0-9_-]*(?![\p{L}\p{N}_])", "")
    raw = F.regexp_extract_all(rest, F.lit(rf"((?<![A-Za-z0-9])[+-]?\d[\d,]*(?:\.\d+)?\s*(?:{UNITS})?)"), 1)

    def fact(x):
        u = F.regexp_replace(F.regexp_extract(x, rf"({UNITS})$", 1), r"\s", "")
        scale = F.when(u == "만원", F.lit(10_000)).when(u == "억원", F.lit(100_000_000)).otherwise(F.lit(1))
        value = F.replace(F.regexp_extract(x, r"([+-]?\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("decimal(28,6)") * scale
        name = F.when(u.isin("만원", "억원"), "원").when(u == "퍼센트", "%").otherwise(u)
        return F.struct(F.regexp_replace(value.cast("decimal(34,6)").cast("string"), r"\.?0+$", "").alias("value"), name.alias("unit"))

    return F.array_distinct(F.concat(moments, F.transform(raw, fact)))


def unsupported_facts(answer: Column, evidence: Column) -> Column:
    """Facts of an answer that no evidence states with the same unit."""
    return F.array_except(numeric_facts(answer), numeric_facts(evidence))


def redacted(text: Column) -> Column:
    """Keys, bearer tokens, local paths and mail addresses masked."""
    out = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*\S+", "$1=[hidden]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[A-Za-z0-9._-]+", "bearer [hidden]")
    out = F.regexp_replace(out, r"(?:[A-Za-z]:\\|/(?:home|root|Users|var)/)\S+", "[path]")
    return F.regexp_replace(out, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[mail]")
