"""Values as readers see them. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import trimmed_number

# What stands before and after a number of a unit, the states in which no number is shown, and what is said in its place.
UNIT_FORMS = {
    "PERCENT_PER_YEAR": ("연 ", "%"),
    "PERCENT_PER_MONTH": ("월 ", "%"),
    "PERCENT": ("", "%"),
    "KRW": ("", "원"),
    "WON": ("", "원"),
    "BASIS_POINT": ("", "bp"),
    "BP": ("", "bp"),
    "DECIMAL": ("", " (소수, 단위 확인 필요)"),
}
UNKNOWN_UNIT = ("", " (단위 확인 필요)")
DOUBTFUL = ["SCALE_MISMATCH", "SOURCE_CONFLICT", "UNVERIFIED", "UNIT_MISSING"]
NO_VALUE, DOUBTFUL_VALUE = "확인된 값 없음", "수익률 값의 단위/스케일 확인이 필요합니다"


def shown_value(value: Column, unit: Column, status: Column) -> Column:
    """The text that stands for a stored number: with its unit, in any spelling of case and outer spaces; the scale is never converted.

    A null value has a text of its own, and so has one whose status is doubtful. Null, empty and unknown units ask for the unit to be confirmed; a null status is none. Never null.
    """
    forms = F.create_map(*(F.lit(x) for name, form in UNIT_FORMS.items() for x in (name, f"{form[0]}|{form[1]}")))
    form = F.split(F.coalesce(F.try_element_at(forms, F.coalesce(F.upper(F.trim(unit)), F.lit(""))), F.lit("|".join(UNKNOWN_UNIT))), r"\|")
    said = F.concat(form[0], trimmed_number(value.cast("double"), 6), form[1])
    return F.when(value.isNull(), NO_VALUE).when(F.coalesce(status.isin(DOUBTFUL), F.lit(False)), DOUBTFUL_VALUE).otherwise(said)
