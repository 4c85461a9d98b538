"""Constraints on nested records, declared as a table and judged in one pass.

A rule names a path, what must hold there, how bad it is if it does not, when it applies at all, and which rules must hold first. A path with ``[]`` means
every item of an array. Rules are compiled to column expressions and put in the order of their dependencies: one projection for each depth, no
join, and one scan however many rules there are. A rule whose condition is not met, or that depends on a rule that failed or was itself switched off, is
``NOT_APPLICABLE``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, FAILED, NOT_APPLICABLE = "OK", "FAILED", "NOT_APPLICABLE"
FOUND, NOT_FOUND = "FOUND", "NOT_FOUND"
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
#: States that a field can be left in by its owner; REJECTED and unknown ones mean that it was not found.
STATES = [FOUND, NOT_FOUND, NOT_APPLICABLE, "AMBIGUOUS", "LOW_CONFIDENCE", "CONFLICT"]

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``holds``: a condition on the value at ``path`` (with ``[]``: on each item's). ``when``: a condition on the record. ``after``: names of rules that must hold first.

    A null condition is a failure for a value and "does not apply" for ``when``.
    """

    name: str
    path: str
    holds: Check
    severity: str = WARNING
    when: Column | None = None
    after: tuple[str, ...] = ()


def present(value: Column) -> Column:
    """Neither null nor blank."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def within(low, high) -> Check:
    """A number between two bounds, both included; no value is no failure."""
    return lambda v: v.isNull() | v.between(low, high)


def one_of(*values) -> Check:
    return lambda v: v.isNull() | v.isin(*values)


def known(ids: Column) -> Check:
    """All of an array of references (or one reference) are among ``ids``. Without references it holds."""
    return lambda v: v.isNull() | F.array_contains(ids, v)


def distinct(key: Check) -> Check:
    """For a path to a whole array: no two items have the same key."""
    return lambda items: items.isNull() | (F.size(F.array_distinct(F.transform(items, key))) == F.size(items))


def _value(path: str) -> Column:
    head, *rest = path.split(".")
    return reduce(lambda c, name: c[name], rest, F.col(head))


def _failures(rule: Rule) -> Column:
    """The places (from 1, 0 for the record itself) where the rule fails."""
    no = lambda v: ~F.coalesce(rule.holds(v), F.lit(False))
    if "[]" not in rule.path:
        return F.when(no(_value(rule.path)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    items, _, inner = rule.path.partition("[]")
    steps = [x for x in inner.split(".") if x]
    at = F.transform(F.coalesce(_value(items), F.array()), lambda item, i: F.when(no(reduce(lambda c, name: c[name], steps, item)), i + 1))
    return F.array_compact(at)


def _depths(rules: list[Rule]) -> list[list[Rule]]:
    named, depth = {r.name: r for r in rules}, {}
    if len(named) != len(rules):
        raise ValueError("rules of one name")

    def of(name: str, path: tuple = ()) -> int:
        if name in path:
            raise ValueError(f"rules depend on each other: {' -> '.join([*path, name])}")
        if name not in named:
            raise ValueError(f"no rule {name}")
        if name not in depth:
            depth[name] = 1 + max((of(x, (*path, name)) for x in named[name].after), default=-1)
        return depth[name]

    out: list[list[Rule]] = []
    for r in rules:
        while len(out) <= of(r.name):
            out.append([])
        out[of(r.name)].append(r)
    return out


def judged(records: DataFrame, rules: list[Rule], into: str = "checks", status: str = "status") -> DataFrame:
    """``records`` with ``into`` (for each rule, in the order of ``rules``: ``rule, path, severity, state, places``) and ``status``: failed, warning or success.

    An empty table gives no rows. Column names that begin with ``_rule_`` are reserved.
    """
    out = records
    for level in _depths(rules):
        new = {}
        for r in level:
            applies = [F.coalesce(r.when, F.lit(False))] if r.when is not None else []
            applies += [F.col(f"_rule_{x}")["state"] == OK for x in r.after]
            places = _failures(r)
            if applies:
                places = F.when(reduce(lambda a, b: a & b, applies), places)
            new[f"_rule_{r.name}"] = places
        out = out.withColumns(new)
        state = lambda c: F.when(F.col(c).isNull(), NOT_APPLICABLE).when(F.size(c) > 0, FAILED).otherwise(OK)
        out = out.withColumns({c: F.struct(state(c).alias("state"), F.coalesce(c, F.array().cast("array<int>")).alias("places")) for c in new})
    checks = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.severity).alias("severity"), F.col(f"_rule_{r.name}")["state"].alias("state"), F.col(f"_rule_{r.name}")["places"].alias("places")) for r in rules])
    out = out.withColumn(into, checks).drop(*[f"_rule_{r.name}" for r in rules])
    failed = lambda severity: F.exists(into, lambda c: (c["state"] == FAILED) & (c["severity"] == severity))
    return out.withColumn(status, F.when(failed(ERROR), "failed").when(failed(WARNING), "warning").otherwise("success"))


def without_dangling(items: Column, field: str, ids: Column) -> Column:
    """``items`` whose array ``field`` keeps only references that are among ``ids``."""
    return F.transform(items, lambda x: x.withField(field, F.filter(F.coalesce(x[field], F.array()), lambda r: F.array_contains(ids, r))))


@dataclass(frozen=True)
class Field:
    """A field of the final record: whether it was ``found``, the state its owner left (a column, null: no owner), and when it is ``not_applicable``."""

    path: str
    found: Column
    owner: Column | None = None
    not_applicable: Column | None = None


def field_status(fields: list[Field]) -> Column:
    """A map from path to state: FOUND if found, else NOT_APPLICABLE by its rule, else its owner's state if that is one of ``STATES``, else NOT_FOUND."""
    out = []
    for f in fields:
        owner = F.upper(f.owner) if f.owner is not None else F.lit(None).cast("string")
        state = F.when(F.coalesce(f.found, F.lit(False)), FOUND)
        if f.not_applicable is not None:
            state = state.when(F.coalesce(f.not_applicable, F.lit(False)), NOT_APPLICABLE)
        out += [F.lit(f.path), state.when(owner.isin(*STATES), owner).otherwise(NOT_FOUND)]
    return F.create_map(*out)
