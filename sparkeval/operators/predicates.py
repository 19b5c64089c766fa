"""Slice predicates: validated dicts compiled to Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {"equals": {"value"}, "not_equals": {"value"}, "in": {"values"}, "contains": {"value"}, "range": {"minimum", "maximum"}, "exists": set()}


def compile_predicate(rule: dict) -> Column:
    """The Column of ``{field, operator, ...}``; unknown operators and keys are refused."""
    operator, name = rule.get("operator"), rule.get("field")
    if operator not in FIELDS or not name:
        raise ValueError(f"no predicate {rule}")
    extra = set(rule) - FIELDS[operator] - {"field", "operator"}
    if extra or (operator not in ("range", "exists") and not FIELDS[operator] <= set(rule)):
        raise ValueError(f"keys of {rule}")
    c = F.col(name)
    if operator == "equals":
        return c == rule["value"]
    if operator == "not_equals":
        return c != rule["value"]
    if operator == "in":
        return c.isin(list(rule["values"]))
    if operator == "contains":
        return F.contains(c, F.lit(rule["value"]))
    if operator == "range":
        low, high = rule.get("minimum"), rule.get("maximum")
        if low is None and high is None:
            raise ValueError("a range needs a limit")
        return all_of([c >= low] * (low is not None) + [c <= high] * (high is not None))
    return c.isNotNull()


def all_of(rules) -> Column:
    return reduce(lambda a, b: a & b, rules)


def any_of(rules) -> Column:
    return reduce(lambda a, b: a | b, rules)
