"""A walk of two JSON texts side by side, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

CHANGES = "array<struct<pointer:string,before:string,after:string>>"


def pointer_part(name: Column) -> Column:
    """A name as a part of a JSON pointer (RFC 6901)."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("{")), F.lit(False))


def _members(text: Column) -> Column:
    return F.from_json(text, "map<string,variant>")


def _opened(change: Column) -> Column:
    """The members of two objects that differ, by name; a member that one side lacks is whole."""

    def both(b: Column, a: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.concat(F.map_keys(b), F.map_keys(a))))
        part = lambda n: F.struct(
            F.concat(change["pointer"], F.lit("/"), pointer_part(n)).alias("pointer"),
            F.to_json(F.try_element_at(b, n)).alias("before"),
            F.to_json(F.try_element_at(a, n)).alias("after"),
        )
        return F.filter(F.transform(names, part), lambda c: ~c["before"].eqNullSafe(c["after"])).cast(CHANGES)

    return let(_members(change["before"]), lambda b: let(_members(change["after"]), lambda a: both(b, a)))


def _open(change: Column) -> Column:
    return _is_object(change["before"]) & _is_object(change["after"])


def json_changes(before: Column, after: Column, pointer: str = "") -> Column:
    """``(pointer, before, after)`` of every difference of two JSON texts, members in the order of their names.

    Objects on both sides are entered, to any depth; all other values, arrays included, are
    compared whole.  What one side lacks is null there, which a JSON ``null`` is not.  The names of a pointer are escaped.
    Equal texts have no changes; a difference at the top has the pointer ``/`` if none is given.

    Texts should be canonical JSON: numbers are compared as they are written.  Parts are written
    again by Spark, so that a number beyond its decimals may look different (1.0E21).
    """
    top = F.array(F.struct(F.lit(pointer).alias("pointer"), before.alias("before"), after.alias("after"))).cast(CHANGES)
    # an object is opened in each step, so there are no more steps than braces on one side
    steps = F.sequence(F.lit(0), F.length(before) - F.length(F.replace(before, F.lit("{"), F.lit(""))))
    step = lambda acc, _: F.when(F.exists(acc, _open), F.flatten(F.transform(acc, lambda c: F.when(_open(c), _opened(c)).otherwise(F.array(c).cast(CHANGES))))).otherwise(acc)
    found = F.aggregate(F.coalesce(steps, F.array(F.lit(0))), top, step)
    named = F.transform(found, lambda c: F.struct(F.when(c["pointer"] == "", "/").otherwise(c["pointer"]).alias("pointer"), c["before"].alias("before"), c["after"].alias("after"))).cast(CHANGES)
    return F.when(before.eqNullSafe(after), F.array().cast(CHANGES)).otherwise(named)
