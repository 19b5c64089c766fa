"""Metrics of an agent's steps: ``array<struct<step, kind, tool, arguments, success>>`` in step order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, let, rate


def of_kind(steps: Column, kind: str) -> Column:
    return F.filter(steps, lambda s: s["kind"] == kind)


def tool_success_rate(steps: Column) -> Column:
    return let(of_kind(steps, "tool_result"), lambda r: rate(F.size(F.filter(r, lambda s: F.coalesce(s["success"], F.lit(False)))), F.size(r)))


def canonical_arguments(arguments: Column) -> Column:
    """JSON text with its keys in order, at all depths, and without spaces; other text stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)


def redundant_call_rate(steps: Column) -> Column:
    """The share of tool calls that repeat a tool and its arguments, whatever the order of their keys."""
    calls = F.transform(of_kind(steps, "tool_call"), lambda s: F.struct(s["tool"], canonical_arguments(s["arguments"])))
    return F.coalesce(let(calls, lambda c: rate(F.size(c) - F.size(F.array_distinct(c)), F.size(c))), F.lit(0.0))


def tool_selection_accuracy(steps: Column, expected: Column) -> Column:
    """Positions at which call and expected tool agree, over the expected; none expected wants no call."""
    calls = F.transform(of_kind(steps, "tool_call"), lambda s: s["tool"])
    hits = lambda c: F.size(F.filter(F.arrays_zip(c.alias("c"), expected.alias("e")), lambda z: z["c"] == z["e"]))
    return let(calls, lambda c: F.when(F.size(expected) == 0, (F.size(c) == 0).cast("double")).otherwise(rate(hits(c), F.size(expected))))


def recovery_rate(steps: Column) -> Column:
    """The share of failed tool results with a later success or final output; none failed gives null."""

    def good(s: Column) -> Column:
        return ((s["kind"] == "tool_result") & F.coalesce(s["success"], F.lit(False))) | (s["kind"] == "final_output")

    last = F.array_max(F.transform(F.filter(steps, good), lambda s: s["step"]))
    failed = F.filter(steps, lambda s: (s["kind"] == "tool_result") & ~F.coalesce(s["success"], F.lit(False)))
    return let(last, lambda at: let(failed, lambda f: rate(F.size(F.filter(f, lambda s: s["step"] < F.coalesce(at, F.lit(-1)))), F.size(f))))


def find_loop(steps: Column, repetitions: int = 3, longest: int = 4, decision: str | None = None) -> Column:
    """The first and shortest cycle of 1 to ``longest`` actions that calls and decisions repeat ``repetitions`` times in a row.

    ``struct<start, cycle_length>``, null if there is none; ``start`` counts actions from 0.  An
    action is a step's kind, tool, arguments and the field ``decision``, where steps have one.
    """
    if repetitions < 2:
        raise ValueError("a cycle repeats twice at least")
    fields = ["kind", "tool", "arguments", *([decision] if decision else [])]
    kinds = F.filter(steps, lambda s: s["kind"].isin("tool_call", "model_decision"))
    actions = F.transform(kinds, lambda s: F.concat_ws("\x1f", *[F.coalesce(s[f].cast("string"), F.lit("\x00")) for f in fields]))

    def first(a: Column, n: int) -> Column:
        """Where a run of ``n * (repetitions - 1)`` actions that equal the one n before begins its cycle, or -1."""

        def step(acc: Column, i: Column) -> Column:
            r = F.when(F.get(a, i) == F.get(a, i - n), acc["run"] + 1).otherwise(0)
            begin = lambda x: F.when((acc["start"] < 0) & (x >= n * (repetitions - 1)), i - n * repetitions + 1).otherwise(acc["start"])
            return let(r, lambda x: F.struct(x.alias("run"), begin(x).alias("start")))

        found = F.aggregate(F.sequence(F.lit(n), F.size(a) - 1), F.struct(F.lit(0).alias("run"), F.lit(-1).alias("start")), step, lambda acc: acc["start"])
        return F.when(F.size(a) > n, found).otherwise(F.lit(-1))

    def shortest(a: Column) -> Column:
        def cycle(n: int) -> Column:
            return let(first(a, n), lambda x: F.when(x >= 0, F.struct(x.cast("long").alias("start"), F.lit(n).cast("long").alias("cycle_length"))))

        return F.coalesce(*[cycle(n) for n in range(1, longest + 1)])

    return let(actions, shortest)


def has_loop(steps: Column, repetitions: int = 3, longest: int = 4, decision: str | None = None) -> Column:
    """Whether ``find_loop`` finds one."""
    return find_loop(steps, repetitions, longest, decision).isNotNull()


def grounded_share(answer: Column, outputs: Column) -> Column:
    """The share of the answer's distinct words that occur in the outputs; an empty answer gives null."""
    words = lambda t: F.array_distinct(F.filter(F.split(casefold(t), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return let(words(answer), lambda a: rate(F.size(F.array_intersect(a, words(F.array_join(outputs, " ")))), F.size(a)))


def valid_steps(steps: Column) -> Column:
    """Steps count from 0 without a gap."""
    return F.forall(F.transform(steps, lambda s, i: s["step"] == i), lambda ok: ok)
