"""Metrics of a ranked list (array of ids) against relevant ids, as native expressions.

No labels give null where a metric needs them; an empty list gives 0 or null as documented.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, rate


def _top(items: Column, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.slice(items, 1, k)


def precision_at(items: Column, relevant: Column, k: int) -> Column:
    """Relevant ranks, repeats counted, over the ranks that are there; an empty list gives 0."""
    return F.coalesce(let(_top(items, k), lambda t: rate(F.size(F.filter(t, lambda x: F.array_contains(relevant, x))), F.size(t))), F.lit(0.0))


def recall_at(items: Column, relevant: Column, k: int) -> Column:
    return rate(F.size(F.array_intersect(_top(items, k), relevant)), F.size(relevant))


def hit_at(items: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) > 0, F.coalesce(F.arrays_overlap(_top(items, k), relevant), F.lit(False)).cast("double"))


def reciprocal_rank(items: Column, relevant: Column, k: int | None = None) -> Column:
    top = items if k is None else _top(items, k)
    ranks = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(relevant) > 0, F.coalesce(F.try_divide(F.lit(1.0), F.array_min(ranks)), F.lit(0.0)))


def average_precision(items: Column, relevant: Column, k: int | None = None) -> Column:
    """Over first hits: hits so far by rank, summed, over the number of relevant ids."""
    top = items if k is None else _top(items, k)

    def total(t: Column) -> Column:
        start = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            rank = acc["rank"] + 1
            first = F.array_contains(relevant, x) & (F.array_position(t, x) == rank)
            hits = acc["hits"] + first.cast("int")
            return F.struct(rank.alias("rank"), hits.alias("hits"), (acc["sum"] + F.when(first, hits / rank).otherwise(0.0)).alias("sum"))

        return F.aggregate(t, start, step, lambda acc: acc["sum"])

    return F.when(F.size(relevant) > 0, let(top, total) / F.size(relevant))


def _dcg(gains: Column) -> Column:
    return F.aggregate(F.transform(gains, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def ndcg(items: Column, relevance: Column, k: int) -> Column:
    """``relevance`` maps ids to gains; negative gains count as 0, a repeated id gains nothing."""
    gain = lambda x: F.greatest(F.coalesce(F.try_element_at(relevance, x), F.lit(0.0)), F.lit(0.0))
    got = let(_top(items, k), lambda t: F.transform(t, lambda x, i: F.when(F.array_position(t, x) == i + 1, gain(x)).otherwise(0.0)))
    best = F.slice(F.sort_array(F.transform(F.map_values(relevance), lambda g: F.greatest(g, F.lit(0.0))), asc=False), 1, k)
    return let(_dcg(best), lambda ideal: F.when(ideal > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dcg(got) / ideal))))


def labelled_relevance(items: Column, relevant: Column) -> Column:
    """Gains as the ranking wrapper builds them.

    ``items`` are structs (id, relevance).  A retrieved item has its own relevance, 0 where it
    has none, even if it is labelled; only labels that were not retrieved get 1.
    """
    ids = F.transform(items, lambda x: x["id"])
    own = F.transform(items, lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["relevance"], F.lit(0.0)).alias("g")))
    rest = F.transform(F.array_except(relevant, ids), lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("g")))
    both = F.concat(own, rest)
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["id"] == x["id"]))
    return F.map_from_entries(last)


def coverage(items: Column, expected: Column) -> Column:
    return rate(F.size(F.array_intersect(items, expected)), F.size(F.array_distinct(expected)))


def duplicate_rate(items: Column) -> Column:
    return F.coalesce(rate(F.size(items) - F.size(F.array_distinct(items)), F.size(items)), F.lit(0.0))


def utilization(items: Column, used: Column) -> Column:
    return rate(F.size(F.array_intersect(items, used)), F.size(F.array_distinct(items)))


def citations(answer: Column) -> Column:
    """The cited sources, in order."""
    return F.regexp_extract_all(answer, F.lit(r"\[source:([A-Za-z0-9._:/-]{1,200})\]"), F.lit(1))


def citation_validity(cited: Column, known: Column) -> Column:
    """The share of citations, repeats counted, of known sources; none gives 0."""
    return F.coalesce(rate(F.size(F.filter(cited, lambda x: F.array_contains(known, x))), F.size(cited)), F.lit(0.0))


def citation_scores(answer: Column, known: Column, required: Column) -> Column:
    """``presence, validity, correctness, completeness`` of an answer's citations.

    Correctness is the share of the cited ids that are known and required by labelled claims, completeness that of the
    required ids that are cited; both are null where no claim has a label, not inferred.  Repeats count in validity alone.
    """

    def scores(cited: Column) -> Column:
        ids, wanted = F.array_distinct(cited), F.array_distinct(F.coalesce(required, F.array().cast("array<string>")))
        right = F.array_intersect(F.array_intersect(ids, known), wanted)
        labelled = F.size(wanted) > 0
        return F.struct(
            (F.size(cited) > 0).cast("double").alias("presence"),
            citation_validity(cited, known).alias("validity"),
            F.when(labelled, F.coalesce(rate(F.size(right), F.size(ids)), F.lit(0.0))).alias("correctness"),
            F.when(labelled, rate(F.size(F.array_intersect(ids, wanted)), F.size(wanted))).alias("completeness"),
        )

    return let(citations(answer), scores)


def checked_judgment(score: Column, confidence: Column, justification: Column) -> Column:
    """The score of an evidence judgment; one outside of [0, 1], or without a justification, fails the query."""
    inside = F.coalesce(score.between(0, 1) & confidence.between(0, 1), F.lit(False))
    told = F.coalesce(F.length(F.regexp_replace(justification, r"(?U)\s+", "")) > 0, F.lit(False))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("double")
    return F.when(~inside, wrong("judge score and confidence must be in [0, 1]")).when(~told, wrong("judge justification must not be empty")).otherwise(score.cast("double"))


def claim_support(score: Column) -> list[Column]:
    """Aggregates: mean support of claims, and the share of those without any; null without a judgment."""
    return [F.avg(score).alias("faithfulness"), F.avg((score == 0).cast("double")).alias("unsupported_claim_rate")]
