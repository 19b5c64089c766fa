"""Pair designs and judgments."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rate


def pair_cells(records: DataFrame, variants: list[str], slots: int, repetitions: int) -> DataFrame:
    """A row for each record, unordered pair of variants, slot and repetition; one explode, no join."""
    names = sorted(set(variants))
    if len(names) < 2:
        raise ValueError("at least two variants are needed")
    pairs = F.array(*[F.struct(F.lit(a).alias("left_variant"), F.lit(b).alias("right_variant")) for a, b in combinations(names, 2)])
    rows = records.select("record_key", F.explode(pairs).alias("p")).select("record_key", "p.*")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    return rows.select("record_key", "left_variant", "right_variant", F.col("slot").cast("long").alias("slot"), F.col("repetition").cast("long").alias("repetition"))


def balanced_assignments(cells: DataFrame, seed: int, reversed_pairs: bool = False, size: int | None = None, chunks: int = 1024) -> DataFrame:
    """Who is shown as A: within each pair of variants the sides alternate along a keyed order.

    The order is that of a keyed digest, in place of a shuffle on one machine.  It is cut into
    ``chunks`` by the digest, each chunk is numbered by itself, and the counts of the chunks
    (one small row each) say where a chunk's numbers begin, so no task orders a whole pair.
    """
    key = F.concat_ws("\x1f", "record_key", "left_variant", "right_variant", "slot", "repetition")
    keyed = cells.withColumn("order", F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), key), 256))
    if size is not None:
        keyed = keyed.orderBy("order").limit(size)
    width = 8
    chunk = F.floor(F.conv(F.substring("order", 1, width), 16, 10).cast("long") * chunks / F.lit(16**width)).cast("int")
    keyed = keyed.withColumn("chunk", chunk)
    pair = ["left_variant", "right_variant"]
    sizes = keyed.groupBy(*pair, "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*pair).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*pair, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy(*pair, "chunk").orderBy("order"))
    placed = keyed.withColumn("local", local).join(bases, [*pair, "chunk"])
    first = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *pair), 256), 1, 2), 16, 10).cast("long")
    swap = (first + F.col("base") + F.col("local")) % 2 == 1
    made = placed.select(
        "record_key", "slot", "repetition",
        F.when(swap, F.col("right_variant")).otherwise(F.col("left_variant")).alias("variant_a"),
        F.when(swap, F.col("left_variant")).otherwise(F.col("right_variant")).alias("variant_b"),
        F.lit(False).alias("reversed"),
    )
    if reversed_pairs:
        made = made.unionByName(made.select("record_key", "slot", "repetition", F.col("variant_b").alias("variant_a"), F.col("variant_a").alias("variant_b"), F.lit(True).alias("reversed")))
    ident = F.sha1(F.concat_ws("\x1f", F.lit(str(seed)), "record_key", "variant_a", "variant_b", "slot", "repetition"))
    return made.withColumn("assignment_id", _uuid5_form(ident))


def _uuid5_form(hex40: Column) -> Column:
    """A SHA-1 in the form of a version 5 UUID."""
    part = lambda a, n: F.substring(hex40, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("long") % 64) + 128))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def _count(v: str) -> Column:
    return F.count_if(F.col("verdict") == v)


def _lead(a: Column, b: Column, t: Column, none: str) -> Column:
    return F.when(a + b + t == 0, none).when(a > F.greatest(b, t), "A").when(b > F.greatest(a, t), "B").otherwise("tie")


def aggregate_judgments(judged: DataFrame, key: str) -> DataFrame:
    """Per key: majority (a tie in the lead, or nothing usable, is ``tie``), disagreement, confidence."""
    c = judged.groupBy(key).agg(
        _count("A").alias("a"), _count("B").alias("b"), _count("tie").alias("t"), _count("abstain").alias("abstained"), F.avg(F.when(F.col("verdict") != "abstain", F.col("confidence"))).alias("confidence")
    )
    usable = F.col("a") + F.col("b") + F.col("t")
    most = F.greatest("a", "b", "t")
    return c.select(
        key, _lead(F.col("a"), F.col("b"), F.col("t"), "tie").alias("verdict"), usable.alias("usable"), "abstained", F.coalesce(1 - rate(most, usable), F.lit(1.0)).alias("disagreement"), "confidence"
    )


def aggregate_responses(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: modal verdict (nothing usable is ``abstain``) with mean and median of the scores."""
    v = judged.groupBy(*keys).agg(_count("A").alias("a"), _count("B").alias("b"), _count("tie").alias("t"))
    s = judged.select(*keys, F.explode("scores").alias("dimension", "score")).groupBy(*keys, "dimension").agg(F.median("score").alias("median_score"), F.avg("score").alias("mean_score"))
    return v.select(*keys, _lead(F.col("a"), F.col("b"), F.col("t"), "abstain").alias("verdict")).join(s, keys, "left")


def position_bias(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the rate at which A wins among decisive verdicts (one half if there are none), and how far it is from one half."""
    a, b = _count("A"), _count("B")
    r = F.coalesce(rate(a, a + b), F.lit(0.5))
    return judged.groupBy(*keys).agg(r.alias("a_rate"), F.abs(r - 0.5).alias("deviation"), (a + b).alias("decisive"))


def same_winner(a: str, b: str, verdict: str, ra: str, rb: str, reverse: str) -> Column:
    """Whether two verdicts name one winner; null if either is no win."""
    winner = lambda x, y, v: F.when(F.col(v) == "A", F.col(x)).when(F.col(v) == "B", F.col(y))
    return winner(a, b, verdict) == winner(ra, rb, reverse)


def pair_outcomes(judged: DataFrame) -> DataFrame:
    """Wins and ties of each unordered pair of variants."""
    ordered = F.col("variant_a") < F.col("variant_b")
    first = (F.col("verdict") == "A") == ordered
    rows = judged.where(F.col("verdict").isin("A", "B", "tie")).select(
        F.least("variant_a", "variant_b").alias("a"), F.greatest("variant_a", "variant_b").alias("b"), F.when(F.col("verdict") == "tie", "t").when(first, "a").otherwise("b").alias("w")
    )
    return rows.groupBy("a", "b").agg(F.count_if(F.col("w") == "a").alias("wins_a"), F.count_if(F.col("w") == "b").alias("wins_b"), F.count_if(F.col("w") == "t").alias("ties"))


def judge_drift(baseline: DataFrame, current: DataFrame, most_distance: float = 0.15, most_shift: float = 0.5, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """One row: total-variation distance of the verdicts, shifts of confidence and of each score of ``dimensions``, alert.

    The alert looks at the verdicts and the scores, not at the confidence.  A window without rows gives nulls.
    A row that lacks a score of ``dimensions`` in either window fails the query: means of different rows can't be compared.
    """
    if most_distance < 0 or most_shift < 0:
        raise ValueError("drift thresholds cannot be negative")
    whole = lambda d: F.when(F.col(d).isNotNull(), F.col(d)).otherwise(F.raise_error(F.lit("drift windows must use the same rubric dimensions")).cast("double")).alias(d)
    baseline, current = (w.select("verdict", "confidence", *[whole(d) for d in dimensions]) for w in (baseline, current))

    def shares(df: DataFrame, name: str) -> DataFrame:
        c = df.groupBy("verdict").agg(F.count("*").alias("n"))
        return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select("verdict", (F.col("n") / F.col("all")).alias(name))

    tv = shares(baseline, "p").join(shares(current, "q"), "verdict", "full_outer").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("verdict_distance"))
    means = lambda df, tag: df.agg(*[F.avg(d).alias(f"{tag}{k}") for k, d in enumerate(("confidence", *dimensions))])
    shifts = [(F.col(f"y{k}") - F.col(f"x{k}")).alias(f"{d}_shift") for k, d in enumerate(("confidence", *dimensions))]
    made = tv.crossJoin(means(baseline, "x").crossJoin(means(current, "y")).select(*shifts))
    alert = F.col("verdict_distance") > most_distance
    for d in dimensions:
        alert = alert | (F.abs(f"{d}_shift") > most_shift)
    return made.withColumn("alert", alert)


def ensemble_disagreement(judged: DataFrame, unit: str, verdict: str) -> DataFrame:
    """One row: the share of pairs of verdicts on a unit that differ.

    Pairs are counted, not made: n of a unit give n(n-1)/2, of which those of equal verdicts agree.
    """
    per = judged.groupBy(unit, verdict).agg(F.count("*").alias("c")).groupBy(unit).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per.agg(rate(pairs - F.sum("same"), pairs).alias("mismatch_rate"), pairs.cast("long").alias("pairs"))


def settled_state() -> Column:
    """The state of a run by its counters."""
    left = F.col("total") - F.col("succeeded") - F.col("failed") - F.col("cancelled")
    return F.when(left > 0, "running").when(F.col("cancelled") > 0, "cancelled").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")


def finalized_state(state: Column, active: Column) -> Column:
    """The next state of a run in ``state`` by its counters, ``active`` being the tasks that are leased or running.

    A pausing run is paused once none is active, settled or not.  A settled run goes from cancelling to cancelled, and from running to completed, with
    or without errors; any other state stays.
    """
    left = F.col("total") - F.col("succeeded") - F.col("failed") - F.col("cancelled")
    paused = F.when(active == 0, F.lit("paused")).otherwise(state)
    done = F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    return F.when(state == "pausing", paused).when(left != 0, state).when(state == "cancelling", "cancelled").when(state == "running", done).otherwise(state)
