"""Text expressions shared by the metrics; all native but for the exact Unicode forms."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(expr: Column, body) -> Column:
    """Bind ``expr`` once: Catalyst would otherwise inline it into lambdas and redo it."""
    return F.element_at(F.transform(F.array(expr), body), 1)


#: A word: letters and numbers of any script, and underscores; marks are no part of it.
WORD = r"[\p{L}\p{N}_]+"


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@cache
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What Unicode's full case folding makes of single characters: one other character, or several."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


@cache
def beyond_lower() -> str:
    """A pattern of the ranges that hold all characters, but the sharp s, whose case folding may differ from their lower case."""
    points = [n for n in range(128, sys.maxunicode + 1) if (c := chr(n)) not in "ßẞ" and (c.casefold() != c.lower() or len(c.lower()) > 1 or c == "Σ")]
    points += [ord("ẞ")]
    ranges = []
    for n in sorted(points):
        if ranges and n - ranges[-1][1] <= 16:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges) + "]"


def casefold(text: Column) -> Column:
    """Full case folding, native; null stays null.

    Most texts are lower-cased, with the sharp s replaced.  Those with a character that folds to another than its lower case
    are translated, and the hundred characters that fold to several are replaced one by one only in texts that hold one.
    """
    one, several = foldings()
    rest = {c: f for c, f in several.items() if c != "ß"}
    plain = F.replace(F.translate(text, "".join(one), "".join(one.values())), F.lit("ß"), F.lit("ss"))
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in rest.items()])
    whole = F.aggregate(table, plain, lambda t, p: F.replace(t, p["c"], p["f"]))
    simple = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.when(ascii_only(text), F.lower(text)).when(~text.rlike(beyond_lower()), simple).when(text.rlike(f"[{''.join(rest)}]"), whole).otherwise(plain)


def normalized(text: Column) -> Column:
    """NFC, case folded, white space collapsed and trimmed; only texts beyond ASCII leave the JVM for it."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.coalesce(exact_normalized(F.when(~ascii_only(text), text)), plain)


@F.pandas_udf(T.StringType())
def exact_normalized(text: pd.Series) -> pd.Series:
    """NFC, case folded, white space collapsed and trimmed; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in NFC; only texts beyond ASCII leave the JVM for it."""
    return F.coalesce(_nfc(F.when(~ascii_only(text), text)), text)


def tokens(text: Column) -> Column:
    """The case-folded words, and single characters that are neither word nor space; native.

    The text is taken to be in NFC.  Select ``composed(text)`` as a column first where it may not be: Spark takes
    no Python function inside the lambdas that tokens go into.
    """
    return F.regexp_extract_all(casefold(text), F.lit(WORD + r"|(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"), F.lit(0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays share, with repeats; a null array shares none.

    Both are sorted together, those of ``a`` first among equals, and one fold pairs each of ``b`` with one that is left.
    """
    tag = lambda elements, k: F.transform(elements, lambda x: F.struct(x.alias("x"), F.lit(k).alias("k")))

    def step(s: Column, e: Column) -> Column:
        left = F.when(s["x"] == e["x"], s["left"]).otherwise(0)
        hit = (e["k"] == 1) & (left > 0)
        return F.struct(e["x"].alias("x"), F.when(e["k"] == 0, left + 1).when(hit, left - 1).otherwise(left).alias("left"), F.when(hit, s["hits"] + 1).otherwise(s["hits"]).alias("hits"))

    def count(both: Column) -> Column:
        start = F.struct(F.get(both, F.lit(0))["x"].alias("x"), F.lit(0).alias("left"), F.lit(0).cast("long").alias("hits"))
        return F.aggregate(both, start, step, lambda s: s["hits"])

    return F.coalesce(let(F.sort_array(F.concat(tag(a, 0), tag(b, 1))), count), F.lit(0).cast("long"))


def precision_recall_f1(prediction: Column, reference: Column) -> Column:
    """Multiset token overlap; an empty side is right only if both are empty."""

    def scored(p: Column, r: Column) -> Column:
        def out(n: Column) -> Column:
            precision = F.when(F.size(p) == 0, (F.size(r) == 0).cast("double")).otherwise(n / F.size(p))
            recall = F.when(F.size(r) == 0, (F.size(p) == 0).cast("double")).otherwise(n / F.size(r))
            f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
            return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

        return let(multiset_overlap(p, r), out)

    return let(prediction, lambda p: let(reference, lambda r: scored(p, r)))


def ngrams(words: Column, n: int) -> Column:
    """The distinct n-grams of a bound array; fewer than n words give none."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), "\x1f"))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def text_ngrams(text: Column, n: int = 5) -> Column:
    """The distinct n-grams of the case-folded words."""
    return let(F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0)), lambda t: ngrams(t, n))


def gram_hashes(text: Column, n: int = 5) -> Column:
    """The distinct n-grams of ``text_ngrams`` as 64-bit hashes of their words' hashes, without making the grams' texts."""
    words = F.transform(F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def made(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))

    return let(words, made)


def rate(part: Column, whole: Column) -> Column:
    """Null for an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
