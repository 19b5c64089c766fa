"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

All of it is DataFrame expressions.  Positions come from the pieces between the matches:
``regexp_extract_all`` gives the matches, ``split`` by the same pattern the gaps, and a
running sum of their lengths the code-point offsets.

The entropy of a window of ``W`` characters is ``log2(W) - S / W`` with
``S = sum(c * log2(c))`` over its character counts.  When the window moves by one
character, one count falls and one rises, so ``S`` and the counts are updated, never
recomputed; a dozen counts share a 64-bit number, so an update writes eleven numbers for a window of 20.  A candidate is judged by the limit of its character class (hex, or base64).

Cases: null and empty texts give no span; equal rows give equal rows; extra columns stay
out of the way, since only the id and text columns are read; an empty table gives an empty
result; overlapping matches of one kind are taken leftmost first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The base kinds in the order of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate that one of these matches as a whole is no secret.
ALLOW = (
    r"[A-Za-z_/=+-]+",  # words, identifiers, paths and rules without a digit
    r"[0-9_/=+-]+",  # numbers, dates, phone numbers
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"(?i).*(example|placeholder|dummy|xxxx).*",
)


@dataclass(frozen=True)
class EntropyRule:
    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.9
    allow: tuple[str, ...] = ALLOW


EMPTY = "array<struct<start:int,stop:int,value:string>>"
BLOCK = 256


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code-point offsets."""

    def within(block: Column) -> Column:
        """The spans of a block from its own beginning, and its length."""

        def step(acc: Column, p: Column) -> Column:
            start = acc["pos"] + p["gap"]
            one = F.struct(start.alias("start"), (start + p["size"]).alias("stop"), p["value"].alias("value"))
            return F.struct((start + p["size"]).alias("pos"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("pos"), F.array().cast(EMPTY).alias("out")), step)

    def after(acc: Column, b: Column) -> Column:
        """A block's spans moved to its place."""
        moved = F.transform(b["out"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), (s["stop"] + acc["pos"]).alias("stop"), s["value"].alias("value"))).cast(EMPTY)
        return F.struct((acc["pos"] + b["pos"]).alias("pos"), F.array_append(acc["out"], moved).alias("out"))

    def located(m: Column, g: Column) -> Column:
        # an array is copied whenever it grows, so spans grow in blocks, and blocks in an array of their own
        parts = F.transform(m, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("size"), x.alias("value")))
        blocks = let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(p, b * BLOCK + 1, BLOCK))))
        first = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{EMPTY}>").alias("out"))
        return F.aggregate(blocks, first, after, lambda acc: F.flatten(acc["out"]))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, F.array().cast(EMPTY)).otherwise(let(F.split(text, pattern, -1), lambda g: located(m, g))),
    )


def _xlog2x(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def max_window_entropy(value: Column, window: int) -> Column:
    """The largest entropy of any window, in bits; a shorter string is one window."""

    bits = window.bit_length()  # of a count, which is the window's length at most
    per = 63 // bits

    def whole(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.ascii(F.get(chars, i))
            old = F.when(i >= window, F.ascii(F.get(chars, i - window))).otherwise(F.lit(-1))
            held = lambda code: F.call_function("shiftright", F.get(acc["counts"], F.floor(code / per).cast("int")), (code % per) * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), (code % per) * bits)
            # one count falls, then one rises; S follows by these two terms alone
            low = F.when(old >= 0, held(old)).otherwise(F.lit(0))
            s1 = F.when(old >= 0, acc["s"] - _xlog2x(low) + _xlog2x(low - 1)).otherwise(acc["s"])
            high = held(new) - F.when(old == new, 1).otherwise(0)
            s2 = s1 - _xlog2x(high) + _xlog2x(high + 1)
            n = F.least(i + 1, F.lit(window)).cast("double")
            full = (i + 1 >= window) | (i + 1 == F.size(chars))
            entropy = F.when(full, F.log2(n) - s2 / n).otherwise(F.lit(0.0))
            none = F.lit(0).cast("long")
            updated = F.when(old == new, acc["counts"]).otherwise(
                F.transform(acc["counts"], lambda c, k: c + F.when(k == F.floor(new / per), one(new)).otherwise(none) - F.when((old >= 0) & (k == F.floor(old / per)), one(old)).otherwise(none))
            )
            return F.struct(updated.alias("counts"), s2.alias("s"), F.greatest(acc["best"], entropy).alias("best"))

        first = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-128 // per)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), first, step, lambda acc: acc["best"])

    return let(F.split(value, ""), whole)


def _named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, base, spans``: the base spans, and those with the entropy spans, by start then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col), text.alias("text")).select(
        id_col,
        "text",
        F.filter(_matches(F.col("text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6).alias("assign"),
        _matches(F.col("text"), ACCESS).alias("access"),
        _matches(F.col("text"), HEX).alias("hex"),
        F.filter(_matches(F.col("text"), CANDIDATE), lambda s: _is_random(s["value"], rule)).alias("entropy"),
    )
    base = F.concat(_named(F.col("assign"), "assign", 0), _named(F.col("access"), "access", 1), _named(F.col("hex"), "hex", 2))
    return found.select(
        id_col,
        "text",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.array_sort(base).alias("base"),
        F.array_sort(F.concat(base, _named(F.col("entropy"), "entropy", 3))).alias("spans"),
    )


def _is_random(value: Column, rule: EntropyRule) -> Column:
    allowed = F.lit(False)
    for pattern in rule.allow:
        allowed = allowed | value.rlike(f"^(?:{pattern})$")
    limit = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(rule.hex_bits)).otherwise(F.lit(rule.base64_bits))
    return F.when(allowed, F.lit(False)).otherwise(max_window_entropy(value, rule.window) >= limit)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The result of ``find_secrets`` with ``redacted``: every span, overlaps merged, replaced by ``mark``."""
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        piece = F.when(fresh, F.concat(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), F.concat(acc["out"], piece).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(F.col("spans"), first, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return found.withColumn("redacted", F.when(F.size("spans") == 0, text).otherwise(done))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    found = find_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pats(kind, rank, re) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]{16,}'), ('hex', 2, '[0-9a-f]{24,}'), ('entropy', 3, '[A-Za-z0-9+/_=-]{20,}')),
a AS (
  SELECT doc_id, text, 'assign' AS kind, 0 AS rank, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
         regexp_split_to_array(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g FROM t
  UNION ALL SELECT doc_id, text, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}'), regexp_split_to_array(text, 'AKIA[A-Z0-9]{16,}') FROM t
  UNION ALL SELECT doc_id, text, 'hex', 2, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') FROM t
  UNION ALL SELECT doc_id, text, 'entropy', 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{20,}') FROM t),
e AS (SELECT doc_id, kind, rank, m, g, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
s0 AS (SELECT doc_id, kind, rank, m[i] AS v, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS start FROM e),
s1 AS (SELECT doc_id, kind, rank, v, start::BIGINT AS start, (start + length(v))::BIGINT AS stop, row_number() OVER () AS sid FROM s0),
cand AS (SELECT sid, v FROM s1 WHERE kind = 'entropy' AND NOT regexp_full_match(v, '[A-Za-z_/=+-]+') AND NOT regexp_full_match(v, '[0-9_/=+-]+')
  AND NOT regexp_full_match(v, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AND NOT regexp_full_match(v, '(?i).*(example|placeholder|dummy|xxxx).*')),
w AS (SELECT sid, v, p, unnest(string_split(substr(v, p::BIGINT, 20), '')) AS ch FROM (SELECT sid, v, unnest(range(1, length(v) - 18)) AS p FROM cand)),
c AS (SELECT sid, v, p, ch, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
h AS (SELECT sid, v, p, log2(20.0) - sum(n * log2(n)) / 20.0 AS bits FROM c GROUP BY ALL),
ok AS (SELECT sid FROM h GROUP BY sid, v HAVING max(bits) >= CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN 3.0 ELSE 3.9 END),
s AS (SELECT doc_id, kind, rank, start, stop FROM s1 WHERE kind IN ('access', 'hex')
  UNION ALL SELECT doc_id, kind, rank, start, stop FROM s1 WHERE kind = 'assign'
     AND length(regexp_extract(v, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6
  UNION ALL SELECT doc_id, kind, rank, start, stop FROM s1 WHERE kind = 'entropy' AND sid IN (SELECT sid FROM ok)),
r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base,
   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN r USING (doc_id)
"""
