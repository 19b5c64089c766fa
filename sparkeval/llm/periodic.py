"""Runs of repeated words: maximal periodic stretches of a document, by matching of aligned blocks.

Periods are dealt to scales, powers of two.  A run of ``exponent`` periods or more holds, whatever its
place, a whole block of its scale that starts at a multiple of the block's size and comes back one
period later inside the run.  So for each scale the aligned blocks of a document go into an Aho-Corasick
automaton with integer sequences as keys (a word is a number, and so is a part of a large block), the automaton is searched across the
document, and occurrences at a distance that is one of the scale's periods seed an exact extension to
both sides.  A block whose words do not all come back within the scale's largest period can't be a seed and is left out of the
automaton, which spares ordinary text nearly all of the search.

A document has at most n / size blocks of a scale with about size partners each, so pairs grow with
n log n, runs of a single word included; pairs inside a run that is known, at multiples of its period, are not
extended again.  Documents are rows: they never meet, and a task holds a slice of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST = 4, 6
#: Bytes of text taken from a batch at once.
SLICE = 4 << 20
#: Numbers of a key; larger blocks are keyed by numbers of their parts.
KEY = 32


def _numbered(words: list):
    """Words as integers: equal words, equal numbers."""
    import numpy as np

    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _returns(w):
    """The distance of each word to its next occurrence; beyond all periods if there is none."""
    import numpy as np

    order = np.argsort(w, kind="stable")
    gap = np.full(len(w), len(w) + 1, np.int64)
    same = w[order[1:]] == w[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _alike(w, i: int, j: int) -> int:
    """How many words are equal from i < j on."""
    got, step = 0, 64
    while (left := len(w) - j - got) > 0:
        differ = w[i + got : i + got + min(step, left)] != w[j + got : j + got + min(step, left)]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, step = got + len(differ), 2 * step
    return got


def _primitive(w, start: int, q: int) -> bool:
    """Whether the q words at ``start`` are no power of a shorter word."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            r = q // f
            if (w[start : start + q - r] == w[start + r : start + q]).all():
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _doubled(names, half: int):
    """Numbers of stretches twice as long: equal stretches, equal numbers."""
    import numpy as np

    a, b = names[:-half].astype(np.int64), names[half:].astype(np.int64)
    return np.unique(a * (int(names.max()) + 1) + b, return_inverse=True)[1]


def _pairs(names, part: int, blocks, size: int, low: int, high: int):
    """(block, later occurrence) pairs ``low`` to ``high`` words apart, of the blocks that start at ``blocks``.

    ``names`` has a number for the ``part`` words at each place, and a key is the numbers of a block's
    parts, ``KEY`` of them at most: the automaton's failure links are walked one by one, and those of a long
    periodic key would be many.  The document is searched once for each remainder of the
    place by ``part``, in one sequence with a number of no stretch in between.
    """
    import ahocorasick
    import numpy as np

    known: dict = {}
    keys = names[blocks[:, None] + np.arange(0, size, part)].tolist()
    kind = np.fromiter((known.setdefault(tuple(k), len(known)) for k in keys), np.int64, len(blocks))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, k in known.items():
        automaton.add_word(key, k)
    automaton.make_automaton()
    base = int(blocks[0])
    sub = names[base : int(blocks[-1]) + high + size]
    rows = -(-len(sub) // part) + 1
    line = np.full(rows * part, int(names.max()) + 1, np.int64)
    line[: len(sub)] = sub
    found = np.array([(k, end) for end, k in automaton.iter(tuple(line.reshape(rows, part).T.ravel().tolist()))], np.int64).reshape(-1, 2)
    at = base + found[:, 1] % rows * part + found[:, 1] // rows - (size - part)
    width = base + len(sub) + high + 1
    at = np.sort(found[:, 0] * width + at)
    lo = np.searchsorted(at, kind * width + blocks + low)
    n = np.searchsorted(at, kind * width + blocks + high, "right") - lo
    first = np.cumsum(n) - n
    p = np.repeat(blocks, n)
    o = at[np.repeat(lo - first, n) + np.arange(len(p))] % width
    return p, o


def find_runs(w, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the integer array ``w``, by start, then period.

    A run is a stretch whose smallest period is ``period`` and that can't be extended with it, of at least ``exponent``
    periods and ``least`` words.
    """
    import numpy as np

    if exponent < 2:
        raise ValueError("a run has two periods at least")
    n, runs = len(w), []
    if n < max(least, exponent):
        return runs
    gap, back, names, part = _returns(w), w[::-1], w, 1
    mark = np.full(n, -1, np.int64)  # the last run found at each word
    size = 1
    while True:
        # the periods whose runs hold an aligned block of this size and its next occurrence, and none of twice the size
        low, high = max(1, -(-(2 * size - 1) // (exponent - 1))), (4 * size - 2) // (exponent - 1)
        if exponent * low > n:
            return sorted((s, e - s, q) for s, e, q in runs)
        whole = n // size
        blocks = np.flatnonzero((gap[: whole * size] <= high).reshape(whole, size).all(axis=1)) * size if high >= low else np.empty(0, int)
        if len(blocks):
            while part * KEY < size:
                names, part = _doubled(names, part), 2 * part
            p, o = _pairs(names, part, blocks, size, low, high)
            if runs and len(p):
                s, e, r = np.array(runs, np.int64)[mark[p]].T
                p, o = (x[~((mark[p] >= 0) & (s <= p) & (o + size <= e) & ((o - p) % r == 0))] for x in (p, o))
            order = np.lexsort((p, o - p))
            last, upto = 0, 0
            for i, j in zip(p[order].tolist(), o[order].tolist(), strict=True):
                q = j - i
                if q == last and i < upto:
                    continue  # inside the stretch that was extended before
                start = i - _alike(back, n - j, n - i)
                stop = i + size + _alike(w, i + size, j + size)
                last, upto = q, stop
                if stop + q - start >= max(least, exponent * q) and _primitive(w, start, q):
                    mark[start : stop + q] = len(runs)
                    runs.append((start, stop + q, q))
        size *= 2


def keep_mask(n: int, runs):
    """False for words that a run contains after its first period."""
    import numpy as np

    kept = np.ones(n, bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """A row for each document: its id, ``n_words``, ``runs`` and ``collapsed``.

    Words are stretches without ASCII white space.  ``runs`` is an array of (start, length, period) in words, by
    start, then period; ``collapsed`` is the words that no run contains after its first period, joined by a
    space.  ``rewrite(id, words)`` may give other words (as bytes) before the search.

    A null text is the empty text: no words, no runs, an empty string.  Rows are taken one by one,
    so repeated rows and ids give equal rows, a null id stays null, and an empty table gives an empty one.  Texts
    of any length are read whole.  Other columns, whatever their names, take no part.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            ends = pc.cumulative_sum(pc.binary_length(b.column(1)).cast(pa.int64())).to_pylist()
            lo = 0
            while lo < b.num_rows:
                hi, limit = lo + 1, (ends[lo - 1] if lo else 0) + SLICE
                while hi < b.num_rows and ends[hi] <= limit:
                    hi += 1
                part, counts, found, short = b.slice(lo, hi - lo), [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = text.split()  # of bytes: ASCII white space alone
                    if rewrite is not None:
                        words = rewrite(i, words)
                    runs = find_runs(_numbered(words), exponent, least)
                    if runs:
                        kept = keep_mask(len(words), runs)
                        short.append(b" ".join(x for x, k in zip(words, kept.tolist(), strict=True) if k))
                    else:
                        short.append(b" ".join(words))
                    counts.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(found, shape), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "n_words", "runs", "collapsed"])
                lo = hi

    kind = rows.schema["__id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"__id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return made.select(F.col("__id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeated_tail(doc_id, words: list) -> list:
    """The rewriting that query op11 states: a tenth of the documents repeat their words from some place on.

    A document without an id has no number to choose by, and keeps its words.
    """
    import zlib

    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op11, from the runs and the collapsed text."""
    found = periodic_runs(docs, rewrite=repeated_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    text = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    whole = found.withColumn("b", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))))
    return whole.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.length div -b.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
