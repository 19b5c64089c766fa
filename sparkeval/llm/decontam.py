"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

The test items are the indexed side: an inverted index with the BM25 weight of each (term,
item), divided by the item's score for itself, so that a score is the share of an item that
a passage covers.  Posting lists are cut into blocks with the largest weight of each
(block-max).  Every document is cut into overlapping passages of twice the longest item, so
that any run of words as long as an item lies within one passage.  A passage is a query of
its distinct terms:

* over each range of items, its upper bound is the sum of its terms' largest weights there;
  below the threshold no item of the range can match, and none of its postings is read;
* else block-max WAND in that range: cursors are kept in item order, the pivot is the first
  cursor at which the bounds reach the threshold, blocks whose maxima can't reach it are
  skipped whole, and only the items that may reach it are scored.

All items at or above the threshold are then verified by five-word shingles of the whole
item, of its question and of its answer (its last sentence).

The items are read in shards of about ``shard_items``.  More than one shard takes a pass over the
texts each, whose matches are written before the next one begins, so driver and tasks hold one
shard's index at a time.  Numbers of items, their mean and longest length and the frequencies of
terms are those of the whole benchmark, so the division changes no result.

Cases: null and empty texts match nothing; very long texts are read whole; an item without words is
left out, one without an id is reported without; items below five words are one shingle; equal items
are all reported, ties in the order of their ids; repeated rows give repeated rows; an empty
benchmark or an empty table gives no match; extra columns come through unchanged, but those of the
names ``out_col`` and ``__row``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (term, range) pairs of passages whose bounds are added at once.
PAIRS = 1 << 21
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = 5) -> set:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n)), strict=False))


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence is the answer, if there is more than one."""
    parts = [p for p in SENTENCE.split(text.strip()) if WORD.search(p)]
    return (words_of(" ".join(parts[:-1])), words_of(parts[-1])) if len(parts) > 1 else (words_of(text), [])


@dataclass
class Rule:
    threshold: float = 0.5  # share of an item's own BM25 score
    overlap: float = 0.8  # share of its shingles
    block: int = 4  # postings that share a maximum
    span: int = 8  # items of a range at least; there are 256 ranges at most
    k1: float = 1.2
    b: float = 0.75
    shard_items: int = 20_000


class BlockMaxIndex:
    """Posting lists by term: item numbers, weights, and the largest weight of each block."""

    def __init__(self, ids: list, texts: list[str], rule: Rule, whole: tuple | None = None):
        """``whole``: number, mean and longest length and term frequencies of all items, if these are a part."""
        kept = [(i, t, w) for i, t in zip(ids, texts, strict=True) if (w := words_of(t))]
        self.rule, self.ids = rule, [i for i, _, _ in kept]
        self.items = []
        self.longest = max((len(w) for _, _, w in kept), default=1)
        n = len(kept)
        mean = sum(len(w) for _, _, w in kept) / max(1, n)
        counts: list[dict[str, int]] = []
        spread: dict[str, int] = {}
        for _, t, w in kept:
            c: dict[str, int] = {}
            for x in w:
                c[x] = c.get(x, 0) + 1
            counts.append(c)
            for x in c:
                spread[x] = spread.get(x, 0) + 1
            q, a = halves(t)
            self.items.append((shingles(w), shingles(q), shingles(a)))
        total, mean, self.longest, often = whole or (n, mean, self.longest, spread)
        self.terms = {t: k for k, t in enumerate(spread)}
        lists: list[list[tuple[int, float]]] = [[] for _ in spread]
        for i, c in enumerate(counts):
            size = sum(c.values())
            part = {}
            for t, f in c.items():
                idf = np.log(1 + (total - often[t] + 0.5) / (often[t] + 0.5))
                part[t] = idf * f * (rule.k1 + 1) / (f + rule.k1 * (1 - rule.b + rule.b * size / mean))
            own = sum(part.values())
            for t, v in part.items():
                lists[self.terms[t]].append((i, v / own))
        self.posts = [[i for i, _ in p] for p in lists]
        self.weights = [[v for _, v in p] for p in lists]
        self.block_max = [[max(v[k : k + rule.block]) for k in range(0, len(v), rule.block)] for v in self.weights]
        self.block_end = [[p[min(k + rule.block, len(p)) - 1] for k in range(0, len(p), rule.block)] for p in self.posts]
        self.bound = [max(v) for v in self.weights]
        self.term_bound = np.array(self.bound)
        # the largest weight of each term in each range of items: (range, weight) by term
        self.span = max(rule.span, -(-n // 256))
        self.ranges = max(1, -(-n // self.span))
        pairs = []
        for p, v in zip(self.posts, self.weights, strict=True):
            top: dict[int, float] = {}
            for i, x in zip(p, v, strict=True):
                top[i // self.span] = max(x, top.get(i // self.span, 0.0))
            pairs.append(sorted(top.items()))
        self.range_count = np.array([len(p) for p in pairs], np.int64)
        self.range_start = np.concatenate([[0], np.cumsum(self.range_count)[:-1]]).astype(np.int64) if pairs else np.zeros(0, np.int64)
        self.range_no = np.array([r for p in pairs for r, _ in p], np.int64)
        self.range_max = np.array([x for p in pairs for _, x in p])

    def search(self, terms: list[int], theta: float, low: int = 0, high: int = 1 << 60) -> list[tuple[int, float]]:
        """(item, score) of the items from low to high that reach theta for a query of distinct terms."""
        block, out = self.rule.block, []
        bound = self.bound
        cursors = []  # item, term, position
        for t in terms:
            at = bisect_left(self.posts[t], low)
            if at < len(self.posts[t]) and self.posts[t][at] < high:
                cursors.append([self.posts[t][at], t, at])
        cursors.sort()
        slack = theta - 1e-9
        while cursors:
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += bound[c[1]]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that could hold the pivot item
            local, upto = 0.0, 1 << 60
            for c in cursors[: pivot + 1]:
                ends, at = self.block_end[c[1]], c[2] // block
                while at < len(ends) and ends[at] < item:
                    at += 1
                if at < len(ends):
                    local += self.block_max[c[1]][at]
                    upto = min(upto, ends[at])
            if local < slack:  # no item up to the nearest block end can reach theta
                target = upto + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.weights[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            moved = []
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    posts, ends, at = self.posts[c[1]], self.block_end[c[1]], c[2] // block
                    while at < len(ends) and ends[at] < target:
                        at += 1
                    if at == len(ends):
                        continue
                    p = max(c[2], at * block)
                    while posts[p] < target:
                        p += 1
                    c[0], c[2] = posts[p], p
                    if c[0] >= high:
                        continue
                moved.append(c)
            cursors = sorted(moved + cursors[pivot + 1 :])
        return out

    def scan(self, texts: list[str | None], chunk: int = 100_000) -> list[list[tuple]]:
        """For each text the (item id, score, overlap, question overlap, answer overlap) of the items it leaks."""
        out: list[list[tuple]] = []
        held: list[list[str]] = []
        total = 0
        for t in texts:
            words = words_of(t) if self.ids else []
            if held and total + len(words) > chunk:
                out += self._scan(held)
                held, total = [], 0
            held.append(words)
            total += len(words)
        return out + self._scan(held)

    def _hits(self, passage, term, theta: float):
        """The (passage, range) pairs, as one number each, whose bound reaches theta; at most ``PAIRS`` (term, range) pairs are held at once."""
        # a passage whose terms can't reach theta anywhere has no range that does
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
        if not len(first):
            return
        most = np.add.reduceat(self.term_bound[term], first)
        alive = np.repeat(most >= theta - 1e-9, np.diff(np.r_[first, len(passage)]))
        passage, term = passage[alive], term[alive]
        n = self.range_count[term]
        upto = np.cumsum(n)
        i = 0
        while i < len(passage):
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right"))
            j = max(int(np.searchsorted(passage, passage[min(j, len(passage) - 1)])), int(np.searchsorted(passage, passage[i], "right"))) if j < len(passage) else j  # whole passages
            m = n[i:j]
            at = np.repeat(self.range_start[term[i:j]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            low, high = int(passage[i]), int(passage[j - 1]) + 1
            cell, weight = np.repeat(passage[i:j] - low, m) * self.ranges + self.range_no[at], self.range_max[at]
            if (high - low) * self.ranges <= 4 * len(cell):
                found = np.flatnonzero(np.bincount(cell, weight) >= theta - 1e-9)
            else:  # few of the cells have a term
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                found = cell[start][np.add.reduceat(weight[order], start) >= theta - 1e-9]
            yield found + low * self.ranges
            i = j

    def _scan(self, docs: list[list[str]]) -> list[list[tuple]]:
        sizes = np.array([len(d) for d in docs], np.int64)
        best: list[dict[int, tuple]] = [{} for _ in docs]
        if not sizes.sum():
            return [[] for _ in docs]
        none, theta, step = len(self.terms), self.rule.threshold, self.longest
        get = self.terms.get
        terms = np.fromiter((get(w, none) for w in chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        # passage k of a document covers the words from k * step to (k + 2) * step
        passages = np.where(sizes > 0, -(-np.maximum(1, sizes - step) // step), 0)
        first = np.cumsum(passages) - passages
        doc = np.repeat(np.arange(len(docs)), sizes)
        k = (np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // step
        known = terms != none
        here, before = known & (k < passages[doc]), known & (k > 0)
        key = np.unique(np.concatenate([(first[doc] + k)[here] * none + terms[here], (first[doc] + k - 1)[before] * none + terms[before]]))
        passage, term = key // none, key % none
        hits = np.concatenate([np.zeros(0, np.int64), *self._hits(passage, term, theta)])
        owner = np.repeat(np.arange(len(docs)), passages)
        edges = np.searchsorted(passage, np.arange(int(passages.sum()) + 1))
        have: dict[int, set] = {}
        for p, r in zip((hits // self.ranges).tolist(), (hits % self.ranges).tolist(), strict=True):
            for item, score in self.search(term[edges[p] : edges[p + 1]].tolist(), theta, r * self.span, (r + 1) * self.span):
                d = int(owner[p])
                a = (p - int(first[d])) * step
                words = docs[d][a : a + 2 * step]
                if p not in have:
                    have = {p: shingles(words)}
                o, q, reply = (_share(s, have[p], words) for s in self.items[item])
                over = self.rule.overlap
                if (o >= over or (q >= over and reply >= over)) and (item not in best[d] or best[d][item][1:3] < (score, o)):
                    best[d][item] = (self.ids[item], float(score), o, q, reply)
        return [sorted(b.values(), key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) for b in best]


def _share(wanted: set, have: set, words: list[str]) -> float:
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    if n < 5:  # a short item or answer is one shingle of its own length
        have = shingles(words, n) if len(words) >= n else set()
    return len(wanted & have) / len(wanted)


LEAK = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), *((k, pa.float64()) for k in ("score", "overlap", "question_overlap", "answer_overlap"))]))
NAMES = [LEAK_TYPE.value_type.field(k).name for k in range(LEAK_TYPE.value_type.num_fields)]


def _whole(items: DataFrame):
    """A function of a shard to ``BlockMaxIndex``'s ``whole``: sums over all items, frequencies of the shard's terms."""

    def run(batches):
        for b in batches:
            shard, term, size = [], [], []
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                distinct = sorted(set(words))
                shard += [s] * len(distinct)
                term += distinct
                size += [len(words), *[0] * (len(distinct) - 1)] if words else []  # once for each item
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(term, pa.string()), pa.array(size, pa.int64())], names=["shard", "term", "size"])

    terms = cut(items.sparkSession, items.select("shard", "text").mapInArrow(run, "shard int, term string, size long"))
    n, words, longest = terms.agg(F.count_if(F.col("size") > 0), F.sum("size"), F.max("size")).first()
    often = cut(items.sparkSession, terms.groupBy("term").agg(F.count("*").alias("n")))

    def of(shard: int) -> tuple:
        own = often.join(terms.where(F.col("shard") == shard).select("term").distinct(), "term", "left_semi")
        return n, (words or 0) / max(1, n), longest or 1, dict(own.toPandas().itertuples(index=False, name=None))

    return of


def with_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """``docs`` with ``out_col``: the leaked items of each row."""
    docs = docs.drop(out_col)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    shards = max(1, -(-items.count() // rule.shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))

    def index_of(shard: int, whole: tuple | None) -> BlockMaxIndex:
        rows = items.where(F.col("shard") == shard).orderBy("item_id", "text").collect()  # about shard_items
        return BlockMaxIndex([r["item_id"] for r in rows], [r["text"] for r in rows], rule, whole)

    def scanned(rows: DataFrame, index: BlockMaxIndex) -> DataFrame:
        def run(batches):
            for b in batches:
                found = [[dict(zip(NAMES, x, strict=True)) for x in xs] for xs in index.scan(b.column(text_col).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, LEAK_TYPE)], names=[*b.schema.names, out_col])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{kinds}, `{out_col}` {LEAK}")

    if shards == 1:
        return scanned(docs, index_of(0, None))
    spark, whole = docs.sparkSession, _whole(items)
    rows = cut(spark, docs.withColumn("__row", F.monotonically_increasing_id()))
    texts, found = rows.select("__row", text_col), None
    for k in range(shards):
        part = cut(spark, scanned(texts, index_of(k, whole(k))).where(F.size(out_col) > 0).select("__row", out_col))
        found = part if found is None else found.unionAll(part)
    each = found.groupBy("__row").agg(F.sort_array(F.flatten(F.collect_list(out_col))).alias(out_col))  # a row's leaks, of at most ``shards`` rows
    return rows.join(each, "__row", "left").withColumn(out_col, F.coalesce(out_col, F.array().cast(LEAK))).drop("__row")


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A row for each document and leaked item."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, rule)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    return with_leaks(docs, benchmark, rule, out_col="__leaks").where(F.size("__leaks") == 0).drop("__leaks")
