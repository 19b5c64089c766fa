"""SimHash near-duplicates: fingerprints, vantage-point trees, components.

1. A fingerprint per document (Arrow batches): bytes are lower-cased and split on ASCII
   white space, every shingle is hashed by XXH64, and bit ``j`` of the fingerprint is set if
   more than half of the hashes have it.
2. Equal fingerprints are merged first (a distributed minimum of the ids), so that copies
   never become pairs.
3. Shards.  Two fingerprints within ``radius`` bits differ in ``radius`` blocks of bits at most,
   so of any division into more blocks they agree on the rest: their Hamming distance there
   is 0.  A shard is one value of some bits of such a rest, as many bits as leave about
   ``shard_points`` fingerprints in it; more blocks are taken as the table grows.  (By vantage
   points alone, one level keeps 57 % of the pairs of unrelated fingerprints, whose distances
   are 32 +- 4, and sends a fingerprint to 1.4 shards: 25 copies of each after ten levels.)
4. A shard of more than ``block`` fingerprints (a hot group of near copies, say) is
   partitioned by the Hamming distance to a vantage point of its own: rings of distances hold
   about ``block`` each, every fingerprint is at home in one ring, and it also visits the
   rings that its ball of ``radius`` bits overlaps further out.  By the triangle bound no pair is lost.
5. A vantage-point tree searches every shard: the points are halved by their Hamming distance
   to a vantage point, each half is searched by itself, and only the points whose distance
   lies within ``radius`` of the boundary are compared across it, by trees again.
6. Within a task, found pairs are merged at once (union-find), and only the edges of a
   spanning forest leave it.  The components of all edges are then found by Spark joins.

Cases: null, empty and blank texts have fingerprint 0 and link to each other; texts below
``width`` words give one shingle of all words; very long texts are hashed whole, in chunks;
repeated rows and ids keep their rows, and the fingerprints of one id are linked; a row
without an id links others, and its component is theirs (null if no row of it has an id);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components

SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words of ``text``."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    blob = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([h(blob[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprints_of(texts, width: int = 4, chunk: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each text; long texts are counted in chunks of shingles."""
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text, width)
        if not len(h):
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), chunk):
            part = h[at : at + chunk].astype("<u8", copy=False)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = (powers[ones * 2 > len(h)]).sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the 64-bit fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), width)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


# --- vantage-point trees -------------------------------------------------------------------

LEAF = 64
QUANTILES = np.arange(1, 8) / 8  # two sets are compared by rings of distances: halves would keep 86 % of the pairs


def _near(x: np.ndarray, y: np.ndarray, radius: int):
    """Index pairs of x and y within radius, by blocks of bounded size."""
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius)
        yield i + at, j


def _merge(parent: dict, a: np.ndarray, b: np.ndarray) -> list:
    """Union-find over the ids; returns the pairs that joined two groups."""
    new = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        x, y = u, v
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        while (p := parent.setdefault(y, y)) != y:
            parent[y] = y = parent.setdefault(p, p)
        if x != y:
            parent[max(x, y)] = min(x, y)
            new.append((u, v))
    return new


def tree_pairs(x: np.ndarray, ix: np.ndarray, radius: int, found, y: np.ndarray | None = None, iy: np.ndarray | None = None, seen: dict | None = None) -> None:
    """All pairs within ``radius`` of one point set, or of two; ``found(ids, ids)`` gets them.

    ``seen`` counts the splits and the distances that were computed.
    """
    stack = [(x, ix, y, iy)]
    seen = {} if seen is None else seen
    while stack:
        x, ix, y, iy = stack.pop()
        if not len(x) or (y is not None and not len(y)):
            continue
        if len(x) > LEAF if y is None else len(x) * len(y) > 4 * LEAF * LEAF:
            vantage = x[len(x) // 2]
            dx = np.bitwise_count(x ^ vantage).astype(np.int16)
            parts = []
            if y is None:
                cut_at = int(np.median(dx))
                inner = dx <= cut_at
                if inner.all():  # half of the points at the largest distance: cut below it
                    cut_at -= 1
                    inner = dx <= cut_at
                # only points near the boundary can have partners beyond it
                p, q = inner & (dx > cut_at - radius), ~inner & (dx <= cut_at + radius)
                parts = [(x[inner], ix[inner], None, None), (x[~inner], ix[~inner], None, None), (x[p], ix[p], x[q], ix[q])]
                useful = inner.any()
            else:
                dy = np.bitwise_count(y ^ vantage).astype(np.int16)
                edges = [-1, *np.unique(np.quantile(dx, QUANTILES, method="lower")).tolist(), 64]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    p, q = (dx > lo) & (dx <= hi), (dy > lo - radius) & (dy <= hi + radius)
                    parts.append((x[p], ix[p], y[q], iy[q]))
                useful = sum(len(a) * len(c) for a, _, c, _ in parts) <= 0.8 * len(x) * len(y)
            seen["distances"] = seen.get("distances", 0) + len(x) + (0 if y is None else len(y))
            if useful:
                seen["splits"] = seen.get("splits", 0) + 1
                stack += parts
                continue
        seen["distances"] = seen.get("distances", 0) + len(x) * len(x if y is None else y)
        for i, j in _near(x, x if y is None else y, radius):
            if y is None:
                i, j = i[i < j], j[i < j]
            found(ix[i], (ix if y is None else iy)[j])


def shard_masks(points: int, radius: int, shard_points: int) -> list[int]:
    """Masks of bits such that two fingerprints within ``radius`` bits agree under one of them at least.

    Each has the bits that divide ``points`` into shards of about ``shard_points``.
    """
    bits = math.ceil(math.log2(max(1, points / shard_points)))
    if not bits:
        return [0]
    # of n blocks, radius differ at most; the other n - radius have this many bits at least
    n = next((n for n in range(radius + 1, 64) if 64 // n * (n - radius) >= bits), 64)
    edges = [64 * k // n for k in range(n + 1)]
    masks = []
    for rest in combinations(range(n), n - radius):
        free = [j for k in rest for j in range(edges[k], edges[k + 1])][:bits]
        masks.append(sum(1 << j for j in free))
    return sorted({m - (1 << 64) if m >> 63 else m for m in masks})


def _deal(banded: DataFrame, key: str, block: int, *others: str) -> DataFrame:
    """``banded(key, rep, shard)`` and ``others`` with the cell (shard, i, j) of each row; hot shards are pairs of blocks.

    A block meets every block, itself included, once: its rows go to the cells (i, j) with i <= j.
    """
    hot = banded.groupBy("shard").count().where(F.col("count") > block).select("shard", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    return (
        banded.join(hot, "shard", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(key, "rep", "shard", *others, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )


def _cells(batches, names, columns, cell):
    """Runs ``cell`` on each run of rows of one (shard, i, j) and yields its pairs; a run may go on in the next batch.

    ``columns`` turns a batch into arrays by name.
    """

    def out(pairs):
        u, v = (np.array(pairs, np.int64).reshape(-1, 2)).T
        return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    rest = None
    for b in batches:
        t = columns(b)
        if rest is not None:
            t = {n: np.concatenate([rest[n], t[n]]) for n in names}
        if not len(t["rep"]):
            continue
        change = np.flatnonzero((np.diff(t["shard"]) != 0) | (np.diff(t["i"]) != 0) | (np.diff(t["j"]) != 0)) + 1
        edges = [0, *change.tolist()]
        pairs = []
        for a, c in zip(edges, edges[1:], strict=False):
            if c - a > 1:
                pairs += cell({n: x[a:c] for n, x in t.items()})
        rest = {n: x[edges[-1] :] for n, x in t.items()}
        yield out(pairs)
    if rest is not None and len(rest["rep"]) > 1:
        yield out(cell(rest))


def _rings(rows: DataFrame, hot: DataFrame, radius: int, block: int) -> DataFrame:
    """``rows(fp, rep, shard)`` of the ``hot(shard, vantage)`` shards, by rings of distances to their vantage points.

    ``home`` marks each row's own ring; the other rows are visits to rings further out that
    its ball overlaps, so every pair within ``radius`` meets once.
    """
    far = rows.join(hot, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
    upto = Window.partitionBy("shard").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65 rows for each shard
    ring = far.groupBy("shard", "d").count().select("shard", "d", F.floor(F.coalesce(F.sum("count").over(upto), F.lit(0)) / block).alias("ring"))
    visits = ring.select("shard", "d", F.col("ring").alias("own_ring"), F.explode(F.sequence(F.col("d") + 1, F.col("d") + radius)).alias("near"))
    visits = visits.join(ring.select("shard", F.col("d").alias("near"), "ring"), ["shard", "near"]).where("ring > own_ring").select("shard", "d", "ring").distinct()
    rooms = ring.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False)))
    placed = far.join(rooms, ["shard", "d"])
    return placed.select("fp", "rep", F.xxhash64("shard", "ring").alias("shard"), "home")


def links(spark: SparkSession, points: DataFrame, radius: int = 4, block: int = 20_000, shard_points: int = 4_096) -> DataFrame:
    """``u, v``: a spanning forest of the pairs of ``points(fp, rep)`` within ``radius`` bits.

    ``points`` has one row for each distinct fingerprint; it is counted first.
    """
    masks = shard_masks(points.count(), radius, shard_points)
    values = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]
    rows = points.select("fp", "rep", F.explode(F.array(*values)).alias("shard"))
    vantage = F.min(F.struct(F.xxhash64("fp").alias("h"), "fp"))["fp"]
    hot = rows.groupBy("shard").agg(F.count("*").alias("n"), vantage.alias("vantage")).where(F.col("n") > block).select("shard", "vantage")
    hot = cut(spark, hot)
    plain = rows.join(hot, "shard", "left_anti").withColumns({"home": F.lit(True), "own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    names = ("fp", "rep", "shard", "home", "own", "i", "j")
    dealt = _deal(_rings(rows, hot, radius, block), "fp", 2 * block, "home")
    placed = plain.select(*names).unionAll(dealt.select(*names)).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def search(batches):
        parent: dict = {}

        def cell(t) -> list:
            fp = np.ascontiguousarray(t["fp"]).view(np.uint64)
            rep, home, own, i, j = t["rep"], t["home"], t["own"], t["i"][0], t["j"][0]
            new = []
            take = lambda a, b: new.extend(_merge(parent, a, b))
            sides = [(own == i) & home, (own == i) & ~home, (own == j) & home, (own == j) & ~home]
            a, a_guest, b, b_guest = [(fp[s], rep[s]) for s in sides]
            if i == j:
                tree_pairs(*a, radius, take)
                tree_pairs(*a_guest, radius, take, *a)
            else:
                for p, q in ((a, b), (a_guest, b), (a, b_guest)):
                    tree_pairs(*p, radius, take, *q)
            return new

        yield from _cells(batches, names, lambda b: {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}, cell)

    return placed.mapInArrow(search, "u long, v long")


def _of_one_id(rows: DataFrame, node: str) -> DataFrame:
    """``u, v``: edges between the different nodes of each id."""
    twice = rows.where("id is not null").groupBy("id").agg(F.min(node).alias("u"), F.max(node).alias("top")).where("u < top").select("id", "u")
    return rows.join(twice, "id").where(F.col(node) != F.col("u")).select("u", F.col(node).alias("v"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 4, radius: int = 4, block: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component_id`` for every row: the smallest id reachable over links of at most ``radius`` bits.

    Rows of one id are one document, so all their fingerprints are linked.
    """
    prints = cut(spark, fingerprints(docs, width, id_col, text_col))
    points = cut(spark, prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = links(spark, points.select("fp", F.col("fp").alias("rep")), radius, block)
    roots = components(spark, found.unionAll(_of_one_id(prints, "fp")))
    group = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = group.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(group.join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


# --- near copies by similarity -------------------------------------------------------------


def _least(n):
    """How many of n shingles a set alike to 0.8 shares at least."""
    return -(-4 * n // 5)


def _gram_sets(batches, width: int):
    """For each row of (id, text): id, sorted distinct shingle hashes, and the 63-bit name of that set."""
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = np.unique(shingle_hashes(text, width))
            yield k, h, xxhash.xxh3_64_intdigest(h.tobytes()) >> 1


#: Shingles are counted by the last bits of their hashes: an array of 4 MB in every task, moved in slices.
COUNT_BITS, SLICES = 20, 64


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How many of all rows hold a shingle of each bucket of hashes; this only sets an order of the shingles.

    Each task counts its rows in one array, and the arrays of all tasks are added up slice by slice.
    """
    size = (1 << COUNT_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                h = [h for _, h, _ in _gram_sets([b.slice(lo, 256)], width)]
                at, n = np.unique(np.concatenate(h) & np.uint64((1 << COUNT_BITS) - 1), return_counts=True)
                total[at.astype(np.int64)] += n
        parts = [total[k * size : (k + 1) * size].astype("<u4").tobytes() for k in range(SLICES)] if total.any() else []
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["k", "counts"])

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        parts = [x.clip(0, (1 << 31) - 1).astype("<u4").tobytes() for x in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], ["k", "counts"])

    out = np.zeros(1 << COUNT_BITS, np.int32)
    for r in docs.mapInArrow(count, "k int, counts binary").repartition("k").mapInArrow(add, "k int, counts binary").collect():
        out[r["k"] * size : (r["k"] + 1) * size] = np.frombuffer(r["counts"], "<u4")
    return out


def _counted_pairs(batches, flush: int = 1 << 21):
    """``u, v, nu, nv, c``: how many shards the nodes u < v share whose sizes allow 0.8; rows are sorted by shard."""
    names, rest = ("node", "n", "shard"), None
    held, total = [], 0

    def out():
        u, v, nu, nv = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.lexsort((v, u))
        u, v, nu, nv = u[o], v[o], nu[o], nv[o]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(u) != 0) | (np.diff(v) != 0)]))
        c = np.diff(np.append(at, len(u)))
        return pa.record_batch([pa.array(x) for x in (u[at], v[at], nu[at], nv[at], c)], ["u", "v", "nu", "nv", "c"])

    def feed(t):
        nonlocal total
        o = np.lexsort((t["n"], t["shard"]))
        shard, node, n = t["shard"][o], t["node"][o], t["n"][o]
        at, lag = np.arange(len(shard)), 1
        while len(at):
            at = at[at + lag < len(shard)]
            at = at[(shard[at + lag] == shard[at]) & (n[at] >= _least(n[at + lag]))]
            if len(at):
                low = node[at] < node[at + lag]
                a, b = np.where(low, at, at + lag), np.where(low, at + lag, at)
                held.append((node[a], node[b], n[a], n[b]))
                total += len(at)
            lag += 1
            if total > flush:
                yield out()
                held.clear()
                total = 0

    for b in batches:
        t = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
        if rest is not None:
            t = {n: np.concatenate([rest[n], t[n]]) for n in names}
        if not len(t["node"]):
            continue
        last = np.flatnonzero(t["shard"] != t["shard"][-1])
        edge = last[-1] + 1 if len(last) else 0
        rest = {n: x[edge:] for n, x in t.items()}
        if edge:
            yield from feed({n: x[:edge] for n, x in t.items()})
    if rest is not None:
        yield from feed(rest)
    if held:
        yield out()


def _forest(batches):
    """A spanning forest of the edges (u, v) of a partition."""
    parent: dict = {}
    for b in batches:
        new = _merge(parent, b.column(0).to_numpy(), b.column(1).to_numpy())
        u, v = np.array(new, np.int64).reshape(-1, 2).T
        yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])


def _alike(node: np.ndarray, grams, pivots: int = 8):
    """Pairs of nodes of a cell whose exact Jaccard is 0.8 or more, enough of them to connect all that are linked.

    Pivots are counted against all sets first.  What they join in the largest group needs no
    pairs of its own; then every set is counted against the sets outside that group.
    """
    _, at = np.unique(node, return_index=True)
    node, sets = node[at], [np.frombuffer(grams[k], np.uint64) for k in at]
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    if not ends[-1]:
        return
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    terms = int(term.max()) + 1
    parent, joined = {}, np.zeros(len(sets), bool)
    for _ in range(pivots if len(sets) > 64 else 0):
        left = np.flatnonzero(~joined)
        if not len(left):
            break
        p = int(left[len(left) // 2])
        mark = np.zeros(terms + 1, np.int64)
        mark[term[ends[p] - size[p] : ends[p]]] = 1
        shared = np.concatenate([[0], np.cumsum(mark[term])])
        shared = shared[ends] - shared[ends - size]
        near = np.flatnonzero(9 * shared >= 4 * (size[p] + size))
        joined[near] = joined[p] = True
        _merge(parent, np.full(len(near), p), near)
        near = near[near != p]
        yield np.full(len(near), node[p]), node[near]
    root = np.arange(len(sets))
    for k in parent:
        r = k
        while parent[r] != r:
            r = parent[r]
        root[k] = r
    outside = root != np.argmax(np.bincount(root)) if parent else np.ones(len(sets), bool)
    owner = np.repeat(np.arange(len(sets)), size)
    posts = outside[owner]
    order = np.argsort(term[posts], kind="stable")
    owner = owner[posts][order]
    count = np.bincount(term[posts], minlength=terms)
    first = np.cumsum(count) - count
    for k in range(len(sets)):
        t = term[ends[k] - size[k] : ends[k]]
        t = t[count[t] > (1 if outside[k] else 0)]
        m = count[t]
        if not len(t):
            continue
        where = np.repeat(first[t] - np.cumsum(m) + m, m) + np.arange(m.sum())
        both = np.bincount(owner[where], minlength=len(sets))
        near = np.flatnonzero(9 * both >= 4 * (size[k] + size))
        near = near[near > k] if outside[k] else near
        if len(near):
            yield np.full(len(near), node[k]), node[near]


def near_copies(
    spark: SparkSession, docs: DataFrame, width: int = 5, block: int = 20_000, few: int = 64, most_nodes: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, component_id``: links are exactly the pairs whose ``width``-word shingle sets have a Jaccard of 0.8 or more.

    Rows with the same set of shingles are one node.  Candidates come from prefixes: in any
    order of all shingles, two sets alike to 0.8 share one of the first ``n - ceil(0.8 n) + 1``
    of each.  The order puts frequent shingles last, by counts over all rows, which changes the
    work only.  A prefix shingle of up to ``few`` nodes gives their pairs, and pairs are counted:
    with ``c`` shared in the two prefixes, the sets share at most ``c`` and what lies behind the
    one prefix or the other; pairs that can't reach 0.8 so are dropped, none else.  A prefix
    shingle of more nodes gives no pairs: each node is tied to one of about its size, and these
    in a row, which connects all it could link.  Links of the 64-bit SimHash tree search are
    further candidates.  Then each set travels once to its component of candidates (hot ones as
    block pairs), where the links are counted out exactly; a spanning forest of them leaves the task.

    Cases: null, empty and blank texts are one node without shingles; texts below ``width`` words
    have one shingle of all words; very long texts are hashed whole; repeated rows are one node, and so are rows
    of one id; rows without an id are in no group (their component is null); an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_by = _frequencies(rows, width)

    def index(batches):
        for b in batches:
            out, prints = [], fingerprints_of(b.column(1).to_pylist(), width).view(np.int64).tolist()
            for (k, h, node), fp in zip(_gram_sets([b], width), prints, strict=True):
                order = held_by[(h & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)]
                first = h[np.lexsort((h, order))][: len(h) - _least(len(h)) + 1 if len(h) else 0]
                # 32 bits name a prefix shingle: two of one name only add candidates
                out.append((k, node, fp, len(h), first.astype(np.uint32).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "node", "fp", "n", "first"])

    def postings(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                shard = [np.frombuffer(x, np.int32) for x in part.column(2).to_pylist()]
                k = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in shard]))
                yield pa.record_batch([part.column(0).take(k), part.column(1).take(k), pa.array(np.concatenate(shard))], ["node", "n", "shard"])

    def sets(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out = [(node, h.tobytes()) for _, h, node in _gram_sets([b.slice(lo, 256)], width)]
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["node", "rep"])

    def verify(batches):
        parent: dict = {}

        def cell(t) -> list:
            new = []
            for u, v in _alike(t["node"], t["rep"]):
                new += _merge(parent, u, v)
            return new

        names = ("node", "rep", "shard", "own", "i", "j")
        yield from _cells(batches, names, lambda b: {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}, cell)

    made = cut(spark, rows.mapInArrow(index, "id long, node long, fp long, n long, first binary"))
    kept = made.where("id is not null")
    nodes = cut(spark, kept.groupBy("node").agg(F.min(F.struct("id", "fp", "n", "first")).alias("r")).select("node", "r.*"))
    posts = nodes.select("node", "n", "first").mapInArrow(postings, "node long, n long, shard int")
    shared = posts.groupBy("shard").agg(F.count("*").alias("held")).where("held > 1")
    shared = cut(spark, posts.join(shared, "shard").select("node", "n", "shard", "held"))
    small = shared.where(F.col("held") <= min(few, block)).select("node", "n", "shard")
    counted = small.repartition("shard").sortWithinPartitions("shard").mapInArrow(_counted_pairs, "u long, v long, nu long, nv long, c long")
    counted = counted.groupBy("u", "v", "nu", "nv").agg(F.sum("c").alias("c"))
    behind = "greatest((4 * nu + 4) div 5, (4 * nv + 4) div 5) - 1"
    pairs = counted.where(f"9 * (c + {behind}) >= 4 * (nu + nv)").select("u", "v").mapInArrow(_forest, "u long, v long")
    # sizes of sets alike to 0.8 differ by 1.25 at most, and so by one step at most here
    large = shared.where(F.col("held") > min(few, block)).withColumn("step", F.floor(F.log("n") / math.log(1.26)))
    ties = large.groupBy("shard", "step").agg(F.min("node").alias("u"))
    row = ties.join(ties.select("shard", (F.col("step") - 1).alias("step"), F.col("u").alias("v")), ["shard", "step"]).select("u", "v")
    tied = large.join(ties, ["shard", "step"]).select("u", F.col("node").alias("v")).unionAll(row).where("u <> v").distinct()
    points = cut(spark, nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    maybe = components(spark, pairs.unionAll(tied).unionAll(links(spark, points, block=block)))
    wanted = cut(spark, nodes.select("node", "id").join(maybe.select("node", F.col("root").alias("shard")), "node"))
    cells = cut(spark, _deal(wanted.select("node", F.lit(None).alias("rep"), "shard"), "node", max(2, block // 10)).drop("rep"))
    side = F.broadcast if cells.count() <= most_nodes else lambda x: x
    found = rows.join(side(wanted.select("id").distinct()), "id").mapInArrow(sets, "node long, rep binary")
    placed = found.join(side(cells), "node").select("node", "rep", "shard", "own", "i", "j")
    linked = placed.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(verify, "u long, v long")
    # rows of one id are one document, whatever their texts
    roots = components(spark, linked.unionAll(_of_one_id(kept, "node")))
    group = made.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = nodes.select("node", "id").join(group, "node").groupBy("root").agg(F.min("id").alias("component_id"))
    return made.select("id", "node").join(group.join(named, "root", "left").select("node", "component_id"), "node", "left").select("id", "component_id")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op8."""
    return near_duplicates(spark, docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
