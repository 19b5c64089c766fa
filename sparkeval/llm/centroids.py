"""Centroid clustering of vectors with annulus search, in exact integers.

Centroids are sorted by norm.  A vector's distance to the centroids whose norms stand next to its own
bounds its distance to the nearest one; by the triangle inequality the nearest one's norm differs
from the vector's by that bound at most.  Two binary searches cut this annulus out of the sorted
norms, and the centroids inside are compared exactly, in integers, those on the boundary included.
Norms are floating point, so the annulus is widened by more than their rounding.

Each round reads the vectors once.  A task keeps one sum for each centroid; Spark adds the tasks' sums,
and k x dims numbers, whatever the size of the table, come to the driver.  Nothing is kept between
rounds, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components beyond this could leave the range of a 64-bit distance.
LARGEST = 1 << 27
#: (vector, centroid) pairs compared at once: 32 MB of differences at 64 dimensions.
PAIRS = 1 << 16


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``__id, __x``: floor(scale * x) of the vectors of ``dims`` finite components."""
    v = F.col(vec_col)
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    small = lambda x: F.when(F.abs(x.cast("double")) * scale < LARGEST, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("__id"), F.transform(v, small).alias("__x"))


def _exact(x, c):
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x, c, pairs: int = PAIRS):
    """(centroid, squared distance, candidates compared) of every row of x; ties go to the smaller number."""
    import numpy as np

    norms = np.sqrt((c.astype(float) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, k = norms[order], len(c)
    size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    at = np.searchsorted(norms, size)
    bound = np.minimum(_exact(x, c[order[np.maximum(at - 1, 0)]]), _exact(x, c[order[np.minimum(at, k - 1)]]))
    reach = np.sqrt(bound.astype(float)) + 1e-9 * (size + norms[-1] + 1)
    lo = np.searchsorted(norms, size - reach, "left")
    count = np.searchsorted(norms, size + reach, "right") - lo
    upto = np.cumsum(count)
    label, best = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    i = 0
    while i < len(x):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + pairs, "right")))
        n = count[i:j]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(i, j), n)
        number = order[np.repeat(lo[i:j] - first, n) + np.arange(len(row))]
        d = _exact(x[row], c[number])
        best[i:j] = np.minimum.reduceat(d, first)
        label[i:j] = np.minimum.reduceat(np.where(d == np.repeat(best[i:j], n), number, k), first)
        i = j
    return label, best, int(upto[-1]) if len(x) else 0


def _matrix(column, dims):
    import numpy as np

    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(rows: DataFrame, c, dims: int) -> dict:
    """{centroid: [component sums, count, distances' upper bits, their lower 32]}, of Python integers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(c), dims + 3), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _matrix(b.column(0).slice(lo, 4096), dims)
                label, d, _ = nearest(x, c)
                by = np.argsort(label, kind="stable")
                found, first = np.unique(label[by], return_index=True)
                wide = np.hstack([x, np.ones((len(x), 1), np.int64), (d >> 32)[:, None], (d & 0xFFFFFFFF)[:, None]])
                total[found] += np.add.reduceat(wide[by], first, axis=0)
        used = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["c", "s"])

    part = rows.select("__x").mapInArrow(run, "c int, s array<long>").select("c", F.posexplode("s").alias("i", "v"))
    # k x (dims + 3) rows at most
    got = part.groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["c"], [0] * (dims + 3))[r["i"]] = int(r["v"])
    return out


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024):
    """The centroids as an integer matrix, after ``rounds`` rounds; None if no vector is kept.

    They start as the ``k`` vectors with the smallest SHA-256 of "seed:id" (ties by components; vectors
    without an id last), or as all vectors if those are fewer.  An empty centroid stays as it is.
    """
    import numpy as np

    rows = integers(vectors, id_col, vec_col, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "__x").limit(k).select("__x").collect()
    if not first:
        return None
    c = np.array([r["__x"] for r in first], np.int64)
    for _ in range(rounds):
        for label, s in _sums(rows, c, dims).items():
            c[label] = [v // s[dims] for v in s[:dims]]
    return c


def assign(spark: SparkSession, vectors: DataFrame, c, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """A row for each kept vector: its id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    rows = integers(vectors, id_col, vec_col, dims, scale)
    id_type = rows.schema["__id"].dataType.simpleString()
    shape = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if c is None:
        stats = []  # then no row reaches the assignment
    else:
        spread = {label: (s[dims + 1] << 32) + s[dims + 2] for label, s in _sums(rows, c, dims).items()}
        stats = [(i, spread.get(i, 0), sum(spread.values()), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in range(len(c))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                label, d, _ = nearest(_matrix(part.column(1), dims), c)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.int32()), pa.array(d, pa.int64())], names=["__id", "cluster", "distance"])

    near = rows.mapInArrow(run, f"__id {id_type}, cluster int, distance long")
    whole = near.join(F.broadcast(spark.createDataFrame(stats, shape)), "cluster")  # k rows
    return whole.select(F.col("__id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """``fit`` and ``assign``.

    A vector that is null, has another number of components, or a null, NaN or infinite one, is left out.
    Rows that repeat an id are vectors of their own.  Equal distances go to the smaller number.  A
    null id stays null.  An empty table, or one without a kept vector, gives an empty table.  Other columns,
    whatever their names, take no part.  A component of ``scale * x`` beyond 2^27 fails the query, as
    squared distances would no longer fit into a long.  ``vectors`` is read ``rounds + 3`` times, so give a table and not an
    expensive plan.
    """
    return assign(spark, vectors, fit(vectors, k, rounds, seed, id_col, vec_col, dims, scale), id_col, vec_col, dims, scale)


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The columns of query op12."""
    return cluster(spark, vectors)


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """DuckDB SQL with one step for each round: every vector against all centroids, in integers."""
    near = "(SELECT min({'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}) FROM %s c)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x, {near % f'c{i}'} AS m FROM v)")
        steps.append(f"u{i} AS (SELECT m.c AS c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i}, range(1, {dims + 1}) t(i) GROUP BY m.c, i)")
        steps.append(f"n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{i} GROUP BY c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN n{i} n ON o.c = n.c)")
    steps.append(f"z AS MATERIALIZED (SELECT vec_id, {near % f'c{rounds}'} AS m FROM v)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,"
        f" (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON c.c = m.c"
    )


ORACLE_SQL = _oracle()
