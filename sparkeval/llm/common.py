"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only where it is unset in local mode (tests) a
    local folder is used, and the setting is made; on a cluster that fails.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not sc.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkeval-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it lies in the shared folder and survives lost executors."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def let(expr: Column, body) -> Column:
    """Bind ``expr`` once: Catalyst would otherwise inline it into lambdas and redo it."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def held_out(doc_id: Column) -> Column:
    """The documented hold-out fold: crc32 of the id as text, modulo 4, equal to 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, max_chars: int):
    """At most ``max_rows`` labelled training rows of at most ``max_chars`` characters, as pandas.

    Both bounds are parameters of the operators that fit on this sample; the held-out fold
    never takes part.  Rows are chosen by a hash of the id, so that the choice is the same
    for any partitioning.
    """
    keyed = docs.select("doc_id", *columns) if labels is None else labels.select("doc_id", *columns)
    ids = (
        keyed.where(~held_out(F.col("doc_id")))
        .dropna(subset=["doc_id", *columns])
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), "doc_id", *columns)
        .limit(max_rows)
        .dropDuplicates(["doc_id"])
    )
    # only the chosen ids travel: max_rows of them at most, so they can be broadcast
    rows = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", *columns)).alias("r")).select("doc_id", "r.*")
    return one.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), "doc_id").toPandas()


def logistic_fit(x, y, l2: float = 1e-3, steps: int = 100):
    """Newton steps, halved until the loss falls, for a small logistic regression; the bias comes last."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = l2 * len(x) * np.ones(len(w))
    ridge[-1] = 1e-9

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return w


def logistic_score(x, w):
    """Scores between 0 and 1 of rows of features, by the weights of ``logistic_fit``."""
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
