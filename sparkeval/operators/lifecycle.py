"""The lifecycle of runs: legal changes of state, and chains of audit events."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states that may follow each state of a run.
RUN_TRANSITIONS = {
    "draft": ("validating",),
    "validating": ("draft", "queued"),
    "queued": ("running", "cancelling", "failed"),
    "running": ("pausing", "cancelling", "completed", "completed_with_errors", "failed"),
    "pausing": ("paused", "cancelling"),
    "paused": ("queued", "cancelling"),
    "cancelling": ("cancelled",),
    "cancelled": (),
    "completed": (),
    "completed_with_errors": (),
    "failed": (),
}


def illegal_transitions(rows: DataFrame, run: str, order: list[str], state: str) -> DataFrame:
    """``run, before, state`` of every change that the lifecycle doesn't allow; unknown states allow none."""
    changed = rows.select(run, F.col(state).alias("state"), F.lag(state).over(Window.partitionBy(run).orderBy(*order)).alias("before")).where("before is not null")
    legal = F.lit(False)
    for before, after in RUN_TRANSITIONS.items():
        if after:
            legal = legal | ((F.col("before") == before) & F.col("state").isin(*after))
    return changed.where(~F.coalesce(legal, F.lit(False))).select(run, "before", "state")


def hash_chain(rows: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """``rows`` with ``chain``: SHA-256 of the link before and the row's ``digest`` (both hex), 64 zeros before the first.

    A chain is one after the other by nature, so a key's rows pass through one task in
    order; only the last link is held.
    """
    schema = rows.withColumn("chain", F.lit("")).schema
    at, step = rows.columns.index(key), rows.columns.index(digest)

    def run(batches):
        now, last = object(), ""
        for b in batches:
            links = []
            for k, h in zip(b.column(at).to_pylist(), b.column(step).to_pylist(), strict=True):
                if k != now:
                    now, last = k, "0" * 64
                last = hashlib.sha256((last + (h or "")).encode()).hexdigest()
                links.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(links, pa.string())], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
