"""Windows of a stream beyond fixed ones: sliding, by sessions, and drift from window to window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(stream: DataFrame, time: str, length: str, step: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """``start``, the keys and the measures of every window of ``length`` that begins each ``step``."""
    made = stream.groupBy(F.window(time, length, step).alias("w"), *keys).agg(*measures)
    return made.select("*", F.col("w.start").alias("start")).drop("w")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """The keys, ``started``, ``ended`` and the measures of every session: rows of one key with no pause of ``gap``.

    With a watermark, sessions are put out in ``append`` mode once the watermark has passed their end, and
    rows that come later than that are left out.
    """
    made = stream.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(*measures)
    return made.select("*", F.col("w.start").alias("started"), F.col("w.end").alias("ended")).drop("w")


def drift(stream: DataFrame, key: str, time: str, failed: Column, length_ms: int, threshold: float) -> DataFrame:
    """``key, start_ms, n, share, before, distance, alert``: a row for each window of a key when it closes.

    ``stream`` has a watermark on ``time``.  The state of a key holds the counts of its open windows and the share of failures of the
    last closed one, with which the next is compared: ``alert`` if they differ by ``threshold`` or more.  A window closes when the watermark reaches
    its end, in the order of time whatever the order of rows; rows behind the watermark are left out.  The first window of a key has nothing
    before it and gives no alert.  Empty windows are passed over.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.unix_millis(time).alias("ms"), failed.cast("int").alias("failed"))

    def step(k: tuple, parts, state: GroupState):
        starts, counts, fails, last = state.get if state.exists else ([], [], [], None)
        held = {s: [n, f] for s, n, f in zip(starts, counts, fails, strict=True)}
        if not state.hasTimedOut:
            for pdf in parts:
                by = pdf.groupby(pdf["ms"] // length_ms * length_ms)["failed"].agg(["count", "sum"])
                for start, n, f in zip(by.index, by["count"], by["sum"], strict=True):
                    now = held.setdefault(int(start), [0, 0])
                    now[0] += int(n)
                    now[1] += int(f)
        out, mark = [], state.getCurrentWatermarkMs()
        for start in sorted(s for s in held if s + length_ms <= mark):
            n, f = held.pop(start)
            share = f / n
            distance = None if last is None else abs(share - last)
            out.append((k[0], start, n, share, last, distance, distance is not None and distance >= threshold))
            last = share
        starts = sorted(held)
        state.update((starts, [held[s][0] for s in starts], [held[s][1] for s in starts], last))
        if starts:
            state.setTimeoutTimestamp(max(starts[0] + length_ms, mark + 1))
        yield pd.DataFrame(out, columns=["key", "start_ms", "n", "share", "before", "distance", "alert"])

    return rows.groupBy("key").applyInPandasWithState(
        step,
        "key string, start_ms long, n long, share double, before double, distance double, alert boolean",
        "starts array<long>, counts array<long>, fails array<long>, last double",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
