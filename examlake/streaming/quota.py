"""ST1 over a stream: the quota of :func:`examlake.operators.state.quota` with its state kept between batches.

The state of a key is the times of its allowed events within the window, at most as many as the quota; it goes when
the key has been quiet for a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quota(events: DataFrame, key: str, time: str, order: str, window: int, most: int, delay: str = "1 minute") -> DataFrame:
    """(key, id, allowed) for a stream with a timestamp column; events of one batch are taken in order of time and id."""

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", order])
        allowed = []
        for t in rows["t"]:
            recent = [x for x in recent if x > t - window]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(int(t))
        state.update((recent,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["t"].max()) * 1000) + window * 1000 + 1)
        yield pd.DataFrame({key: keys[0], order: rows[order], "allowed": allowed})

    kinds = dict(events.dtypes)
    timed = events.withWatermark(time, delay).withColumn("t", F.unix_timestamp(time))
    return timed.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean", "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, time: str, kind: str, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by kind in each stretch of time; late ones count until the watermark has passed."""
    return events.withWatermark(time, delay).groupBy(F.window(time, every), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
