"""ST1 over a stream whose events come late: decisions are made in order of time, once the watermark says that no earlier event can come.

A key's state is two lists: events that wait, and the times of those allowed within the window, at most as many as the quota. A timer at an event's time
decides all that wait up to the watermark, another a window later clears what no longer counts. A batch's rows of a key are never held at once: they are appended
as they come. State is kept by the store that the session names, which must be the RocksDB one (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quota(StatefulProcessor):
    """Allows an event if fewer than ``most`` were allowed in the ``window`` seconds before it."""

    def __init__(self, key: str, order: str, window: int, most: int) -> None:
        self.key, self.order, self.window, self.most = key, order, window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, id bigint")
        self.recent = handle.getListState("recent", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = set()
        for r in rows:
            t = int(r["t"])
            self.waiting.appendValue((t, r[self.order]))
            # a watermark of w means that events before w are late, so those at t are complete at t + 1 s
            at.add((t + 1) * 1000)
        for t in at:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [(w[0], w[1]) for w in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(w for w in held if (w[0] + 1) * 1000 <= now)
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        if not due:
            recent = [t for t in recent if (t + self.window) * 1000 > now]
        for t, i in due:
            recent = [x for x in recent if x > t - self.window]
            allowed = len(recent) < self.most
            if allowed:
                recent.append(t)
            yield Row(**{self.key: key[0], self.order: i, "allowed": allowed})
        later = [w for w in held if (w[0] + 1) * 1000 > now]
        if due:
            self._put(self.waiting, later)
            if recent:
                self.handle.registerTimer((max(recent) + self.window + 1) * 1000)
        self._put(self.recent, [(t,) for t in recent])

    def _put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def quota(events: DataFrame, key: str, time: str, order: str, window: int, most: int, delay: str = "1 minute") -> DataFrame:
    """(key, id, allowed) of a stream with a timestamp column, in whatever order its events come within ``delay``.

    Each event is decided once, when the watermark has passed it; one that comes later than that is dropped, as in every
    operator with a watermark. Times count in whole seconds; events of one second are taken in order of their id.
    """
    kinds = dict(events.dtypes)
    timed = events.withWatermark(time, delay).withColumn("t", F.unix_timestamp(time)).withColumn(order, F.col(order).cast("long"))
    return timed.groupBy(key).transformWithState(Quota(key, order, window, most), f"{key} {kinds[key]}, {order} bigint, allowed boolean", "Append", "EventTime")
