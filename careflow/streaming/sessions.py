"""Sessions of a stream by gaps: open sessions merge under a watermark, rows that come too late go to the side.

Closed sessions are those that ``temporal.sessions`` makes of the same events. Needs the RocksDB state store (``review.PROVIDER``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "key string, kind string, start timestamp, end timestamp, n long"


class Sessions(StatefulProcessor):
    """One key's open sessions; times are in microseconds, timers and the watermark in milliseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long")

    def _due(self, end: int) -> int:
        """The first millisecond at which nothing can join a session any more."""
        return (end + self.gap) // 1_000 + 1

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "kind", "start", "end", "n"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        return out

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).groupby("at_us", as_index=False)["n"].sum()
        over = timerValues.getCurrentWatermarkInMs()
        now, late = sorted(self.open.get()) if self.open.exists() else [], []
        for at, n in zip(found["at_us"].astype("int64"), found["n"].astype("int64")):
            at, n = int(at), int(n)
            near = [s for s in now if s[0] - self.gap <= at <= s[1] + self.gap]
            if not near and at < 1_000 * over:
                late.append((key[0], "late", at, at, n))
                continue
            now = [s for s in now if s not in near] + [(min(at, *(s[0] for s in near)) if near else at, max(at, *(s[1] for s in near)) if near else at, n + sum(s[2] for s in near))]
        if now:
            self.open.put(sorted(now))
            for s in now:
                self.handle.registerTimer(self._due(s[1]))
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = sorted(self.open.get()) if self.open.exists() else []
        over = expiredTimerInfo.getExpiryTimeInMs()
        left = [s for s in now if self._due(s[1]) > over]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        yield self._frame([(key[0], "session", *s) for s in now if self._due(s[1]) <= over])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, by: str, at: str, gap: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of ``OUT`` from events: ``session`` rows once no event in time can join any more, ``late`` rows for events behind the watermark.

    ``gap`` is in microseconds; an event that would be late joins a session that is still open near it. Null keys and times are left out.
    """
    rows = events.select(F.col(by).cast("string").alias("key"), F.col(at).cast("timestamp").alias("clock")).filter("key is not null and clock is not null")
    # Time goes on by a column that the operator doesn't see, so that late rows come through to it.
    rows = rows.withColumn("at_us", F.unix_micros("clock")).withWatermark("clock", delay).select("key", "at_us", F.lit(1).cast("long").alias("n"))
    return rows.groupBy("key").transformWithStateInPandas(Sessions(gap), outputStructType=OUT, outputMode="append", timeMode="EventTime")
