"""Human review that may be interrupted: asked, reminded, expired, resumed.

A stream of requests and verdicts becomes a stream of actions, the same as ``flow.review_actions`` makes of whole tables:
ask when a request comes, remind and expire by timers in event time, resume with the first verdict in time; what
comes after that is told as repeated or late, and a verdict without a request as unknown. State lives in the
query's checkpoint, so a review goes on where it was after a restart.

Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "trace_id string, action string, at timestamp, verdict string"
#: Once a review is over, its state is kept for so many expiry times, so that late and repeated verdicts are known as such.
REMEMBERED = 30


class Review(StatefulProcessor):
    """One request's review; times are in milliseconds."""

    def __init__(self, remind: int, expire: int):
        self.remind, self.expire = remind, expire

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("review", "asked long, reminded boolean, expired boolean, resolved boolean")
        self.early = handle.getListState("early", "at long, verdict string")

    def _row(self, key, action: str, at: int, verdict: str | None = None) -> tuple:
        return key[0], action, pd.Timestamp(at, unit="ms"), verdict

    def _due(self, key, state: list, now: int) -> list[tuple]:
        """Reminder and expiry that lie before ``now``."""
        out = []
        asked, reminded, expired, resolved = state
        if not reminded and not resolved and now > asked + self.remind:
            out.append(self._row(key, "remind", asked + self.remind))
            state[1] = True
        if not expired and not resolved and now > asked + self.expire:
            out.append(self._row(key, "expire", asked + self.expire))
            state[2] = True
        return out

    def _verdict(self, key, state: list, at: int, verdict: str | None) -> list[tuple]:
        if at < state[0]:
            return [self._row(key, "unknown", at, verdict)]
        if state[3]:
            return [self._row(key, "repeated", at, verdict)]
        out = self._due(key, state, at)
        if state[2]:
            return [*out, self._row(key, "late", at, verdict)]
        state[3] = True
        return [*out, self._row(key, "resume", at, verdict)]

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows))
        state = list(self.state.get()) if self.state.exists() else None
        out, verdicts = [], []
        for kind, at, verdict in zip(found["kind"], found["at_ms"].astype("int64"), found["verdict"]):
            verdict = None if verdict is None or verdict != verdict else verdict
            if kind == "verdict":
                verdicts.append((int(at), verdict))
            elif state is None or (state[0] > at and not any(state[1:])):  # the earliest of repeated requests
                if state is None:
                    out.append(self._row(key, "ask", int(at)))
                state = [int(at), False, False, False]
                for timer in (self.remind, self.expire, REMEMBERED * self.expire):
                    self.handle.registerTimer(int(at) + timer + 1)
        if state is not None and self.early.exists():
            verdicts += [(at, v) for at, v in self.early.get()]
            self.early.clear()
        for at, verdict in sorted(verdicts, key=lambda v: (v[0], v[1] or "")):
            if state is None:
                self.early.appendValue((at, verdict))
                self.handle.registerTimer(at + self.expire)
            else:
                out += self._verdict(key, state, at, verdict)
        if state is not None:
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["trace_id", "action", "at", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.state.exists():
            state = list(self.state.get())
            out = self._due(key, state, now)
            self.state.update(tuple(state))
            if now > state[0] + REMEMBERED * self.expire:
                self.state.clear()
        elif self.early.exists():  # no request has come in time
            held = list(self.early.get())
            out = [self._row(key, "unknown", at, v) for at, v in held if at + self.expire <= now]
            self.early.clear()
            for at, v in held:
                if at + self.expire > now:
                    self.early.appendValue((at, v))
        yield pd.DataFrame(out, columns=["trace_id", "action", "at", "verdict"])

    def close(self) -> None:
        pass


def reviews(requests: DataFrame, verdicts: DataFrame, remind_ms: int, expire_ms: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of ``ACTIONS`` from streams of requests (trace_id, asked_at) and verdicts (trace_id, given_at, verdict).

    A row that comes later than ``delay`` is still taken: what a timer has decided by then stays decided. Verdicts
    that come within one batch are taken in the order of their times. Null ids and times are left out.
    """
    asked = requests.select("trace_id", F.lit("request").alias("kind"), F.col("asked_at").alias("at"), F.lit(None).cast("string").alias("verdict"))
    given = verdicts.select("trace_id", F.lit("verdict").alias("kind"), F.col("given_at").alias("at"), "verdict")
    both = asked.unionByName(given).filter("trace_id is not null and at is not null")
    # Time goes on by a column of its own, which the operator doesn't see: so no late row is dropped before it.
    both = both.withColumn("clock", F.col("at")).withWatermark("clock", delay).select("trace_id", "kind", F.unix_millis("at").alias("at_ms"), "verdict")
    return both.groupBy("trace_id").transformWithStateInPandas(Review(remind_ms, expire_ms), outputStructType=ACTIONS, outputMode="append", timeMode="EventTime")
