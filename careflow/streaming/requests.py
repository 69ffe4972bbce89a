"""Streams of requests: assessment, audit lines, and reviews that come later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from careflow.operators import audit, safety


def assessed(requests: DataFrame) -> DataFrame:
    """A stream of (trace_id, question, ...) with decision and reason; stateless, any output mode."""
    return safety.assess(requests, "question")


def audit_stream(requests: DataFrame, event_time: str) -> DataFrame:
    """A stream of audit lines, stamped with each request's own time."""
    rows = assessed(requests).withColumn("safety_status", F.col("decision")).withColumn("human_review", F.coalesce(F.col("decision") != safety.ALLOW, F.lit(True)))
    return audit.json_lines(audit.audit_events(rows, event_time))


def write_audit(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends lines to text files, exactly once."""
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decisions_by_window(requests: DataFrame, event_time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of decisions in tumbling windows; requests later than ``late`` are left out."""
    rows = assessed(requests.withWatermark(event_time, late))
    return rows.groupBy(F.window(event_time, window).alias("w"), "decision").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "decision", "n")


def reviewed(requests: DataFrame, verdicts: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Requests for review with their verdict, or null once ``wait`` has passed. Both sides need asked_at and given_at times."""
    r = assessed(requests).filter(F.col("decision") == safety.HUMAN_REVIEW).withWatermark("asked_at", wait).alias("r")
    v = verdicts.withWatermark("given_at", wait).alias("v")
    on = F.expr(f"r.trace_id = v.trace_id and v.given_at >= r.asked_at and v.given_at <= r.asked_at + interval {wait}")
    return r.join(v, on, "leftOuter").select("r.trace_id", "r.asked_at", "v.verdict", "v.given_at")
