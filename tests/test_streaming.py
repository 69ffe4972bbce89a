import datetime
import json

from careflow.streaming import requests as stream


def write(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).write.mode("append").parquet(str(path))


KIND = "trace_id string, question string, patient_id string, route string, asked_at timestamp"


def test_audit_lines_from_a_stream(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1, 8, 0, 1)
    write(spark, [("a", "prescreva", "p1", "r", at), ("b", "oi", None, "r", at)], KIND, tmp_path / "in")
    rows = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    stream.write_audit(stream.audit_stream(rows, "asked_at"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    lines = sorted((json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda x: x["trace_id"])
    assert [(x["trace_id"], x["safety_status"], x["human_review"]) for x in lines] == [("a", "human_review", True), ("b", "allow", False)]
    assert "p1" not in json.dumps(lines) and lines[0]["timestamp"] == "2026-01-01T08:00:01+00:00"


def test_review_joins_late_verdicts(spark, tmp_path):
    t = lambda m: datetime.datetime(2026, 1, 1, 8, 0) + datetime.timedelta(minutes=m)
    write(spark, [("a", "prescreva", "p", "r", t(0)), ("b", "receite", "p", "r", t(1))], KIND, tmp_path / "in")
    kind = "trace_id string, verdict string, given_at timestamp"
    write(spark, [("a", "approved", t(20))], kind, tmp_path / "v")
    rows = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    verdicts = spark.readStream.schema(kind).parquet(str(tmp_path / "v"))
    q = stream.reviewed(rows, verdicts).writeStream.format("memory").queryName("reviewed").outputMode("append").start()
    q.processAllAvailable()
    # Time goes on for both sides, so the wait for b is over.
    write(spark, [("z", "oi", "p", "r", t(600))], KIND, tmp_path / "in")
    write(spark, [("zz", "approved", t(600))], kind, tmp_path / "v")
    q.processAllAvailable()
    write(spark, [("y", "receite", "p", "r", t(601))], KIND, tmp_path / "in")
    q.processAllAvailable()
    q.stop()
    got = {r["trace_id"]: r["verdict"] for r in spark.table("reviewed").collect()}
    assert got.get("a") == "approved" and got.get("b", "absent") is None
