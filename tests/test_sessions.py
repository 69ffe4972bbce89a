import datetime

import pytest

from careflow.operators import temporal
from careflow.streaming import requests, review, sessions

T0 = datetime.datetime(2026, 1, 1)
MINUTE = 60_000_000


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, review.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def test_stream_and_batch_have_the_same_sessions_and_late_rows_go_to_the_side(rocks, tmp_path):
    spark, kind = rocks, "user string, ts timestamp"
    (tmp_path / "in").mkdir()
    steps = [
        [("a", at(0)), ("a", at(4)), ("b", at(1)), (None, at(1)), ("c", at(20))],
        [("a", at(8)), ("b", at(2)), ("a", at(22)), ("c", at(11.5))],  # a's 8 and b's 2 are behind the watermark (10), c's merges with the next step's
        [("c", at(16)), ("a", at(26)), ("d", at(60))],
        [("b", at(3)), ("a", at(27.5)), ("d", at(61)), ("d", at(61))],  # b's and a's sessions are over
        [("z", at(500))],
        [("z", at(1000))],
    ]

    for rows in steps:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions.sessions(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "user", "ts", 5 * MINUTE, "10 minutes")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    out = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    late = sorted((k, s) for k, kind_, s, _, _ in out if kind_ == "late")
    assert late == [("a", at(8)), ("a", at(27.5)), ("b", at(2)), ("b", at(3))]
    on_time = [r for rows in steps for r in rows if (r[0], r[1]) not in late]
    want = temporal.sessions(spark.createDataFrame(on_time, kind), "user", "ts", 5 * MINUTE).filter("user <> 'z'").collect()
    assert sorted((k, s, e, n) for k, kind_, s, e, n in out if kind_ == "session" and k != "z") == sorted(map(tuple, want))


def test_decisions_by_window(spark, tmp_path):
    kind = "trace_id string, question string, asked_at timestamp"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", "prescreva", at(1)), ("b", "oi", at(2)), ("c", "oi", at(9)), ("d", None, at(3)), ("e", "oi", at(12))])
    for _ in range(3):
        rows = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = requests.decisions_by_window(rows, "asked_at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        if not _:
            write([("late", "oi", at(100))])
        elif _ == 1:
            write([("too late", "oi", at(4))])
    got = sorted((r["start"], str(r["decision"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(at(0), "None", 1), (at(0), "allow", 2), (at(0), "human_review", 1), (at(10), "allow", 1)]
