import datetime

import pytest
from pyspark.sql import functions as F

from careflow.operators import flow
from careflow.streaming import review

HOUR = 3_600_000
T0 = datetime.datetime(2026, 1, 1)
t = lambda h: T0 + datetime.timedelta(hours=h)

ASKED = [("a", t(0)), ("b", t(0)), ("c", t(1)), ("d", t(1)), ("e", t(30))]
GIVEN = [
    ("a", t(0.5), "approved"),  # before the reminder
    ("a", t(0.7), "rejected"),  # once more
    ("b", t(3), "rejected"),  # after the reminder
    ("b", t(30), "approved"),  # once more, after the time is over
    ("c", t(20), "approved"),  # too late
    ("x", t(2), "approved"),  # no request
    ("e", t(29), "approved"),  # before it was asked
    ("e", t(31), "rejected"),
]
REMIND, EXPIRE = HOUR, 4 * HOUR


@pytest.fixture
def rocks(spark):
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, review.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def batch(spark):
    asked, given = spark.createDataFrame(ASKED, "trace_id string, asked_at timestamp"), spark.createDataFrame(GIVEN, "trace_id string, given_at timestamp, verdict string")
    return flow.review_actions(asked, given, 1_000 * REMIND, 1_000 * EXPIRE)


def test_actions_of_whole_tables(spark):
    got = {(r["trace_id"], r["action"], r["at"], r["verdict"]) for r in batch(spark).collect()}
    assert got == {
        *((k, "ask", at, None) for k, at in ASKED),
        ("a", "resume", t(0.5), "approved"),
        ("a", "repeated", t(0.7), "rejected"),
        ("b", "remind", t(1), None),
        ("b", "resume", t(3), "rejected"),
        ("b", "repeated", t(30), "approved"),
        ("c", "remind", t(2), None),
        ("c", "expire", t(5), None),
        ("c", "late", t(20), "approved"),
        ("d", "remind", t(2), None),
        ("d", "expire", t(5), None),
        ("x", "unknown", t(2), "approved"),
        ("e", "unknown", t(29), "approved"),
        ("e", "resume", t(31), "rejected"),
    }


def test_repeated_rows_and_empty_tables(spark):
    asked, given = spark.createDataFrame(ASKED[:1] * 2 + [(None, t(0))], "trace_id string, asked_at timestamp"), spark.createDataFrame(GIVEN[:1] * 3 + [("a", None, "x")], "trace_id string, given_at timestamp, verdict string")
    got = sorted((r["action"], r["n"]) for r in flow.review_actions(asked, given, 1, 10**12).collect())
    assert got == [("ask", 1), ("remind", 1), ("repeated", 2), ("resume", 1)]
    assert flow.review_actions(asked.limit(0), given.limit(0), 1, 2).count() == 0


def test_the_stream_does_the_same_over_a_restart(rocks, tmp_path):
    spark = rocks
    kinds = {"r": "trace_id string, asked_at timestamp", "v": "trace_id string, given_at timestamp, verdict string"}

    def write(asked, given):
        for name, rows in (("r", asked), ("v", given)):
            if rows:
                spark.createDataFrame(rows, kinds[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def go():
        r, v = (spark.readStream.schema(kinds[n]).parquet(str(tmp_path / n)) for n in "rv")
        out = review.reviews(r, v, REMIND, EXPIRE, "1 minute")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    for n in kinds:
        (tmp_path / n).mkdir()
    cuts = [-1, 0.9, 2.5, 20, 29.5, 31]
    for low, high in zip(cuts, cuts[1:]):  # every step is a run of its own from the checkpoint
        inside = lambda x: t(low) < x[1] <= t(high)  # noqa: B023, E731
        write(list(filter(inside, ASKED)), list(filter(inside, GIVEN)))
        go()
    write([("z", t(500))], [])
    go()
    go()
    got = {(r["trace_id"], r["action"], r["at"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("trace_id") != "z").collect()}
    assert got == {(r["trace_id"], r["action"], r["at"], r["verdict"]) for r in batch(spark).collect()}
