import datetime
import hashlib
import json

from pyspark.sql import functions as F

from careflow.functions.identity import pseudonymize
from careflow.functions.serial import iso_utc
from careflow.operators import audit


def test_pseudonym_is_stable_and_hides_the_id(spark):
    r = spark.createDataFrame([("patient-001",), ("patient-001",), ("ção",), (None,)], "v string").select(pseudonymize(F.col("v")).alias("h")).collect()
    assert r[0]["h"] == r[1]["h"] == "fee7aa1e3c45ac73"
    assert r[2]["h"] == hashlib.sha256("ção".encode()).hexdigest()[:16] and r[3]["h"] is None


def events(spark, rows):
    kind = "trace_id string, route string, patient_id string, sources array<string>, safety_status string, human_review boolean, at timestamp, extra string"
    return audit.audit_events(spark.createDataFrame(rows, kind), "at")


WHEN = datetime.datetime(2026, 1, 1, 0, 0, 0, 120000)


def test_event_has_only_the_hash(spark):
    e = events(spark, [("trace-1", "clinical_question", "patient-001", ["protocol-a"], "allow", None, WHEN, None)]).first()
    assert e["patient_id_hash"] == "fee7aa1e3c45ac73" and e["sources"] == ["protocol-a"] and e["human_review"] is False
    assert "patient-001" not in str(e)


def test_missing_values(spark):
    e = events(spark, [("t", "r", "", None, None, True, WHEN, None), ("t", "r", None, [], None, True, WHEN, None)]).collect()
    assert [x["patient_id_hash"] for x in e] == [None, None] and [x["sources"] for x in e] == [[], []]


def test_iso_times(spark):
    rows = [(datetime.datetime(2026, 1, 1),), (WHEN,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t timestamp").select(iso_utc(F.col("t"))).collect()]
    assert got == ["2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.120000+00:00"]


def test_extra_overrides_two_fields_only(spark):
    extra = json.dumps({"timestamp": "later", "patient_id_hash": None, "route": "other", "zeta": [1, {"b": 2, "a": "é"}], "a": 1.5})
    got = events(spark, [("t", "r", "p", ["x"], "allow", False, WHEN, extra), ("t", "r", "p", None, None, False, WHEN, None)])
    first = got.first()
    assert first["timestamp"] == "later" and first["patient_id_hash"] is None
    lines = sorted((json.loads(r["line"]) for r in audit.json_lines(got).collect()), key=lambda e: "zeta" not in e)
    assert lines[0]["route"] == "r" and lines[0]["zeta"] == [1, {"b": 2, "a": "é"}] and lines[0]["timestamp"] == "later" and lines[0]["patient_id_hash"] is None
    assert "zeta" not in lines[1]


def test_line_is_byte_equal_to_sorted_json(spark):
    odd = 'q"uo\\te\n\u0001 é 漢 '
    rows = [(odd, "r", "p", [odd, "b"], None, True, WHEN), ("t", odd, None, None, odd, False, datetime.datetime(2026, 1, 1))]
    kind = "trace_id string, route string, patient_id string, sources array<string>, safety_status string, human_review boolean, at timestamp"
    got = audit.audit_events(spark.createDataFrame(rows, kind), "at")
    for e, line in zip(got.collect(), audit.json_lines(got).collect()):
        assert line["line"] == json.dumps(e.asDict(), ensure_ascii=False, sort_keys=True)
