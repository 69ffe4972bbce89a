import datetime
import json

from careflow.sources import fhir


def bundle(*resources):
    return json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in resources]})


PATIENT = {"resourceType": "Patient", "id": "p1", "name": [{"family": "Silva", "given": ["Ana", "B"]}], "gender": "female", "birthDate": "1980-02-03"}
VISIT = {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "urn:uuid:p1"}, "status": "finished", "class": {"code": "AMB"}, "period": {"start": "2020-01-01T10:00:00+02:00", "end": "2020-01-01T11:00:00Z"}}
SEEN = {"resourceType": "Observation", "id": "o1", "subject": {"reference": "Patient/p1"}, "encounter": {"reference": "Encounter/e1"}, "code": {"coding": [{"code": "8302-2", "display": "Height"}]}, "valueQuantity": {"value": 170, "unit": "cm"}, "effectiveDateTime": "2020-01-01"}


def test_bundles_become_tables_and_bad_entries_stay_apart(spark):
    rows = [
        ("a", bundle(PATIENT, VISIT, SEEN)),
        ("b", bundle({"resourceType": "Patient"}, {"id": "x"}, {**PATIENT, "id": "p2", "birthDate": "soon", "name": 5}, {**VISIT, "id": "e2", "subject": None})),
        ("c", "{broken"),
        ("d", json.dumps(PATIENT)),
        ("e", None),
        ("f", ""),
        ("g", bundle()),
        ("h", json.dumps({"resourceType": "Bundle"})),
        ("i", json.dumps({"resourceType": "Bundle", "entry": [{}, 7, {"resource": {**PATIENT, "id": "p3"}}]})),
        ("j", "[1]"),
    ]
    found = fhir.entries(spark.createDataFrame(rows, "origin string, text string"))
    people = {r["id"]: tuple(r) for r in fhir.table(found, "patients").collect()}
    assert people["p1"] == ("p1", "Silva", "Ana", "female", datetime.date(1980, 2, 3)) and people["p2"] == ("p2", None, None, "female", None) and set(people) == {"p1", "p2", "p3"}
    visits = {r["id"]: r for r in fhir.table(found, "encounters").collect()}
    assert visits["e1"]["patient_id"] == "p1" and visits["e1"]["start"] == datetime.datetime(2020, 1, 1, 8) and visits["e1"]["class"] == "AMB" and visits["e2"]["patient_id"] is None
    seen = fhir.table(found, "observations").first()
    assert (seen["patient_id"], seen["encounter_id"], seen["code"], seen["value"], seen["unit"]) == ("p1", "e1", "8302-2", 170.0, "cm")
    got = sorted(((r["origin"], r["place"], r["problem"]) for r in fhir.problems(found).collect()), key=str)
    assert got == sorted([("b", 0, "no id"), ("b", 1, "no type"), ("c", None, "not JSON"), ("d", None, "not a bundle"), ("e", None, "not JSON"), ("f", None, "not JSON"), ("i", 0, "no resource"), ("i", 1, "no resource"), ("j", None, "not a bundle")], key=str)
    assert all(fhir.table(found, name).count() == 0 for name in ("conditions", "medications", "procedures"))
