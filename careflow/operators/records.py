"""Look-ups in record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(patients: DataFrame, records: DataFrame, patient_key: str, record_key: str) -> DataFrame:
    """Every record of every patient that has any."""
    return patients.join(records, patients[patient_key] == records[record_key])


def latest(patients: DataFrame, records: DataFrame, patient_key: str, record_key: str, order: list[str], take: list[str]) -> DataFrame:
    """Each patient with the newest record's columns (null without records); one partial aggregate, no sort of a patient's history."""
    newest = records.groupBy(F.col(record_key).alias(patient_key)).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_r"))
    return patients.join(newest, patient_key, "left").select(*patients.columns, *(F.col("_r")[c].alias(c) for c in take))
