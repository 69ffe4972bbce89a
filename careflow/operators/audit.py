"""Audit events without raw ids, and their JSON lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions.identity import pseudonymize
from careflow.functions.serial import iso_utc, json_boolean, json_string, json_strings

FIELDS = ("timestamp", "trace_id", "route", "patient_id_hash", "sources", "safety_status", "human_review")


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def audit_events(df: DataFrame, event_time: str | None = None) -> DataFrame:
    """The seven fixed fields of an event for every row, and extra if the rows have it.

    Reads trace_id and route, and patient_id, sources, safety_status, human_review, extra where
    they exist. The id is hashed, an empty or missing id gives null; missing sources give an empty
    list; a missing human_review is false. ``extra`` is a JSON object; of the fixed fields it can
    override timestamp and patient_id_hash only, and it does so whenever it has the key, even with null.
    Without ``event_time`` all rows get the query's time.
    """
    id_ = _or_null(df, "patient_id", "string")
    stamp = iso_utc(F.col(event_time)) if event_time else iso_utc(F.current_timestamp())
    hashed = F.when(F.length(id_) > 0, pseudonymize(id_))
    columns = {
        "timestamp": stamp,
        "trace_id": F.col("trace_id"),
        "route": F.col("route"),
        "patient_id_hash": hashed,
        "sources": F.coalesce(_or_null(df, "sources", "array<string>"), F.array().cast("array<string>")),
        "safety_status": _or_null(df, "safety_status", "string"),
        "human_review": F.coalesce(_or_null(df, "human_review", "boolean"), F.lit(False)),
    }
    if "extra" not in df.columns:
        return df.select(*(c.alias(n) for n, c in columns.items()))
    keys = F.coalesce(F.json_object_keys("extra"), F.array().cast("array<string>"))
    for name in ("timestamp", "patient_id_hash"):
        columns[name] = F.when(F.array_contains(keys, name), F.get_json_object("extra", f"$.{name}")).otherwise(columns[name])
    return df.select(*(c.alias(n) for n, c in columns.items()), F.col("extra"))


@F.pandas_udf(T.StringType())
def _merged(line: pd.Series, extra: pd.Series) -> pd.Series:
    fixed = set(FIELDS)
    return pd.Series([json.dumps(json.loads(a) | {k: v for k, v in (json.loads(b) if b else {}).items() if k not in fixed or k in ("timestamp", "patient_id_hash")}, ensure_ascii=False, sort_keys=True) for a, b in zip(line, extra)])


def json_lines(events: DataFrame) -> DataFrame:
    """One column, line: an event as JSON with sorted keys, non-ASCII text as it is, a blank after each comma and colon.

    Events without extras are built from built-in functions only. Extras have any keys and
    types, which no built-in function can merge and print byte for byte; only events that have some go through Arrow.
    """
    parts = [
        ('{"human_review": ', json_boolean(F.col("human_review"))),
        (', "patient_id_hash": ', json_string(F.col("patient_id_hash"))),
        (', "route": ', json_string(F.col("route"))),
        (', "safety_status": ', json_string(F.col("safety_status"))),
        (', "sources": ', json_strings(F.col("sources"))),
        (', "timestamp": ', json_string(F.col("timestamp"))),
        (', "trace_id": ', json_string(F.col("trace_id"))),
    ]
    line = F.concat(*(x for k, v in parts for x in (F.lit(k), v)), F.lit("}"))
    if "extra" not in events.columns:
        return events.select(line.alias("line"))
    plain = events.filter("extra is null").select(line.alias("line"))
    return plain.unionByName(events.filter("extra is not null").select(_merged(line, F.col("extra")).alias("line")))
