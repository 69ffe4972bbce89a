"""Schemas of requests' state and of audit events."""

from __future__ import annotations

from pyspark.sql import types as T

STATE = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("patient_context", T.VariantType()),
        T.StructField("retrieved_documents", T.ArrayType(T.VariantType())),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
        T.StructField("safety_status", T.StringType()),
        T.StructField("requires_human_review", T.BooleanType()),
        T.StructField("processing_steps", T.ArrayType(T.StringType())),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("patient_id_hash", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("safety_status", T.StringType()),
        T.StructField("human_review", T.BooleanType()),
    ]
)
