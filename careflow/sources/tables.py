"""Readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """Records by an explicit schema; CSV has a header, a bad record stops the read."""
    return spark.read.format(kind).schema(schema).options(**({"header": "true"} if kind == "csv" else {}), mode="FAILFAST").load(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file: doc_id (hash of its place), text, origin, version (its time). Empty files hold no document."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"), F.col("path").alias("origin"), F.col("modificationTime").alias("version"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a folder of this machine is taken if the master is local; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="careflow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Audit lines as text files."""
    df.select("line").write.mode(mode).text(path)


def write_metrics(df: DataFrame, path: str, kind: str = "json") -> None:
    """Metrics as JSON or CSV with a header."""
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_manifest(df: DataFrame, path: str, key: str) -> None:
    """A split manifest: one JSON row for each key."""
    df.select(key, "split").write.mode("overwrite").json(path)
