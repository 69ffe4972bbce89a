"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of this machine is chosen if the master is local (tests, one
    machine); on a cluster that is an error, since executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/careflow-{os.getuid()}"
        os.makedirs(found, exist_ok=True)
        found = tempfile.mkdtemp(dir=found)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Kept:
    """What one call keeps for itself: tables in the shared folder and broadcast values."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.values = spark, [], []

    def free(self) -> None:
        """Deletes the tables and takes the values from all workers."""
        for path in self.paths:
            remove(self.spark, path)
        for value in self.values:
            value.unpersist()
        self.paths, self.values = [], []


#: Tables that were stashed, by session, each with a weak reference to what Spark reads it by.
_made: weakref.WeakKeyDictionary[SparkSession, list[tuple[str, object]]] = weakref.WeakKeyDictionary()
#: What the innermost ``scope`` that is open keeps.
_running: contextvars.ContextVar[Kept | None] = contextvars.ContextVar("running", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or a file of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Kept]:
    """What is stashed or broadcast within is freed at the end, and nothing else.

    Frames made within must have been written by then (``keep`` writes one so that it outlives the scope). Outside
    of any scope only ``sweep`` frees anything.
    """
    own = Kept(spark)
    token = _running.set(own)
    try:
        yield own
    finally:
        _running.reset(token)
        own.free()


def keep(df: DataFrame, name: str, where: Kept) -> DataFrame:
    """``stash`` of a frame that is freed with ``where``, not with the scope that is open."""
    token = _running.set(where)
    try:
        return stash(df, name)
    finally:
        _running.reset(token)


def sweep(spark: SparkSession) -> None:
    """Deletes the stashed tables that no frame reads any more.

    A frame, and every frame derived from it, holds on to the table's list of files in the JVM; once that is
    collected nobody can read the table again. Keep the frame (not only an RDD of it) as long as it is needed.
    """
    gc.collect()  # frames in reference cycles, such as those of a traceback
    spark._jvm.System.gc()
    made = _made.get(spark, [])
    for path, reads in list(made):
        if reads.get() is None:
            remove(spark, path)
            made.remove((path, reads))


def spread(spark: SparkSession, value):
    """A broadcast value of a proven size; within a scope it is taken back at its end."""
    found = spark.sparkContext.broadcast(value)
    if (own := _running.get()) is not None:
        own.values.append(found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    if (own := _running.get()) is not None:
        own.paths.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and no executor's disk is needed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _running.get()) is not None:
        own.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _made.setdefault(spark, []).append((path, spark._jvm.java.lang.ref.WeakReference(files)))
    return out


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for explicit repartitioning by range."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, with each group's first row and the row after its last one.

    The rows of a partition must be in the order of the keys; only the last group of what has
    been read is held back. Keys are numbers without nulls.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        begin = np.concatenate([[0], np.flatnonzero(new)])
        if begin[-1]:
            yield t.slice(0, begin[-1]), begin[:-1], begin[1:]
        held = t.slice(begin[-1])
    if held is not None:
        yield held, np.array([0]), np.array([held.num_rows])


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches whose worker gives its free memory back at the end of each task."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


def bytes_of(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z in lower case."""
    return bytes_of(text).lower().split()


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key's text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def crc_mod_py(key, n: int) -> int:
    """The same rule for one key in Python."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % n
