"""Exact dedup by a persistent digest index (operator 12).

The index is a Parquet table in a folder of its own, bucketed and sorted by the SHA-256 of a text,
with a partition for each batch of documents that came in. A batch is first brought down to one row a
text (partial aggregation, so copies never travel), then meets the index in a sort-merge join, and
the index isn't shuffled for it, since it lies in buckets of the join's key: texts that the index doesn't know (anti-join) are
appended, texts that it knows leave one row in a second table of the same layout, with their
number and largest id. A batch that is added again under its name, say after a crash, replaces what it wrote before.

Verdicts read both tables bucket by bucket. Texts with a thousandth of all rows or more (a thousand
texts at most) are told by broadcast, so that rows of one text, however many, are never in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, folder, shuffle_partitions, stash

#: A text with fewer copies than this is never told by broadcast.
HOT = 256
#: Batches in which ``dedup`` brings its documents to a new index.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """An index in a folder that driver and executors share; it is opened if it is there and made if not.

    ``buckets`` counts at the first opening only (default: the session's shuffle partitions).
    Two sessions may read an index at the same time; only one may add to it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/about"
        at = lambda place: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        files = at("about").getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(at("about/_SUCCESS")):
            made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(made).alias("buckets")).write.mode("overwrite").json(about)
        self.buckets = spark.read.schema("buckets int").json(about).first()["buckets"]
        name = f"digests_{uuid.uuid4().hex}"
        self.texts, self.repeats = f"{name}_texts", f"{name}_repeats"
        for table in (self.texts, self.repeats):
            place = table.rpartition("_")[2]
            files.mkdirs(at(place))
            spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{place}'")
            spark.catalog.recoverPartitions(table)

    def _write(self, rows: DataFrame, table: str, batch: str) -> None:
        rows.repartition(self.buckets, "digest").createOrReplaceTempView(f"{table}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = '{batch}') SELECT digest, keep_id, n FROM {table}_new")
        self.spark.catalog.dropTempView(f"{table}_new")

    def new(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Of rows with a ``digest``, those whose text no batch (but ``batch`` itself) has brought: the anti-join."""
        known = self.spark.table(self.texts)
        known = known if batch is None else known.filter(F.col("batch") != batch)
        return rows.join(known.select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Brings a batch of (id, digest); ``batch`` names it: letters, digits, ``-`` and ``_``. Null ids count, but are never the largest."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        texts = stash(rows.groupBy("digest").agg(F.max("id").cast("long").alias("keep_id"), F.count("*").alias("n")), "digest-batch")
        fresh = stash(self.new(texts, batch), "digest-fresh")  # told before the table itself is written
        known = self.spark.table(self.texts).filter(F.col("batch") != batch).select("digest")
        again = texts.join(known.hint("merge"), "digest", "left_semi")
        self._write(fresh, self.texts, batch)
        self._write(again, self.repeats, batch)

    def entries(self) -> DataFrame:
        """(digest, keep_id, n) of every text: its largest id and its number of rows over all batches."""
        more = self.spark.table(self.repeats).groupBy("digest").agg(F.max("keep_id").alias("more_id"), F.sum("n").alias("more"))
        both = self.spark.table(self.texts).select("digest", "keep_id", "n").join(more.hint("merge"), "digest", "left")
        return both.select("digest", F.greatest("keep_id", "more_id").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) for rows (id, digest) whose batches have been added."""
        entries = self.entries()
        total = entries.agg(F.sum("n")).first()[0] or 0
        hot = entries.filter(F.col("n") >= max(HOT, total // 1_000)).select("digest", F.struct("keep_id", "n").alias("hot"))  # a thousand rows at most
        told = rows.select("id", "digest").join(F.broadcast(hot), "digest", "left")
        rest = told.filter("hot is null").drop("hot").join(entries.hint("merge"), "digest").select("id", "digest", "keep_id", "n")
        out = told.filter("hot is not null").select("id", "digest", "hot.keep_id", "hot.n").unionByName(rest)
        return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every document, written once: whole texts are read here and never again."""
    return stash(docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest")), "digest-rows")


def dedup(docs: DataFrame, path: str | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document, by an index in ``path`` (default: a new one in the shared folder).

    The documents come to the index in ``batches`` parts by a hash of their ids, each deduplicated against all
    before it; the result is the same for any number. Of equal texts the row with the largest id
    stays. Null texts count as empty. Rows without id count in their group and stay only if no row of it has
    an id (then all of them, as nothing tells them apart); rows that repeat the largest id stay together.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark, rows = docs.sparkSession, rows_of(docs, id_col, text_col)
    index = DigestIndex(spark, path or folder(spark, "digest-index"), shuffle_partitions(docs))
    for i in range(batches):
        index.add(rows.filter(crc_mod(F.col("id"), batches) == i), f"part-{i}")
    return index.verdicts(rows)
