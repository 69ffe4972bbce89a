"""Curation: duplicates, validity, splits without leaks, manifests, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.identity import split_of
from careflow.functions.text import mask, standard

#: Words of the longest run by which documents and passages meet, and characters of a short passage's beginning.
RUN, HEAD = 5, 3
#: Runs of passages that are broadcast at most; more meet the documents' runs in a shuffle.
BROADCAST_RUNS = 1_000_000


def dedup_exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each different text: the least key and the number of copies. Null texts are one text."""
    return df.groupBy(F.col(text).alias("_t")).agg(F.min(key).alias(key), F.count("*").alias("copies")).drop("_t")


def valid(df: DataFrame, labels: DataFrame, least_chars: int = 50, key: str = "doc_id") -> DataFrame:
    """Rows with a text of at least ``least_chars`` code points and no label of low quality; of several labels of an id the lowest counts."""
    long_enough = df.filter((F.length("text") >= least_chars) & (F.trim("text") != ""))
    return long_enough.join(labels.groupBy(key).agg(F.min("quality").alias("quality")), key, "left").filter(F.coalesce("quality", F.lit(1)) == 1).drop("quality")


def standardise(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, standard(F.col(text)))


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, mask(F.col(text)))


def split(df: DataFrame, key: str) -> DataFrame:
    """Adds split; rows with one key are on one side, whatever the partitioning."""
    return df.withColumn("split", split_of(F.col(key)))


def overlap(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of test whose standardised text, in lower case, is in train too."""
    same = df.select(key, F.lower(standard(F.col(text))).alias("_t"), split_of(F.col(key)).alias("split"))
    train = same.filter("split = 'train'").select("_t").distinct()
    return same.filter("split = 'test'").join(train, "_t", "left_semi").select(key)


def _hashes(run: int) -> Column:
    """(_run, _h): hashes of a document's different runs of ``run`` words, or of -``run`` characters."""
    if run > 0:
        n, part = F.size("_w"), lambda i: F.array_join(F.slice("_w", i, run), " ")
    else:
        n, part = F.length("_d"), lambda i: F.substring("_d", i, F.lit(-run))
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(1), n - abs(run) + 1), lambda i: F.xxhash64(part(i))))
    return F.when(n >= abs(run), F.transform(hashes, lambda h: F.struct(F.lit(run).alias("_run"), h.alias("_h")))).otherwise(F.array().cast("array<struct<_run: int, _h: bigint>>"))


def leaks(docs: DataFrame, passages: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item) wherever a document contains a whole passage; null and empty passages are in none.

    Documents and passages first meet by an equi-join on a run of words from within the passage (``RUN``, or as many
    as it has; its first and last word may be parts of others in the document), passages of one
    or two words on their first ``HEAD`` characters; then the whole passage is looked for.
    """
    d, p = docs.select(key, F.col("text").alias("_d")).filter("_d <> ''"), passages.select(item, F.col("text").alias("_p")).filter("_p <> ''")
    inner = F.size(F.split("_p", " ")) - 2
    p = p.withColumn("_run", F.when(inner > 0, F.least(inner, F.lit(RUN))).otherwise(-F.least(F.length("_p"), F.lit(HEAD))))
    part = F.when(F.col("_run") > 0, F.array_join(F.slice(F.split("_p", " "), F.lit(2), F.greatest("_run", F.lit(1))), " ")).otherwise(F.substring("_p", F.lit(1), F.abs("_run")))
    anchors = p.select(item, "_run", F.xxhash64(part).alias("_h"))
    runs = sorted(r[0] for r in anchors.select("_run").distinct().collect())  # at most RUN + HEAD rows
    if not runs:
        return d.join(p, F.lit(False)).select(key, item)
    met = d.withColumn("_w", F.split("_d", " ")).select(key, F.inline(F.concat(*map(_hashes, runs)))).join(anchors, ["_run", "_h"]).select(key, item)
    return met.distinct().join(d, key).join(p.select(item, "_p"), item).filter(F.contains("_d", F.col("_p"))).select(key, item)


def chat_rows(turns: DataFrame) -> DataFrame:
    """One training text per conversation: its turns in order, each marked with its role."""
    line = F.concat(F.lit("<"), F.coalesce("role", F.lit("")), F.lit("> "), F.coalesce("text", F.lit("")))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("said"))
    return said.select("conv_id", F.array_join(F.col("said.line"), "\n").alias("chat"), F.size("said").cast("long").alias("n_turns"))


def shared_runs(docs: DataFrame, passages: DataFrame, least: int = 8, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, doc_at, item_at, n_words): the longest run of words that a document shares with a passage, if it has ``least`` words.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; places count words from 0; of runs of equal length that first in the document,
    then in the passage counts. Runs of ``least`` words meet by two hashes of them (96 bits); hits that follow each other on one diagonal (place in the
    document less place in the passage) chain into runs. Up to ``BROADCAST_RUNS`` runs of passages go to the documents, so that only hits are shuffled.
    Null keys and texts share nothing, rows of one key count together.
    """
    low = lambda c: F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def hits(df: DataFrame, name: str, at: str) -> DataFrame:
        words = df.filter(F.col(name).isNotNull()).select(name, F.filter(F.split(low(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
        grams = F.transform(F.sequence(F.lit(1), F.size("_w") - least + 1), lambda i: F.array_join(F.slice("_w", i, least), " "))
        both = F.transform(grams, lambda g: F.struct(F.xxhash64(g).alias("a"), F.hash(g).alias("b")))
        rows = words.filter(F.size("_w") >= least).select(name, F.posexplode(both).alias(at, "_h"))
        return rows.select(name, at, F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b"))

    asked = hits(passages, item, "_p").distinct()
    if asked.count() <= BROADCAST_RUNS:
        asked = F.broadcast(asked)
    met = hits(docs, key, "_d").join(asked, ["_a", "_b"]).select(key, item, "_d", (F.col("_d") - F.col("_p")).alias("_diagonal")).distinct()
    order = Window.partitionBy(key, item, "_diagonal").orderBy("_d")
    runs = met.withColumn("_run", F.col("_d") - F.row_number().over(order)).groupBy(key, item, "_diagonal", "_run").agg(F.min("_d").alias("doc_at"), (F.count("*") + least - 1).alias("n_words"))
    runs = runs.withColumn("item_at", F.col("doc_at") - F.col("_diagonal"))
    best = runs.groupBy(key, item).agg(F.min(F.struct((-F.col("n_words")).alias("less"), "doc_at", "item_at")).alias("_r"))
    return best.select(key, item, F.col("_r.doc_at").cast("long").alias("doc_at"), F.col("_r.item_at").cast("long").alias("item_at"), (-F.col("_r.less")).alias("n_words"))
