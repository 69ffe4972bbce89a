"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` applies
them to ``documents``, each written to the shared folder and read again. What a stage keeps in the shared
folder for itself belongs to the run: it is deleted, and its broadcast values are taken back, when the stage's rows have been
written. Stages that are called one by one first delete the tables of those before that no frame reads any more.

All stages pass on rows with their own columns whatever their names; an empty table gives an empty
table, and repeated rows are rows like others until the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import bpe, common, minhash, mixing, quality, toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust outlier test reject.

    Null and empty texts fail the base rules and go; null languages and sources are groups of their own.
    """
    common.sweep(spark)
    return quality.keep_clean(docs)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learns from the labels of the documents it gets.

    Null ids are scored and never learned from; texts without words have the usual share of toxic ones as their score.
    """
    common.sweep(spark)
    return toxicity.keep_civil(docs, common.table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, 80 % or more in common.

    The least id stays, rows without id come last; texts without words are in no group and stay.
    """
    common.sweep(spark)
    return minhash.keep_distinct(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, written in ranges of it; null sources are a source of their own."""
    common.sweep(spark)
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left, with its slot and place in the mixture: orderBy("slot", "place").

    A null text counts as empty, a null id stays null.
    """
    common.sweep(spark)
    mixed = mixing.mix(docs, carry=["text"]).withColumn("position", F.col("slot") * mixing.BLOCK + F.col("place"))
    mixed = common.stash(mixed, "pipeline-places")
    encoded = bpe.encode_documents(mixed, id_col="position").withColumnRenamed("doc_id", "position")
    places = mixed.select("position", F.col("mixed_id").alias("doc_id"), "slot", "place")
    return encoded.join(places, "position").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place")


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", keep_civil),
    ("minhash near-duplicates", keep_distinct),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The stages are iterative or learned; SQL can't express them. tests/llm compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs, before = common.table(spark, sf_dir, "documents"), common.Kept(spark)
    for i, (_, stage) in enumerate(STAGES):
        after = common.Kept(spark)
        with common.scope(spark):
            docs = common.keep(stage(spark, docs, sf_dir), f"pipeline-{i}", after)
        before.free()
        before = after
    return docs
