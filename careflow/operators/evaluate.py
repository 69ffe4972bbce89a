"""Metrics of retrieval, routing and answers; averages are of doubles, rounded to six digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(x: Column) -> Column:
    return F.round(F.avg(x.cast("double")), 6)


def retrieval(ranked: DataFrame, relevant: Column, totals: DataFrame, k: int = 5) -> DataFrame:
    """hit_at_k, precision_at_k, recall_at_k and mrr over the queries of (query_id, rank, ...).

    ``totals`` has each query's number of relevant items (query_id, n_relevant), found or not; recall is the share of
    these among the first k, and 0 for a query without any.
    """
    hit = relevant & (F.col("rank") <= k)
    by = ranked.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.count(F.when(hit, 1)).alias("hits"), F.avg(F.when(F.col("rank") <= k, relevant.cast("double"))).alias("share"))
    by = by.join(totals, "query_id", "left").withColumn("recall", F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(0.0))
    return by.agg(F.count("*").alias("n_queries"), mean(F.col("first").isNotNull().cast("int")).alias("hit_at_k"), mean(F.col("share")).alias("precision_at_k"), mean(F.col("recall")).alias("recall_at_k"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def correct_source(answers: DataFrame, expected: DataFrame, key: str = "trace_id") -> DataFrame:
    """Share of answers (key, sources) that name the expected source (key, source); answers without an expected one aren't counted."""
    named = F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False))
    return answers.join(expected.select(key, "source"), key).agg(F.count("*").alias("n"), mean(named.cast("int")).alias("correct_source"))


def groundedness(answers: DataFrame, judgments: DataFrame, by: str, key: str = "trace_id", score: str = "score", enough: float = 1.0) -> DataFrame:
    """By group: answers, judged ones, mean rubric score, and share of judged answers that reach ``enough``."""
    marks = judgments.groupBy(key).agg(F.avg(F.col(score).cast("double")).alias("_s"))  # several judges of one answer
    both = answers.select(key, by).join(marks, key, "left").groupBy(by)
    return both.agg(F.count("*").alias("n"), F.count("_s").alias("n_judged"), mean(F.col("_s")).alias("score"), mean((F.col("_s") >= enough).cast("int")).alias("grounded"))


def routing(df: DataFrame, expected: Column, got: Column) -> DataFrame:
    """Rows and accuracy by expected route."""
    return df.select(expected.alias("expected"), got.alias("got")).groupBy("expected").agg(F.count("*").alias("n"), mean(F.coalesce(F.col("expected") == F.col("got"), F.lit(False)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, expected: Column, got: Column) -> DataFrame:
    return df.select(expected.alias("expected"), got.alias("got")).groupBy("expected", "got").agg(F.count("*").alias("n"))


def exact_rate(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Share of keys whose retrieved value is the expected one, nulls being equal."""
    a, b = expected.select(key, F.col(value).alias("_e"), F.lit(True).alias("_x")), actual.select(key, F.col(value).alias("_a"), F.lit(True).alias("_y"))
    both = a.join(b, key, "left")
    return both.agg(F.count("*").alias("n"), mean((F.col("_y").isNotNull() & F.col("_e").eqNullSafe(F.col("_a"))).cast("int")).alias("exact_rate"))


def by_variant(scores: DataFrame, variant: str, score: Column) -> DataFrame:
    """Rows and mean score of each variant."""
    return scores.groupBy(variant).agg(F.count("*").alias("n"), mean(score).alias("score"))


def missing_steps(df: DataFrame, required: list[str]) -> DataFrame:
    """(trace_id, missing): requests whose way lacks a required step."""
    gone = F.array_except(F.lit(required), F.col("processing_steps"))
    return df.select("trace_id", F.explode(gone).alias("missing"))


#: Weights of a Poisson bootstrap from 16 bits: the number of these that are exceeded (Poisson with mean 1, times 65,536).
POISSON = tuple(round(65_536 * p) for p in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917, 0.999990))


def paired_difference(scores: DataFrame, key: str, first: str, second: str, rounds: int = 96, level: float = 0.95) -> DataFrame:
    """(n, first, second, difference, low, high): means of two variants' scores of the same questions and an interval of their difference.

    A paired Poisson bootstrap: question and round set a weight by a hash of the key, so the result doesn't depend on the order or the
    partitions of the rows, and all ``rounds`` (a multiple of 16) are sums of one aggregation that combines before it shuffles.
    Questions without either score are left out.
    """
    rows = scores.select(F.col(key).cast("string").alias("_k"), F.col(first).cast("double").alias("_a"), F.col(second).cast("double").alias("_b")).filter("_a is not null and _b is not null")
    means = rows.agg(F.count("*").alias("n"), mean(F.col("_a")).alias("first"), mean(F.col("_b")).alias("second"), mean(F.col("_b") - F.col("_a")).alias("difference"))
    hashes = F.array(*(F.sha2(F.concat_ws(":", "_k", F.lit(str(i))), 256) for i in range(rounds // 16)))
    bits = lambda r: F.conv(F.substring(F.element_at(F.col("_h"), (r / 16).cast("int") + 1), F.pmod(r, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    drawn = rows.withColumn("_h", hashes).select("_a", "_b", "_h", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_r")).withColumn("_u", bits(F.col("_r")))
    weight = sum((F.col("_u") >= p).cast("int") for p in POISSON)
    by_round = drawn.groupBy("_r").agg((F.sum((F.col("_b") - F.col("_a")) * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("_d"))
    ends = by_round.agg(*(F.round(F.percentile("_d", (1 + side * level) / 2), 6).alias(name) for side, name in ((-1, "low"), (1, "high"))))
    return means.crossJoin(ends)  # one row each


def metric_cube(df: DataFrame, by: list[str], correct: Column, distinct: str | None = None) -> DataFrame:
    """Rows and share of ``correct`` over every combination of the columns ``by``, with ``grouping`` as a bit mask of the columns that are summed over.

    ``distinct`` adds an estimate of a column's different values: HyperLogLog sketches of 4,096 registers, which merge like sums; the
    standard error is 1.6 %.
    """
    rows = df.withColumn("_ok", F.coalesce(correct, F.lit(False)).cast("int"))
    more = [F.hll_sketch_estimate(F.hll_sketch_agg(distinct, 12)).alias("n_distinct")] if distinct else []
    return rows.cube(*by).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), mean(F.col("_ok")).alias("accuracy"), *more)
