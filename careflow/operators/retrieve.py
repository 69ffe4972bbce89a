"""Chunks, nearest vectors, reranking and source tracing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Queries up to so many, and up to so many bytes of them, are broadcast against the vectors; more come in several blocks.
BROADCAST_QUERIES, BROADCAST_BYTES = 20_000, 64 << 20


def chunks(df: DataFrame, size: int = 200, step: int = 160, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, chunk): pieces of ``size`` code points, one each ``step``; none for an empty text."""
    rows = df.filter(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias("_at"))
    return rows.select(key, (F.col("_at") / step).cast("long").alias("chunk_no"), F.substring("_t", F.col("_at") + 1, F.lit(size)).alias("chunk"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embed(df: DataFrame, dims: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, embedding): hashed TF-IDF of unit length, an array of ``dims`` doubles; all 0 for a text without words.

    A word's place is a hash of it, so no vocabulary is kept; document frequencies are of places,
    ``dims`` numbers. Rows of a key are counted together.
    """
    words = F.explode(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    places = df.select(key, words.alias("_w")).select(key, F.pmod(F.conv(F.substring(F.md5("_w"), 1, 6), 16, 10).cast("long"), F.lit(dims)).alias("_p"))
    counts = places.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    keys = df.select(key).distinct()
    known = counts.groupBy("_p").agg(F.count("*").alias("_df"))  # at most dims rows
    weight = F.col("_n") * (F.log((1.0 + keys.count()) / (1.0 + F.col("_df"))) + 1.0)
    entries = counts.join(F.broadcast(known), "_p").select(key, "_p", weight.alias("_x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_x"))).alias("_m"), F.sqrt(F.sum(F.col("_x") ** 2)).alias("_l"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda i: F.coalesce(F.element_at("_m", i) / F.col("_l"), F.lit(0.0)))
    return keys.join(entries, key, "left").select(key, values.alias("embedding"))


def whole(vector: Column) -> Column:
    """Whether a vector may be compared: not null, not empty, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def topk(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour, score): the k vectors with the largest dot product, ties by id; a query is not its own neighbour.

    Every batch of vectors keeps its best k for each query, so what is shuffled is k rows a query
    and batch, never all pairs. Scores are rounded to 9 digits before ranking, so that summation
    order can't decide a tie. Null and empty vectors and those with null or non-finite components neither ask
    nor are found; a query only meets vectors of its own length.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter(whole(F.col("v")))
    all_ = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(whole(F.col("v")))
    out = None
    for size, n in sorted(map(tuple, q.groupBy(F.size("v")).count().collect())):  # a row for each length
        blocks = max(1, -(-n // min(BROADCAST_QUERIES, max(1, BROADCAST_BYTES // (8 * size)))))
        for i in range(blocks):
            part = q.filter((F.size("v") == size) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == i))
            found = part.toArrow()  # at most about BROADCAST_QUERIES rows and BROADCAST_BYTES bytes
            sent = spark.sparkContext.broadcast((found.column("q").to_numpy(), np.array(found.column("v").to_pylist(), dtype=float).reshape(len(found), -1)))

            def best(batches, sent=sent):
                ids, matrix = sent.value
                for pdf in batches:
                    if not len(pdf) or not len(ids):
                        continue
                    own, rows = pdf["id"].to_numpy(), np.array(pdf["v"].tolist(), dtype=float)
                    for low in range(0, len(ids), 256):
                        score = np.round(matrix[low : low + 256] @ rows.T, 9)
                        score[ids[low : low + 256, None] == own[None, :]] = -np.inf
                        r, c = _first(own, score, k)
                        yield pd.DataFrame({"query_id": ids[low + r], "neighbour": own[c], "score": score[r, c]})

            near = all_.filter(F.size("v") == size).mapInPandas(best, "query_id long, neighbour long, score double")
            out = near if out is None else out.unionByName(near)
    if out is None:
        out = spark.createDataFrame([], "query_id long, neighbour long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour", "score")


def _first(own: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties by id; only what reaches the k-th score is sorted."""
    m = min(k, score.shape[1])
    least = -np.partition(-score, m - 1, axis=1)[:, m - 1 : m]
    rows, cols = np.nonzero((score >= least) & (score > -np.inf))
    order = np.lexsort((own[cols], -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < m], cols[place < m]


def mmr(queries: DataFrame, vectors: DataFrame, k: int = 5, pool: int = 20, weight: float = 0.5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over each query's ``pool`` nearest vectors: (query_id, rank, neighbour, score).

    Greedy and iterative, hence Python; a group holds ``pool`` rows.
    """
    near = topk(queries, vectors, pool, key, vector)
    near = near.join(vectors.select(F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("v")), "neighbour")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("neighbour", ignore_index=True)
        v, score = np.array(pdf["v"].tolist()), pdf["score"].to_numpy()
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        like, taken = unit @ unit.T, []
        while len(taken) < min(k, len(pdf)):
            gain = weight * score - (1 - weight) * (like[:, taken].max(axis=1) if taken else 0.0)
            gain[taken] = -np.inf
            taken.append(int(np.argmax(np.round(gain, 9))))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(taken) + 1), "neighbour": pdf["neighbour"].iloc[taken].to_numpy(), "score": score[taken]})

    return near.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, neighbour long, score double")


def rerank(found: DataFrame, second: Column) -> DataFrame:
    """New ranks by a second score, then the first one, then the id."""
    w = Window.partitionBy("query_id").orderBy(second.desc(), F.col("score").desc(), "neighbour")
    return found.withColumn("second", second).withColumn("new_rank", F.row_number().over(w))


def sources(found: DataFrame) -> DataFrame:
    """The ids that each query's answer rests on, in order."""
    return found.groupBy("query_id").agg(F.array_sort(F.collect_set("neighbour")).alias("sources"))
