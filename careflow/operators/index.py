"""An inverted-file index of vectors with product-quantised residuals.

``build`` learns a coarse quantiser (k-means lists) and a product quantiser of what is left on a
bounded sample, then writes every vector as a row of a block: a table partitioned by vector length and list, each
block with ids, codes of a byte a part, and the vectors themselves. ``search`` sends each query
to its nearest lists, reads those lists' partitions only, scores their vectors by table look-ups on the codes,
and ranks the best of each block by exact dot products.

Queries that ask a list come as packs of at most about ``PACK``, a list's blocks are dealt out in parts of
``PART`` blocks, so a list that holds or is asked by a large share of all rows is worked on by many tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.operators.retrieve import whole

#: Vectors of a block, blocks of a part, queries of a pack.
BLOCK, PART, PACK = 1_024, 16, 256
#: Vectors that the quantisers are learned from: so many, or so many a list, whichever is more.
SAMPLE, A_LIST = 20_000, 64
#: Codes of a part, and rounds of k-means.
CODES, ROUNDS = 256, 10


def means(rows: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows by Lloyd's rounds; a centre without rows takes one. Fewer rows than k are repeated."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(max(k, len(rows)))[:k] % len(rows)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centre."""
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(rows[i : i + 4_096] @ centres.T - half).argmax(axis=1) for i in range(0, len(rows), 4_096)]) if len(rows) else np.zeros(0, np.int64)


class Model:
    """Centres of the lists, and for each part of the residuals its codes' centres."""

    def __init__(self, lists: np.ndarray, books: list[np.ndarray]):
        self.lists, self.books = lists, books
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    @staticmethod
    def learn(rows: np.ndarray, lists: int, parts: int, seed: int) -> Model:
        centres = means(rows, lists, seed)
        rest = rows - centres[nearest(rows, centres)]
        return Model(centres, [means(p, CODES, seed + i) for i, p in enumerate(np.array_split(rest, min(parts, rows.shape[1]), axis=1))])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list, and its codes (a byte a part)."""
        own = nearest(rows, self.lists)
        rest = rows - self.lists[own]
        return own, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def score(self, asked: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Approximate dot products of queries with a list's coded rows."""
        out = np.repeat((asked @ self.lists[of])[:, None], len(codes), axis=1)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += (asked[:, a:b] @ book.T)[:, codes[:, m]]
        return out

    def to_json(self) -> str:
        return json.dumps({"lists": self.lists.tolist(), "books": [b.tolist() for b in self.books]})

    @staticmethod
    def from_json(text: str) -> Model:
        x = json.loads(text)
        return Model(np.array(x["lists"]), [np.array(b) for b in x["books"]])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


_BLOCKS = "size int, list int, block long, n int, ids array<long>, codes binary, vectors binary"


def build(vectors: DataFrame, path: str, lists: int = 64, parts: int = 16, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Writes the index of (key, vector) to ``path``: a new folder that driver and executors share.

    Null and empty vectors and those with null or non-finite components are left out; vectors of each length
    have quantisers of their own, learned from the first ``max(SAMPLE, A_LIST * lists)`` by a hash of the key.
    Vectors of floats are kept as such, others as doubles. Rows of one key are rows like others.
    """
    spark = vectors.sparkSession
    width = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(whole(F.col("v")))
    models, coded = [], None
    for (size,) in sorted(map(tuple, rows.select(F.size("v")).distinct().collect())):  # a row for each length
        own = rows.filter(F.size("v") == size)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, A_LIST * lists)).select("v").toArrow()
        model = Model.learn(_matrix(sample.column("v").combine_chunks(), size), lists, parts, seed)
        models.append((size, model.to_json()))
        sent = spark.sparkContext.broadcast(model)  # lists and codes: bounded by the parameters

        def encode(batches: Iterator[pa.RecordBatch], sent=sent, size=size) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("v"), size)
                at, codes = sent.value.encode(x)
                raw = [r.tobytes() for r in x.astype(width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), size, np.int32)), pa.array(at.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary())], names=["size", "list", "id", "code", "raw"])

        part = own.mapInArrow(encode, "size int, list int, id long, code binary, raw binary")
        coded = part if coded is None else coded.unionByName(part)
    spark.createDataFrame(models, "size int, model string").coalesce(1).write.parquet(f"{path}/models")
    if coded is None:
        spark.createDataFrame([], _BLOCKS).write.parquet(f"{path}/blocks")
        return Index(spark, path)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, n = [], None, 0

        def close(rows) -> pa.RecordBatch:
            ids, codes, raw = zip(*rows)
            whole = [pa.array([x], t) for x, t in ((at[0], pa.int32()), (at[1], pa.int32()), (hash((at, ids[0], len(ids), n)) & (1 << 62) - 1, pa.int64()), (len(ids), pa.int32()), (ids, pa.list_(pa.int64())), (b"".join(codes), pa.binary()), (b"".join(raw), pa.binary()))]
            return pa.RecordBatch.from_arrays(whole, names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for b in batches:
            for size, list_, *row in zip(*(b.column(c).to_pylist() for c in ("size", "list", "id", "code", "raw"))):
                if held and ((size, list_) != at or len(held) == BLOCK):
                    yield close(held)
                    held, n = [], n + 1
                at = size, list_
                held.append(row)
        if held:
            yield close(held)

    order = ["size", "list", F.xxhash64("id")]  # a large list is cut by the hash
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(blocks, _BLOCKS)
    dealt.write.partitionBy("size", "list").parquet(f"{path}/blocks")
    return Index(spark, path)


class Index:
    """A built index; it may be opened again in any session that sees its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.models = {r["size"]: Model.from_json(r["model"]) for r in spark.read.parquet(f"{path}/models").collect()}  # a row for each length
        self.blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def _asked(self, queries: DataFrame, probes: int, key: str, vector: str) -> DataFrame:
        """(size, list, q, v): each query once for each of its ``probes`` nearest lists."""
        sent = self.spark.sparkContext.broadcast(self.models)
        q = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).filter(whole(F.col("v")))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = np.array([len(v) for v in b.column("v")], np.int64)
                for size, model in sent.value.items():
                    rows = np.flatnonzero(sizes == size)
                    if not len(rows):
                        continue
                    some = b.take(pa.array(rows))
                    near = np.argsort(-(_matrix(some.column("v"), size) @ model.lists.T), axis=1, kind="stable")[:, :probes]
                    which = np.repeat(np.arange(len(rows)), near.shape[1])
                    for low in range(0, len(which), 4_096):
                        part = some.take(pa.array(which[low : low + 4_096]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, size, np.int32)), pa.array(near.ravel()[low : low + 4_096].astype(np.int32)), part.column("q"), part.column("v")], names=["size", "list", "q", "v"])

        return q.mapInArrow(send, "size int, list int, q long, v array<double>")

    def work(self, queries: DataFrame, k: int = 5, probes: int = 48, share: float = 0.1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, n_lists, n_scored, n_ranked): the lists that a search reads, vectors scored by codes and ranked exactly."""
        by_list = self.blocks.groupBy("size", "list").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.greatest(F.lit(k + 1), F.ceil(F.col("n") * share)))).alias("ranked"))
        met = self._asked(queries, probes, key, vector).drop("v").join(by_list, ["size", "list"])
        return met.groupBy(F.col("q").alias("query_id")).agg(F.count("*").alias("n_lists"), F.sum("n").alias("n_scored"), F.sum("ranked").alias("n_ranked"))

    def search(self, queries: DataFrame, k: int = 5, probes: int = 48, share: float = 0.1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, neighbour, score) as of ``retrieve.topk``, among the ``probes`` nearest lists of each query.

        Of each block of these lists the best ``share`` by code is ranked exactly (k + 1 rows at least). With all lists and a share of 1 the result is
        that of ``topk``. The defaults are for vectors without clusters, whose neighbours are spread over most lists; clustered
        ones need a few lists.
        """
        asked = self._asked(queries, probes, key, vector)
        counts = asked.groupBy("size", "list").count().collect()  # at most a row for each list
        read = F.lit(False)
        for size in self.models:
            if lists := sorted(r["list"] for r in counts if r["size"] == size):
                read |= (F.col("size") == size) & F.col("list").isin(lists)
        blocks = self.blocks.filter(read)  # partitions of other lists aren't read
        held = blocks.groupBy("size", "list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        many = self.spark.createDataFrame([(r["size"], r["list"], math.ceil(r["count"] / PACK)) for r in counts], "size int, list int, packs int")
        shape = F.broadcast(many.join(held, ["size", "list"]))  # at most a row for each list
        packs = asked.join(shape, ["size", "list"]).withColumn("pack", F.pmod(F.xxhash64("q"), F.col("packs")))
        packs = packs.groupBy("size", "list", "pack", "parts").agg(F.collect_list("q").alias("q"), F.flatten(F.collect_list("v")).alias("v"))
        packs = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = blocks.join(shape.select("size", "list", "parts"), ["size", "list"]).withColumn("part", F.pmod("block", F.col("parts")).cast("int"))
        met = dealt.drop("parts").join(packs.drop("parts", "pack"), ["size", "list", "part"]).select("size", "list", "ids", "codes", "vectors", "q", "v")
        sent = self.spark.sparkContext.broadcast(self.models)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    size, of = b.column("size")[i].as_py(), b.column("list")[i].as_py()
                    ids, q = (b.column(c)[i].values.to_numpy() for c in ("ids", "q"))
                    raw, codes = b.column("vectors")[i].as_py(), np.frombuffer(b.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
                    rows = np.frombuffer(raw, "<f4" if len(raw) == 4 * size * len(ids) else "<f8").reshape(len(ids), size).astype(float)
                    v = b.column("v")[i].values.to_numpy().reshape(-1, size)
                    rough = sent.value[size].score(v, of, codes)
                    keep = min(len(ids), max(k + 1, math.ceil(share * len(ids))))
                    found = []
                    for r in range(len(q)):
                        some = np.argpartition(-rough[r], keep - 1)[:keep]
                        some = some[ids[some] != q[r]]
                        exact = np.round(rows[some] @ v[r], 9)
                        first = np.lexsort((ids[some], -exact))[:k]
                        found.append((np.full(len(first), q[r]), ids[some][first], exact[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "neighbour", "score"])

        out = met.mapInArrow(best, "query_id long, neighbour long, score double")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour")
        return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour", "score")
