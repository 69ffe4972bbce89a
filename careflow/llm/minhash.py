"""Near-duplicates of documents by fast similarity sketches (operator 10).

1. Every text's shingle set is hashed and sketched where the text lies; equal sets are one
   class from here on, so exact copies cost one row, however many they are.
2. The sketches are cut into bands; classes that share a band meet. A band's crowd of more
   than ``BLOCK`` classes is dealt out as pairs of blocks. A task compares sketches and passes
   on a spanning forest of the pairs that may be similar, never all pairs.
3. The components of those forests (clusters) are small families. Their members' whole sets are
   read again from the texts, dealt out in blocks of a cluster, and compared exactly, block by
   block; a pair that the task has already connected is not compared again. What leaves a task
   is a spanning forest of confirmed links.
4. The components of the confirmed links, with the classes put back, are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch
from .common import sorted_groups, tidy
from .components import connected
from .words import slices

#: Coordinates of a band, and classes of a block.
ROWS, BLOCK = 6, 256
#: The chance to miss a pair just at the threshold.
MISS = 2e-6
#: Standard deviations by which a sketch may underrate a pair that is compared exactly.
DOUBT = 4.75
#: Up to so many ids (some 130 bytes each in a join's table) are broadcast to fetch the clusters' texts; beyond, both sides are shuffled.
BROADCAST_IDS = 250_000


def plan(percent: int) -> tuple[int, float]:
    """Bands, and the least agreement of two sketches that may belong to linked texts."""
    p = percent / 100
    n = max(1, math.ceil(math.log(MISS) / math.log1p(-(p**ROWS)))) if p < 1 else 1
    return n, p - DOUBT * math.sqrt(p * (1 - p) / (n * ROWS))


def _sketch_rows(width: int, size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                sets = sketch.shingle_sets(part.column(2), width)
                coords = (sketch.fast_sketch(sets, size) & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch.digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([c.tobytes() for c in coords], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "class", "coords"],
                )

    return run


def _band_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = sketch.bands(np.frombuffer(b"".join(b.column("coords").to_pylist()), "<u2").reshape(-1, size), ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], ["node", "band"])

    return run


class _Forest:
    """Union of rows 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[rows]
            if (up == rows).all():
                return rows
            self.up[rows] = self.up[up]
            rows = up

    def root(self, row: int) -> int:
        while self.up[row] != row:
            self.up[row] = self.up[self.up[row]]
            row = self.up[row]
        return int(row)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _coords(g: pa.Table | pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(g.column("coords").to_pylist()), "<u2").reshape(-1, size)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _maybe(size: int, least: float):
    """A spanning forest of the pairs of each block pair whose sketches agree enough."""
    need = least * size

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begin, end in sorted_groups(batches, ["band", "low", "high"]):
            nodes, coords, links = part.column("node").to_numpy(), _coords(part, size), []
            two = begin[end - begin == 2]
            two = two[(coords[two] == coords[two + 1]).sum(axis=1) >= need]
            links += zip(nodes[two], nodes[two + 1])
            for low, high in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
                forest = _Forest(high - low)
                for i in range(high - low - 1):
                    rest = np.arange(i + 1, high - low)
                    rest = rest[forest.roots(rest) != forest.root(i)]
                    for j in rest[(coords[low + rest] == coords[low + i]).sum(axis=1) >= need]:
                        if forest.join(i, int(j)):
                            links.append((nodes[low + i], nodes[low + j]))
            yield _links(links)

    return run


def _confirm(size: int, least: float, percent: int):
    """A spanning forest of the confirmed links of each block pair."""
    need = least * size

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begin, end in sorted_groups(batches, ["component", "low", "high"]):
            all_nodes, all_coords, all_count, members, links = part.column("node").to_numpy(), _coords(part, size), part.column("n_shingles").to_numpy(), part.column("members"), []
            for low, high in zip(begin.tolist(), end.tolist()):
                order = low + np.argsort(all_count[low:high], kind="stable")
                nodes, coords, count = all_nodes[order], all_coords[order], all_count[order]
                sets = [np.frombuffer(members[int(i)].as_buffer(), "<u8") for i in order]
                forest = _Forest(high - low)
                for i in range(high - low - 1):
                    # Sizes are in order, so the texts that are short enough to be linked with i come first.
                    rest = np.arange(i + 1, int(np.searchsorted(percent * count, 100 * count[i], side="right")))
                    rest = rest[forest.roots(rest) != forest.root(i)]
                    for j in rest[(coords[rest] == coords[i]).sum(axis=1) >= need]:
                        if forest.root(i) == forest.root(int(j)):
                            continue
                        both = sketch.overlap(sets[i], sets[j])
                        if 100 * both >= percent * (count[i] + count[j] - both):
                            forest.join(i, int(j))
                            links.append((nodes[i], nodes[j]))
            yield _links(links)

    return run


def _members(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                sets = [s for s in sketch.shingle_sets(part.column(0), width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([sketch.digest(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["class", "members"])

    return run


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Deals each row to all the block pairs of its group that its block is part of, the rows of a pair together and in order."""
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", "blocks")
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, ids_link: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's doc_id, text_key, n_shingles and class of equal sets (null without shingles), and every class's component and least id in it.

    With ``ids_link`` the classes of rows that share an id are linked too.
    """
    n_bands, least = plan(percent)
    size = n_bands * ROWS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    drawn = common.stash(keyed.mapInArrow(_sketch_rows(width, size), "doc_id long, text_key long, n_shingles long, class binary, coords binary"), "minhash-rows")

    # Exact copies are one class; its number is fixed once it is written.
    classes = drawn.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("coords").alias("coords"), F.first("n_shingles").alias("n_shingles"))
    classes = common.stash(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    met = classes.select("node", "coords").mapInArrow(_band_rows(size), "node long, band long")
    crowds = met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = met.join(crowds, "band").select("band", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = met.join(classes.select("node", "coords"), "node")
    maybe = _block_pairs(met, "band").mapInArrow(_maybe(size, least), "a long, b long")
    clusters = common.stash(connected(maybe), "minhash-clusters")

    # Whole sets of the clusters' members only: the texts of each class's least id, or of all rows without id.
    members = common.stash(classes.join(clusters, "node").select("component", "node", "class", "least", "n_shingles", "coords"), "minhash-members")
    n, nameless = members.agg(F.count("*"), F.count(F.when(F.col("least").isNull(), 1))).first()
    wanted = members.filter("least is not null").select(F.col("least").alias("doc_id"))
    texts = rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "doc_id", "left_semi").select("text")
    if nameless:
        texts = texts.unionByName(rows.filter("doc_id is null").select("text"))
    sets = texts.mapInArrow(_members(width), "class binary, members binary").groupBy("class").agg(F.first("members").alias("members"))
    total = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    full = members.drop("least").join(sets, "class").drop("class").join(total, "component")
    links = _block_pairs(full, "component").mapInArrow(_confirm(size, least, percent), "a long, b long")
    if ids_link:
        # Rows that share an id and differ in their sets: the id stands for all their classes.
        several = drawn.filter("class is not null and doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("doc_id", "low")
        pairs = drawn.join(several, "doc_id").filter("class <> low").select("class", "low").distinct()
        pairs = pairs.join(classes.select("class", F.col("node").alias("a")), "class").join(classes.select(F.col("class").alias("low"), F.col("node").alias("b")), "low")
        links = links.unionByName(pairs.select("a", "b"))
    found = classes.select("class", "node", "least").join(connected(links), "node", "left").select("class", "least", F.coalesce("component", "node").alias("component"))
    found = common.stash(found, "minhash-components")
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return drawn.drop("coords"), found.join(ids, "component").select("class", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose shingle sets overlap: 100 * intersection >= percent * union.

    One row for each row of ``docs``: doc_id, n_shingles (size of the set of distinct shingles of
    ``width`` words), component_id (least doc_id reachable by links, itself included), kept
    (doc_id = component_id). Null, empty and blank texts have no shingles and link with
    nothing. Rows that share an id count as one document with several texts: each is compared,
    and the id stands for all. Rows without id are compared like others, get the least id of their group (and
    aren't kept), or null if it has none (and are kept). Other columns of ``docs`` aren't read, so their
    names can't clash; an empty table gives an empty result.

    Two texts exactly at the threshold share no band with a chance of at most ``MISS``; a link
    is only ever made after comparing the whole sets.
    """
    drawn, classes = _classes(docs, width, percent, id_col, text_col, ids_link=True)
    out = drawn.join(classes, "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_distinct(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with its own columns whatever their names.

    Every row is a document of its own here: rows that share an id are in one group only if their texts
    are similar. The row with the least id stays (rows without id come last), of several the one
    with the least hash of its text, of equal rows one. Rows without shingles (null, empty, blank texts) are in
    no group and all stay; an empty table gives an empty result.
    """
    names = docs.columns
    rows = docs.toDF(*(f"_d{i}" for i in range(len(names))))
    own_id, text = f"_d{names.index(id_col)}", f"_d{names.index(text_col)}"
    drawn, classes = _classes(rows, width, percent, own_id, text, ids_link=False)
    first = drawn.join(classes, "class").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("w")).select("w.doc_id", "w.text_key")
    copies = drawn.filter("class is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    first = common.stash(first.join(copies, same(first, copies)).select(first["doc_id"], first["text_key"], "copies"), "minhash-kept")
    n, n_copied = first.agg(F.count("*"), F.count(F.when(F.col("copies") > 1, 1))).first()
    rows = rows.withColumn("doc_id", F.col(own_id).cast("long")).withColumn("text_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(common.SPACES)) == ""
    full, some = rows.filter(~blank), (F.broadcast if n <= BROADCAST_IDS else lambda x: x)
    lone = some(first.filter("copies = 1"))
    out = rows.filter(blank).unionByName(full.join(lone, same(full, lone), "left_semi"))
    if n_copied:
        many = some(first.filter("copies > 1"))
        out = out.unionByName(full.join(many, same(full, many), "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.drop("doc_id", "text_key").toDF(*names)
