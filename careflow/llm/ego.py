"""Near-duplicate vectors by an epsilon grid order join (operator 1).

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c) of each other. Equal vectors are
one from here on, with a number of copies. They are projected on the leading principal
directions, put into grid cells of width epsilon, sorted by label and all cells in order, and cut into
sequence intervals (blocks). The sequence is joined with itself recursively, from few
long intervals down to blocks: pairs of intervals whose bounding boxes, in label, leading coordinates and
the norm of the rest, are provably distant go no further. Of the remaining block pairs only vectors that come within epsilon of
the other block's box move, and are halved again in the same way before cosines are computed in double precision. A block pair gives
each vector's number of links and a spanning forest of the links, never the pairs, so
what is moved grows with the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy
from .components import connected

#: Leading directions; vectors of a block; vectors of a part that isn't halved any more.
DIRECTIONS, BLOCK, LEAF = 6, 2_048, 64
#: Links of a block pair that are held before a forest takes their place.
HELD = 1 << 18
#: Intervals of a node of the sequence's tree.
FAN = 16
#: Slack for rounding in the bounds that skip blocks.
SLACK = 1e-6

_BLOCKS = "label long, dims int, nodes binary, copies binary, vectors binary, low array<double>, high array<double>"


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension: rows of a batch and their unit vectors in double precision, but for those that link with nothing."""
    at = column.offsets.to_numpy()
    values, size = column.values, np.diff(at)
    size[~np.asarray(column.is_valid())] = 0
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float)
    out = []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(axis=1)  # first by the largest component, so that squares neither overflow nor vanish
        fine = np.isfinite(top) & (top > 0)
        rows, x = rows[fine], x[fine] / top[fine][:, None]
        if len(rows):
            out.append((rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and sum of products of a partition's vectors, by dimension."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for _, x in _units(b.column(0)):
            m = np.column_stack([np.ones(len(x)), x])
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["dims", "sums"])


def _add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[d] = sums.get(d, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["dims", "sums"])


def directions(rows: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """Leading principal directions (columns) for each dimension that occurs; sums are added in two levels."""
    sums = rows.select(vector).mapInArrow(_moments, "dims int, sums binary").repartition(8).mapInArrow(_add_moments, "dims int, sums binary")
    total: dict[int, np.ndarray] = {}
    for d, x in sums.collect():  # 8 rows for each dimension
        total[d] = total.get(d, 0) + np.frombuffer(x).reshape(d + 1, d + 1)
    out = {}
    for d, m in total.items():
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(vectors[:, ::-1][:, :DIRECTIONS])
    return out


def _cells(base, width: float):
    """Every vector that may link, with its unit form, dimension and grid cells."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _units(b.column(2)):
                cells = np.floor(x @ base.value[x.shape[1]] / width).astype(np.int32)
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * cells.shape[1])
                raw, size, take = x.tobytes(), 8 * x.shape[1], pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.ListArray.from_arrays(at, pa.array(cells.ravel())), pa.array([raw[size * i : size * (i + 1)] for i in range(len(rows))], pa.binary())],
                    ["vec_id", "label", "dims", "cells", "unit"],
                )

    return run


def _cut(base):
    """Sequence intervals of one label and dimension, at most ``BLOCK`` vectors each, with their boxes."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []  # the open interval: node, copies, unit
        group = None

        def flush() -> pa.RecordBatch:
            label, dims = group
            raw = b"".join(x[2] for x in held)
            low, high = _box(_points(np.frombuffer(raw).reshape(-1, dims), base.value[dims]))
            # Label and dimension are coordinates of the box as well, so that intervals of different ones never meet.
            row = (label, dims, np.array([x[0] for x in held], "<i8").tobytes(), np.array([x[1] for x in held], "<i8").tobytes(), raw, *([float(label), float(dims), *x, *[0.0] * (DIRECTIONS + 1 - len(x))] for x in (low, high)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names)

        for b in batches:
            for label, dims, node, copies, unit in zip(*(b.column(c).to_pylist() for c in ("label", "dims", "node", "copies", "unit"))):
                if held and ((label, dims) != group or len(held) == BLOCK):
                    yield flush()
                group = (label, dims)
                held.append((node, copies, unit))
        if held:
            yield flush()

    return run


_SIDES = "block_a long, block_b long, side int, dims int, nodes binary, copies binary, vectors binary"


def _sides(base, epsilon2: float):
    """Of each block, for each one that it meets, the vectors within epsilon of the other's box; nothing where there are none."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                block, dims = b.column("block")[i].as_py(), b.column("dims")[i].as_py()
                if block != last:  # the rows of a block come one after the other
                    vectors = np.frombuffer(b.column("vectors")[i].as_py()).reshape(-1, dims)
                    nodes, copies = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("nodes", "copies"))
                    points, last = _points(vectors, base.value[dims]), block
                low, high = (np.array(b.column(c)[i].as_py())[2 : 2 + points.shape[1]] for c in ("low", "high"))
                gap = np.maximum(0.0, np.maximum(low - points, points - high))
                met = np.einsum("ij,ij->i", gap, gap) <= epsilon2 + SLACK
                if met.any():
                    out.append((*(b.column(c)[i].as_py() for c in ("block_a", "block_b", "side")), dims, *(x[met].tobytes() for x in (nodes, copies, vectors))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], [c.split()[0] for c in _SIDES.split(", ")])

    return run


def _near(a: tuple, b: tuple, epsilon2: float) -> bool:
    """Whether two boxes (least, greatest) come within epsilon."""
    gap = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) <= epsilon2 + SLACK


def _box(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points.min(axis=0), points.max(axis=0)


def _points(vectors: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Leading coordinates and the norm of the rest: distances between them bound the vectors' from below."""
    lead = vectors @ base
    return np.column_stack([lead, np.sqrt(np.maximum(0.0, (vectors * vectors).sum(axis=1) - (lead * lead).sum(axis=1)))])


def _pairs(pa_: np.ndarray, pb: np.ndarray, a: slice, b: slice, epsilon2: float) -> Iterator[tuple[slice, slice]]:
    """Leaf pairs of two intervals that may hold links, by halving the longer one."""
    if not _near(_box(pa_[a]), _box(pb[b]), epsilon2):
        return
    n, m = a.stop - a.start, b.stop - b.start
    if max(n, m) <= LEAF:
        yield a, b
    elif n >= m:
        mid = a.start + n // 2
        yield from _pairs(pa_, pb, slice(a.start, mid), b, epsilon2)
        yield from _pairs(pa_, pb, slice(mid, a.stop), b, epsilon2)
    else:
        mid = b.start + m // 2
        yield from _pairs(pa_, pb, a, slice(b.start, mid), epsilon2)
        yield from _pairs(pa_, pb, a, slice(mid, b.stop), epsilon2)


def _spread(n: int, m: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows 0..n-1 and n..n+m-1: every row's root, by lowering labels until nothing changes."""
    label = np.arange(n + m)
    if links:
        u, v = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
        while True:
            low = np.minimum(label[u], label[v])
            after = label.copy()
            np.minimum.at(after, u, low)
            np.minimum.at(after, v, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
    rows = np.flatnonzero(label != np.arange(n + m))
    return rows, label[rows]


def _join(base, cosine: float):
    """Links of block pairs: counts by node and a forest. A row is (node, n, other): n links, or an edge if other is given."""
    epsilon2 = 2 - 2 * cosine

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, same = batch.column("dims")[i].as_py(), batch.column("same")[i].as_py()
                side = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                a, ia, ma = side("vectors", float).reshape(-1, dims), side("nodes", "<i8"), side("copies", "<i8")
                c, ic, mc = (a, ia, ma) if same else (side("vectors_b", float).reshape(-1, dims), side("nodes_b", "<i8"), side("copies_b", "<i8"))
                pts_a = _points(a, base.value[dims])
                pts_c = pts_a if same else _points(c, base.value[dims])
                counts, links = np.zeros(len(a) + (0 if same else len(c)), np.int64), []
                offset, held = 0 if same else len(a), 0
                for x, y in _pairs(pts_a, pts_c, slice(0, len(a)), slice(0, len(c)), epsilon2):
                    if same and y.stop <= x.start:
                        continue  # seen from the other side
                    hit = a[x] @ c[y].T >= cosine
                    if same:
                        hit &= np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop)[None, :]
                    u, v = np.nonzero(hit)
                    u, v = u + x.start, v + y.start
                    if len(u):
                        counts += np.bincount(u, weights=mc[v], minlength=len(counts)).astype(np.int64) + np.bincount(v + offset, weights=ma[u], minlength=len(counts)).astype(np.int64)
                        links.append((u, v + offset))
                        held += len(u)
                        if held > HELD:
                            links = [_spread(len(counts), 0, links)]
                            held = len(links[0][0])
                nodes = ia if same else np.concatenate([ia, ic])
                full = np.flatnonzero(counts)
                rows, roots = _spread(len(counts), 0, links)
                if len(full) + len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes[full], nodes[rows]])), pa.array(np.concatenate([counts[full], np.zeros(len(rows), np.int64)])), pa.concat_arrays([pa.nulls(len(full), pa.int64()), pa.array(nodes[roots])])], ["node", "n", "other"])

    return run


def _near_sql(epsilon2: float):
    """Whether the boxes (low, high) and (low_b, high_b) come within epsilon."""
    gaps = F.zip_with(F.zip_with("low", "high_b", lambda a, b: a - b), F.zip_with("low_b", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    # Labels and dimensions come first and are whole numbers: a gap between them is at least 1, more than any two unit vectors' that link.
    return F.aggregate(F.transform(gaps, lambda x, i: F.when(i < 2, x * 4).otherwise(x)), F.lit(0.0), lambda s, x: s + x * x) <= epsilon2 + SLACK


def _meeting(boxes: DataFrame, n: int, epsilon2: float) -> DataFrame:
    """Pairs (block, block_b), block <= block_b, of the n boxes whose distance may be within epsilon.

    The sequence of blocks is a tree of ``FAN`` intervals to each node. Starting with the whole
    sequence, pairs of intervals whose boxes come within epsilon are joined on, each with the
    intervals that it consists of; provably distant ones go no further.
    """
    levels = max(1, math.ceil(math.log(max(2, n), FAN)))
    fields = lambda df, s: df.select(F.col("block").alias(f"block{s}"), F.floor(F.col("block") / FAN).alias(f"up{s}"), F.col("low").alias(f"low{s}"), F.col("high").alias(f"high{s}"))
    tree = [boxes.select("block", "low", "high")]
    bounds = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(DIRECTIONS + 3)))
    for _ in range(levels - 1):
        tree.append(common.stash(tree[-1].groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(bounds(F.min, "low").alias("low"), bounds(F.max, "high").alias("high")), "ego-tree"))
    pairs = None
    for level in reversed(tree):
        a, b = fields(level, ""), fields(level, "_b")
        if pairs is None:  # the top has at most FAN nodes
            met = a.join(b, a["up"] == b["up_b"])
        else:
            met = pairs.join(a, "up").join(b, "up_b")
        met = met.filter(F.col("block") <= F.col("block_b")).filter(_near_sql(epsilon2)).select("block", "block_b")
        if level is not tree[0]:
            met = common.stash(met, "ego-pairs")
        pairs = met.select(F.col("block").alias("up"), F.col("block_b").alias("up_b"))
    return pairs.toDF("block", "block_b")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Groups of vectors of one label whose cosine is at least ``cosine``.

    One row for each row of ``vectors``: vec_id, n_links (other vectors linked directly),
    component_id (least vec_id reachable by links, itself included), kept (vec_id =
    component_id). Null, empty and zero vectors, vectors with null or non-finite components, and
    rows without label or id link with nothing; so do vectors of different lengths. Rows that repeat an id
    count as vectors of their own in their neighbours' n_links, share their links' sum and one component. Other columns
    aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    linked = rows.filter("vec_id is not null and label is not null and v is not null")
    base = common.spread(spark, directions(linked, "v"))
    epsilon2 = 2 - 2 * cosine
    cells = common.stash(linked.mapInArrow(_cells(base, math.sqrt(epsilon2)), "vec_id long, label long, dims int, cells array<int>, unit binary"), "ego-cells")

    # Equal vectors of a label are one node with a number of copies; its number is fixed once it is written.
    classes = cells.groupBy("label", "dims", F.sha2("unit", 256).alias("digest")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("cells").alias("cells"), F.first("unit").alias("unit"))
    classes = common.stash(classes.withColumn("node", F.monotonically_increasing_id()), "ego-classes")
    keys = ["label", "dims", "cells", "node"]
    blocks = classes.repartitionByRange(common.shuffle_partitions(vectors), *keys).sortWithinPartitions(*keys).select("label", "dims", "node", "copies", "unit").mapInArrow(_cut(base), _BLOCKS)
    blocks = common.stash(blocks.withColumn("at", F.monotonically_increasing_id()), "ego-blocks")
    # Numbers without gaps in the order of the sequence: a partition's first one from the sizes of those before it.
    part = F.shiftright("at", 33)
    sizes = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and current row) - n as before")  # a row for each partition
    blocks = blocks.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("block", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")

    n = blocks.count()
    if n:
        met = common.stash(_meeting(blocks, n, epsilon2), "ego-met")
        data = blocks.select("block", "dims", "nodes", "copies", "vectors")
        # Labels are compared as they are: as coordinates of boxes very large ones may round alike.
        boxes = blocks.select("block", "label", "low", "high")
        there = boxes.toDF("block_b", "label_b", "low_b", "high_b")
        pairs = met.filter("block < block_b").join(boxes, "block").join(there, "block_b").filter("label = label_b")
        sides = pairs.select(F.col("block").alias("block_a"), "block_b", F.inline(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side"), F.col("low_b").alias("low"), F.col("high_b").alias("high")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side"), F.col("low"), F.col("high")))))
        # A block's vectors move once; of these only what is near another block moves again, to meet there.
        sides = common.stash(data.join(sides.hint("merge"), "block").mapInArrow(_sides(base, epsilon2), _SIDES), "ego-sides")
        one = lambda side, mark: sides.filter(F.col("side") == side).select("block_a", "block_b", *(F.col(c).alias(c + mark) for c in ("dims", "nodes", "copies", "vectors")))
        met = one(0, "").join(one(1, "_b"), ["block_a", "block_b"]).select("dims", F.lit(False).alias("same"), "nodes", "copies", "vectors", "nodes_b", "copies_b", "vectors_b")
        own = data.select("dims", F.lit(True).alias("same"), "nodes", "copies", "vectors", *(F.lit(None).cast("binary").alias(c) for c in ("nodes_b", "copies_b", "vectors_b")))
        met = met.unionByName(own)
        found = common.stash(met.mapInArrow(_join(base, cosine), "node long, n long, other long"), "ego-links")
    else:
        found = spark.createDataFrame([], "node long, n long, other long")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    # An id with several vectors joins their nodes.
    several = cells.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    digests = classes.select("label", "dims", F.sha2("unit", 256).alias("digest"), "node")
    member = cells.select("vec_id", "label", "dims", F.sha2("unit", 256).alias("digest")).join(digests, ["label", "dims", "digest"]).select("vec_id", "node")
    same = member.join(several, "vec_id").groupBy("vec_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.collect_set("node").alias("nodes")).filter("low <> high").select("low", F.explode("nodes").alias("node"))
    edges = found.filter("other is not null").select("node", "other").unionByName(same.select("node", F.col("low").alias("other")))
    groups = classes.select("node", "least", "copies").join(connected(edges, "node", "other"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = common.stash(groups, "ego-groups")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    known = groups.join(least, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    by_id = member.join(known, "node").groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(by_id, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
