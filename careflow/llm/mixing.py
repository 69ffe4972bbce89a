"""Mixing sources to target weights by Pfair scheduling (operator 8), DataFrame functions only.

Every source is cut into blocks of ``block`` documents. With target weight w the k-th block of a
source (from 0) is released at slot floor(k / w) and due before slot ceil((k + 1) / w); in each
slot the released block with the earliest deadline runs. Weights are taken as they are, in
whole numbers without rounding, and the driver goes through all blocks once, holding
``AT_ONCE`` of them at a time. Within every prefix a source is less than one block away from its
target, as long as it has blocks left; what remains when others are used up keeps its own times.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Blocks of the schedule that the driver holds at once, and up to how many are broadcast (about 100 bytes each); beyond, the join shuffles.
AT_ONCE, BROADCAST_BLOCKS = 1_000_000, 250_000
#: Documents of a block; parts of a source that are counted and numbered apart.
BLOCK, PARTS = 32, 512


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights; a weight below 0 counts as 0."""
    parts = {s: max(Fraction(0), Fraction(w)) for s, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in parts.values())) if parts else 1
    return {s: int(x * whole) for s, x in parts.items()}


def blocks_in_order(share: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block, earliest deadline first.

    Used-up sources leave their slots empty. Blocks of sources without weight stand behind all others.
    """
    total = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share) if share[s] and blocks[s]]
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), s, k, release))
        due, s, k, release = heapq.heappop(ready)
        yield s, k, slot, release, due
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // share[s], s, k + 1))
    for s in sorted(share):
        for k in range(0 if share[s] else blocks[s]):
            yield s, k, slot, slot, slot + 1
            slot += 1


def _plan(spark, share: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """The schedule as a table, written by parts."""
    kind = pa.schema([("g_source", pa.string()), *((c, pa.int64()) for c in ("block", "slot", "release", "deadline"))])
    found, out = blocks_in_order(share, blocks), None
    while (part := list(itertools.islice(found, AT_ONCE))) or out is None:
        columns = zip(*part) if part else [[]] * 5
        rows = common.stash(spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)), "mix-plan")
        out = rows if out is None else out.unionByName(rows)
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """Gives every row its place in the mixture: source, block, slot, release, deadline and, within the block, place.

    ``weights`` are the target weights by source, on any common scale; sources that it doesn't name have no weight and stand
    behind all others. Without it each source weighs its number of rows to the ``power`` (0.5 lifts small sources, 1 keeps proportions).
    The driver holds one number a source, and blocks of the schedule ``AT_ONCE``.
    Within a source rows go by a hash of their ids, then by id; rows without id by a hash of what they carry; ties are all kept. A null
    source is a source of its own (None in ``weights``), a null id is like any other. No row is dropped or repeated. ``carry`` names columns of ``docs`` that are
    returned under their own names besides; other columns aren't read. An empty table gives an
    empty result. ``place`` and ``slot`` put the rows in order: orderBy("slot", "place").
    """
    carry = carry or []
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), key.alias("g_source"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    nameless = F.xxhash64(*(f"_c{i}" for i in range(len(carry)))) if carry else F.lit(0)
    rows = rows.withColumn("part", F.pmod(F.when(F.col("m_id").isNull(), nameless).otherwise(F.xxhash64("m_id")), F.lit(PARTS)).cast("int"))

    # Rows are numbered within hashed parts of their source, so a source of any size is spread over PARTS tasks.
    counts = rows.groupBy("g_source", "part").agg(F.count("*").alias("n"))
    before = common.stash(counts.selectExpr("g_source", "part", "n", "sum(n) over (partition by g_source order by part rows between unbounded preceding and current row) - n as before"), "mix-parts")
    found = before.groupBy("g_source").agg(F.sum("n").alias("n")).collect()
    given = None if weights is None else {"null" if s is None else f"={s}": float(w) for s, w in weights.items()}
    target = {s: float(n**power) if given is None else given.get(s, 0.0) for s, n in found}
    blocks = {s: -(-n // block) for s, n in found}
    plan = _plan(spark, exact(target), blocks)

    numbered = rows.selectExpr("*", "row_number() over (partition by g_source, part order by m_id) - 1 as at").join(before.drop("n"), ["g_source", "part"])
    numbered = numbered.withColumn("rank", F.col("before") + F.col("at")).withColumn("block", F.floor(F.col("rank") / block)).withColumn("place", (F.col("rank") % block).cast("int"))
    out = numbered.join(F.broadcast(plan) if sum(blocks.values()) <= BROADCAST_BLOCKS else plan, ["g_source", "block"])
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("m_id").alias("mixed_id"), F.col("m_source").alias("mixed_source"), F.col("block").cast("long").alias("block"), "slot", "release", "deadline", "place", *own)


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with their own columns whatever their names.

    Null sources and ids, repeated rows and empty tables as in ``mix``; texts, empty or long, only move.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"_d{i}" for i in range(len(names))))
    at = {k: f"_d{names.index(options.pop(k, v))}" for k, v in (("id_col", "doc_id"), ("source_col", "source"))}
    mixed = mix(numbered, carry=numbered.columns, **at, **options)
    mixed = mixed.repartitionByRange(common.shuffle_partitions(docs), "slot", "place").sortWithinPartitions("slot", "place")
    return mixed.select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(names)))
