"""Connected components of a table of links, by alternating stars.

Each round hangs every node's larger neighbours on its least neighbour (large star), then its
smaller neighbours (small star); the components stay the same and the number of rounds grows
with the logarithm of the longest path. Rounds are joins and aggregations on tables of links;
nothing is collected but two sums, by which a round without change is told.

The centre of a star may have most of the links. Centres with a thousandth of all links or more
(a few thousand at most) get their least neighbour by broadcast, and their links are spread over
tasks; all others meet theirs in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: A node with fewer links than this is never a centre that is treated apart.
CENTRE = 256
#: Parts that the links of a centre are dealt out in.
SPREAD = 64


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Directed links (u, v) with m, u's least neighbour or u itself, and the table (u, m); ``total``: about how many links."""
    least = links.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    if total < CENTRE:
        return links.join(least.select("u", "m"), "u"), least.select("u", "m")
    many = max(CENTRE, total // 1_000)
    centres = F.broadcast(least.filter(F.col("n") >= many).select("u", F.col("m").alias("centre_m")))
    # A centre's links are spread by their other ends; they find nothing in the shuffle and keep what they were told.
    told = links.join(centres, "u", "left").withColumn("spread", F.when(F.col("centre_m").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(SPREAD))).cast("int"))
    rest = least.filter(F.col("n") < many).select("u", "m", (F.col("n") < 0).cast("int").alias("spread"))  # 0, but no literal: both columns stay keys of the join
    out = told.join(rest, ["u", "spread"], "left")
    return out.select("u", "v", F.coalesce("centre_m", "m").alias("m")), least.select("u", "m")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the least node that it reaches.

    Links may repeat, stand in either direction or lead from a node to itself; a link with a
    null end is ignored. Without links the result is empty.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    ends = stash(ends, "cc-ends")  # read twice below, so what makes the links runs once
    nodes = stash(ends.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    now = stash(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    mark = _mark(now)
    while True:
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large, _ = _with_least(both, 2 * mark[0])
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        if mark[0] >= CENTRE:
            large = stash(large, "cc-large")
        small, least = _with_least(large, mark[0])
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc-links")
        new = _mark(after)
        if new == mark:
            return nodes.join(after, nodes["node"] == after["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
        now, mark = after, new
