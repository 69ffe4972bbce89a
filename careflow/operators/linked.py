"""Splits that no link crosses: groups that share a text are on one side together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions.identity import split_of
from careflow.sources.tables import scratch


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; component is the least node that it reaches.

    Each round every tree of labels hooks onto the least label beside it, and labels are followed one step; the number of rounds grows with the logarithm
    of the longest path, and what is seen on the driver is one count a round. Edges with a null end are left out.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = _kept(ends.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct(), "linked-edges")
    now = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("f")), "linked-labels")
    while True:
        beside = both.join(now, both["v"] == now["node"]).groupBy("u").agg(F.min("f").alias("m"))
        near = now.join(beside, now["node"] == beside["u"], "left").select("node", "f", F.least("f", F.coalesce("m", "f")).alias("g"))
        near = _kept(near, "linked-near")
        hooks = near.groupBy(F.col("f").alias("root")).agg(F.min("g").alias("h"))
        hooked = _kept(near.join(hooks, near["f"] == hooks["root"]).select("node", "f", F.least("g", "h").alias("g")), "linked-hooked")
        ahead = hooked.select(F.col("node").alias("at"), F.col("g").alias("further"))
        after = _kept(hooked.join(ahead, hooked["g"] == ahead["at"], "left").select("node", "f", F.coalesce("further", "g").alias("g")), "linked-labels")
        if not after.filter("f <> g").count():
            return after.select("node", F.col("g").alias("component"))
        now = after.select("node", F.col("g").alias("f"))


def linked_split(df: DataFrame, group: str, text: str) -> DataFrame:
    """Adds component and split: rows whose groups are linked by equal texts, over any number of steps, are on one side.

    ``component`` is the least group that is reached. Equal texts meet by a digest; a text within one group links nothing and is dropped before
    any joining, and of a text in several groups each is linked with the least one only, so the graph has groups for nodes
    and grows with shared texts, not with rows. Null texts link nothing; rows without a group belong to that
    of their text's digest (of no text: all together), so their copies stay with them.
    """
    digest = F.sha2(F.col(text).cast("binary"), 256)
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("text:"), F.coalesce(digest, F.lit(""))))
    rows = df.withColumn("_own", own)
    pairs = rows.filter(F.col(text).isNotNull()).select(F.col("_own").alias("g"), digest.alias("d")).distinct()
    shared = pairs.groupBy("d").agg(F.min("g").alias("least"), F.max("g").alias("most")).filter("least <> most").select("d", "least")
    edges = pairs.join(shared, "d").filter("g <> least").select("g", "least").distinct()
    found = components(edges, "g", "least").withColumnRenamed("node", "_own")
    rows = rows.join(found.withColumnRenamed("component", "_component"), "_own", "left").withColumn("component", F.coalesce("_component", "_own"))
    return rows.drop("_own", "_component").withColumn("split", split_of(F.col("component")))
