"""Joins at a point in time and by overlap, and sessions by gaps.

All of them are windows and equi-joins. A key with a large share of all rows (``HOT``) is cut by quantiles of its times, so that
many tasks work on it; what a cut needs from those before it is one row a cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with a thousandth of all rows, but no fewer than this, is cut by its times into ``CUTS`` parts.
HOT, CUTS = 50_000, 256
#: Intervals in a bucket of a key from which these are dealt out.
CROWD = 20_000


def ticks(df: DataFrame, at: str) -> Column:
    """A time as a number: microseconds of times and dates, numbers as they are. Times without zone are read as UTC."""
    kind = df.schema[at].dataType
    if isinstance(kind, T.NumericType):
        return F.col(at)
    return F.unix_micros(F.col(at).cast("timestamp"))


def last_before(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, itself: bool) -> DataFrame:
    """Adds ``out``: the last ``value`` that isn't null of the rows before each one of its key (or up to ``itself``).

    ``order`` starts with a column of numbers without nulls; keys have no nulls.
    """
    w = Window.partitionBy(*by, "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n"), F.max("_n")).first()
    least = max(HOT, (total[0] or 0) // 1_000)
    if (total[1] or 0) < least:
        return rows.withColumn("_cut", F.lit(0)).withColumn(out, F.last(value, ignorenulls=True).over(w)).drop("_cut")
    hot = F.broadcast(sizes.filter(F.col("_n") >= least).select(*by))  # a thousand keys at most
    cuts = rows.join(hot, by).groupBy(*by).agg(F.percentile_approx(order[0], [i / CUTS for i in range(1, CUTS)]).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts), by, "left")
    rows = rows.withColumn("_cut", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order[0]))), F.lit(0)))
    rows = rows.withColumn("_cut", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_cut"))).withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts")
    ends = rows.filter("_hot").groupBy(*by, "_cut").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_cut", F.last("_end", ignorenulls=True).over(before).alias("_end"))  # at most CUTS rows a key
    rows = rows.withColumn(out, F.last(value, ignorenulls=True).over(w)).join(F.broadcast(ends), [*by, "_cut"], "left")
    return rows.withColumn(out, F.coalesce(out, "_end")).drop("_cut", "_hot", "_end")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], ties: list[str], within: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``take`` of the last row of ``right`` of its key at or before its time; nulls if there is none.

    Of right rows at one time that with the largest ``ties`` counts. ``within`` (microseconds, or the numbers' own unit) leaves out what is older.
    Rows with a null key or time match nothing; left rows keep their columns and all repetitions.
    """
    columns = left.columns
    keys = [f"_k{i}" for i in range(len(by))]
    named = lambda df, at: [*(F.col(c).alias(k) for c, k in zip(by, keys)), ticks(df, at).alias("_at")]
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in (*keys, "_at")))
    row = F.struct(*(F.col(c) for c in columns)).alias("_row")
    own = left.select(*named(left, left_at), row)
    there = right.select(*named(right, right_at), F.struct(*(F.col(c) for c in take)).alias("_take"), F.struct(*(F.col(c) for c in ties)).alias("_tie")).filter(complete)
    # One row of each key and time, so that repeated times never meet in a window.
    there = there.groupBy(*keys, "_at").agg(F.max_by("_take", "_tie").alias("_take"))
    there = there.select(*keys, "_at", F.struct(F.col("_take").alias("take"), F.col("_at").alias("at")).alias("_value"))
    both = own.filter(complete).withColumn("_side", F.lit(1)).unionByName(there.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    found = last_before(both, keys, ["_at", "_side"], "_value", "_found", itself=True).filter("_side = 1")
    value = F.col("_found.take")
    if within is not None:
        value = F.when(F.col("_at") - F.col("_found.at") <= within, value)
    found = found.select("_row", value.alias("_value"))
    none = own.filter(~complete).select("_row", F.lit(None).cast(found.schema["_value"].dataType).alias("_value"))
    out = found.unionByName(none)
    return out.select(*(F.col("_row")[c].alias(c) for c in columns), *(F.col("_value")[c].alias(c) for c in take))


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals overlap; all columns of both but the key of ``b`` (names must differ).

    Intervals are cut into buckets of ``width`` (microseconds, or the numbers' own unit) and meet by key and bucket; a pair is made in the first
    bucket that both have. A bucket with more than ``CROWD`` intervals of ``a`` is dealt out. Null, empty and reversed intervals overlap nothing.
    """

    def cut(df: DataFrame, span: tuple[str, str], mark: str) -> DataFrame:
        d = df.withColumns({f"_{mark}0": ticks(df, span[0]), f"_{mark}1": ticks(df, span[1])}).filter(F.col(f"_{mark}0") < F.col(f"_{mark}1"))
        first, last = F.floor(F.col(f"_{mark}0") / width), F.ceil(F.col(f"_{mark}1") / width) - 1
        return d.withColumn(f"_{mark}first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    x, y = cut(a, a_span, "a"), cut(b, b_span, "b")
    group = [*by, "_bucket"]
    crowds = x.groupBy(*group).count().filter(F.col("count") > CROWD).select(*group, F.ceil(F.col("count") / CROWD).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    x = x.join(crowds, group, "left").withColumn("_part", F.pmod(F.xxhash64(*(F.col(c) for c in a.columns)), parts).cast("int")).drop("_parts")
    y = y.join(crowds, group, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    met = x.join(y, [*group, "_part"]).filter((F.col("_a0") < F.col("_b1")) & (F.col("_b0") < F.col("_a1")) & (F.col("_bucket") == F.greatest("_afirst", "_bfirst")))
    return met.select(*a.columns, *(c for c in b.columns if c not in by))


def sessions(events: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """(by, start, end, n): runs of a key's events with no more than ``gap`` microseconds between neighbours. Events with a null key or time are in none."""
    rows = events.select(F.col(by), F.col(at).cast("timestamp").alias("_ts")).filter(F.col(by).isNotNull() & F.col("_ts").isNotNull())
    # Events at one time are one row, so the order is total and repeated times never meet in a window.
    rows = rows.groupBy(by, "_ts").agg(F.count("*").alias("_n")).withColumn("_at", F.unix_micros("_ts"))
    rows = last_before(rows, [by], ["_at"], "_at", "_before", itself=False)
    rows = rows.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") > gap), F.col("_at")))
    rows = last_before(rows.drop("_before"), [by], ["_at"], "_new", "_start", itself=True)
    return rows.groupBy(by, "_start").agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.sum("_n").alias("n")).select(by, "start", "end", "n")
