import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.operators import index, retrieve
from careflow.sources import tables


def clustered(spark, n=900, dims=16, groups=12, kind="float", hot=0):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, dims))
    v = centres[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, dims))
    v[:hot] = centres[0] + 0.1 * rng.normal(size=(hot, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)], f"vec_id long, embedding array<{kind}>").repartition(3)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["neighbour"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_lists_ranked_whole_equal_the_exact_search(spark, kind):
    df = clustered(spark, kind=kind)
    asked = df.filter("vec_id % 50 = 0")
    found = index.build(df, tables.scratch(spark, "index"), lists=9, parts=4).search(asked, probes=9, share=1.0)
    assert rows(found) == rows(retrieve.topk(asked, df))


def test_few_lists_do_for_clustered_vectors_also_in_another_session(spark):
    df = clustered(spark)
    asked = df.filter("vec_id % 50 = 0")
    path = tables.scratch(spark, "index")
    index.build(df, path, lists=24, parts=8)
    opened = index.Index(spark, path)
    want = {(q, n) for q, _, n, _ in rows(retrieve.topk(asked, df))}
    got = {(q, n) for q, _, n, _ in rows(opened.search(asked, probes=4, share=0.3))}
    assert len(got & want) / len(want) >= 0.9
    work = opened.work(asked, probes=4, share=0.3).collect()
    assert len(work) == 18 and all(r["n_lists"] == 4 and r["n_ranked"] < r["n_scored"] for r in work) and sum(r["n_scored"] for r in work) < 0.5 * 18 * 900


def test_other_lists_are_not_read(spark):
    df = clustered(spark)
    built = index.build(df, tables.scratch(spark, "index"), lists=24, parts=8)
    plan = built.search(df.filter("vec_id = 0"), probes=2)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.split("\n") if "FileScan parquet" in line and "vectors" in line]
    assert read and all("PartitionFilters: [" in line and "list#" in line.partition("PartitionFilters: [")[2].partition("]")[0] for line in read)


def test_a_large_list_and_many_queries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(index, "PART", 1)
    monkeypatch.setattr(index, "PACK", 7)
    df = clustered(spark, n=2600, hot=2300)
    asked = df.filter("vec_id % 50 = 0")
    built = index.build(df, tables.scratch(spark, "index"), lists=3, parts=4)
    assert built.blocks.agg(F.max("n")).first()[0] <= index.BLOCK and built.blocks.groupBy("list").count().agg(F.max("count")).first()[0] > 1
    assert rows(built.search(asked, probes=3, share=1.0)) == rows(retrieve.topk(asked, df))


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    built = index.build(none, tables.scratch(spark, "index"))
    assert built.search(none).count() == 0 and built.search(clustered(spark, 20)).count() == 0
    assert index.build(clustered(spark, 20), tables.scratch(spark, "index"), lists=4, parts=4).search(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_under_a_fifth_is_ranked_with_the_registered_parameters(spark):
    vectors = tables.table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = vectors.filter("vec_id % 50 = 0")
    work = index.build(vectors, tables.scratch(spark, "index")).work(asked)
    assert work.agg(F.max("n_ranked")).first()[0] < 0.2 * vectors.count()
