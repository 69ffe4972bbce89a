import hashlib
from collections import defaultdict

import pytest

from careflow.llm import digests

KIND = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rows = [(1, None), (2, ""), (3, " "), (4, "é"), (5, "é"), (6, "a\x00b"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "x" * 300_000 + "y"), (None, "no id"), (None, "no id"), (None, "a"), (10, "a"), (10, "a"), (10, "other")]
    return rows + [(100 + i, "hot") for i in range(600)] + [(1000 + i, f"t{i % 40}") for i in range(200)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_equals_brute_force_in_any_number_of_batches(spark, with_clashes, batches):
    df = with_clashes(spark.createDataFrame(corpus(), KIND).repartition(3)).withColumn("digest", digests.F.lit("d")).withColumn("id", digests.F.lit(0)).withColumn("hot", digests.F.lit(1))
    assert got(digests.dedup(df, batches=batches)) == brute(corpus())


def test_empty(spark):
    assert digests.dedup(spark.createDataFrame([], KIND)).count() == 0


def test_an_index_outlives_its_session_and_a_batch_may_come_twice(spark, tmp_path):
    rows = corpus()
    halves = [rows[::2], rows[1::2]]
    frames = [digests.rows_of(spark.createDataFrame(h, KIND)) for h in halves]
    first = digests.DigestIndex(spark, str(tmp_path / "index"), 3)
    first.add(frames[0], "monday")
    for table in (first.texts, first.repeats):
        spark.sql(f"DROP TABLE {table}")
    again = digests.DigestIndex(spark, str(tmp_path / "index"), 7)
    assert again.buckets == 3
    new = {bytes(r["digest"]).hex() for r in again.new(frames[1]).collect()}
    assert new == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in halves[1]} - {hashlib.sha256((t or "").encode()).hexdigest() for _, t in halves[0]}
    for _ in range(2):
        again.add(frames[1], "tuesday")
    again.add(frames[0], "monday")
    assert got(again.verdicts(frames[0].unionByName(frames[1]))) == brute(rows)


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = digests.DigestIndex(spark, str(tmp_path / "index"), 4)
    rows = digests.rows_of(spark.createDataFrame(corpus(), KIND))
    index.add(rows, "a")
    plan = index.entries()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plan = index.new(rows.groupBy("digest").count())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_names_of_batches(spark, tmp_path):
    index = digests.DigestIndex(spark, str(tmp_path / "index"), 2)
    with pytest.raises(ValueError):
        index.add(digests.rows_of(spark.createDataFrame([], KIND)), "a' or 1=1")
