import math
import random

import pyarrow.parquet as pq
import pytest

from careflow.operators import curate, lexical
from careflow.sources import tables

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    usual = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(usual, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 60)) + (["Rare", "rare"] if i % 37 == 0 else []))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, "rare w1"), (1003, "rare"), (1003, "again rare"), (-5, "rare w2")]
    items = [(i, " ".join(rng.choices(usual, k=4)) + (" rare" if i % 2 else "")) for i in range(12)] + [(50, None), (51, ""), (52, "unseen"), (53, "w0"), (None, "w0")]
    return docs, items


def plain(docs, items, k):
    words, n = {}, 0
    for i, t in docs:
        if i is not None:
            words.setdefault(i, []).extend((t or "").lower().split())
    n, usual = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, t in items:
        asked = set((t or "").lower().split())
        scored = []
        for d, w in words.items():
            if q is not None and asked & set(w):
                s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / usual)) for x in asked & set(w))
                scored.append((-round(s, 6), d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_block_skipping_equals_scoring_everything(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "FIRST", 1)
    docs, items = corpus()
    built = lexical.build(spark.createDataFrame(docs, DOCS).repartition(3), tables.scratch(spark, "lexical"), block=8)
    got = built.search(spark.createDataFrame(items, ITEMS), k)
    assert sorted((*r[:3], round(r[3], 5)) for r in map(tuple, got.collect())) == [(*r[:3], round(r[3], 5)) for r in plain(docs, items, k)]


def test_blocks_are_skipped(spark):
    docs, items = corpus(n=600)
    built = lexical.build(spark.createDataFrame(docs, DOCS), tables.scratch(spark, "lexical"), block=4)
    asked, blocks = built.plan(spark.createDataFrame([(1, "rare w50")], ITEMS), 3, "item_id", "text")
    scores = built.search(spark.createDataFrame([(1, "rare w50")], ITEMS), 3)
    least = min(r["score"] for r in scores.collect())
    assert blocks.filter(f"first or bound >= {least}").count() < 0.5 * blocks.count()
    assert lexical.LexicalIndex(spark, built.postings.inputFiles()[0].partition("/postings/")[0]).search(spark.createDataFrame([(1, "rare w50")], ITEMS), 3).count() == 3


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], DOCS)
    built = lexical.build(none, tables.scratch(spark, "lexical"))
    assert built.search(spark.createDataFrame(corpus()[1], ITEMS)).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 5)], "query_id long, rank int, doc_id long")
    b = spark.createDataFrame([(1, 1, 8), (1, 2, 9)], "query_id long, rank int, doc_id long")
    got = sorted(map(tuple, lexical.fuse([a, b], 2).collect()))
    assert got == [(1, 1, 8, round(1 / 62 + 1 / 61, 9)), (1, 2, 7, round(1 / 61, 9)), (2, 1, 5, round(1 / 61, 9))]


def longest(a, b, least):
    best = None
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least and (best is None or (-n, i, j) < best):
                best = (-n, i, j)
    return best and (best[1], best[2], -best[0])


def test_shared_runs_equal_a_plain_search(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(8)] + [(90, None), (91, "A b\tC a\nb c a"), (None, "a b c")]
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, items[0][1] * 2), (None, "a b c")]
    want = []
    for d, t in docs:
        for i, p in items:
            if d is not None and i is not None:
                r = longest((t or "").lower().split(), (p or "").lower().split(), 4)
                if r:
                    want.append((d, i, *r))
    got = curate.shared_runs(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert curate.shared_runs(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def shuffled(spark, f):
    """Rows that the jobs of f write to shuffles."""
    sc, name = spark.sparkContext, f"shuffled-{random.random()}"
    sc.setJobGroup(name, name)
    f()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = map(sc.statusTracker().getJobInfo, sc.statusTracker().getJobIdsForGroup(name))
    store, n = sc._jsc.sc().statusStore(), 0
    for stage in {s for j in jobs for s in j.stageIds}:
        n += store.lastStageAttempt(stage).shuffleWriteRecords()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_no_row_for_each_posting_is_shuffled(spark):
    docs, items = corpus(n=600)
    postings = sum(len(set((t or "").lower().split())) for _, t in docs)
    got = shuffled(spark, lambda: lexical.build(spark.createDataFrame(docs, DOCS), tables.scratch(spark, "lexical")).search(spark.createDataFrame(items, ITEMS), 3).collect())
    assert 0 < got < 0.5 * postings


def test_no_row_for_each_query_and_block_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 1)
    docs, items = corpus(n=2000)
    built = lexical.build(spark.createDataFrame(docs, DOCS), tables.scratch(spark, "lexical"), block=4)
    pairs = built.plan(spark.createDataFrame(items, ITEMS), 1, "item_id", "text")[1].count()
    assert 0 < shuffled(spark, lambda: built.search(spark.createDataFrame(items, ITEMS), 1).collect()) < 0.25 * pairs


def test_row_groups_of_the_index_are_small(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP", 20_000, raising=False)
    docs = [(i, " ".join(f"w{i * 7 + j}" for j in range(200))) for i in range(400)]
    built = lexical.build(spark.createDataFrame(docs, DOCS), tables.scratch(spark, "lexical"), block=4)
    groups = [f.row_group(i) for f in (pq.read_metadata(x.removeprefix("file://")) for x in built.postings.inputFiles()) for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 100 and max(g.total_byte_size for g in groups) < 60_000
    assert [tuple(r)[:3] for r in built.search(spark.createDataFrame([(1, "w2793 w2992")], ITEMS), 1).collect()] == [(1, 1, 399)]


def test_parts_of_queries_batches_and_held_candidates_leave_the_result(spark, monkeypatch):
    docs, items = corpus(seed=2)
    for name, n in (("FIRST", 1), ("QUERIES", 5), ("ASKED", 20), ("HELD", 1)):
        monkeypatch.setattr(lexical, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # blocks lie over several batches
    try:
        built = lexical.build(spark.createDataFrame(docs, DOCS).repartition(3), tables.scratch(spark, "lexical"))
        got = sorted((*r[:3], round(r[3], 5)) for r in map(tuple, built.search(spark.createDataFrame(items, ITEMS), 3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(*r[:3], round(r[3], 5)) for r in plain(docs, items, 3)]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_runs_that_passages_share_are_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(curate, "BROADCAST_RUNS", most)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(100)) + (" p q r s" if i % 50 == 0 else "")) for i in range(200)]
    found = []
    rows = shuffled(spark, lambda: found.extend(map(tuple, curate.shared_runs(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "q p q r s t")], ITEMS), 4).collect())))
    assert sorted(found) == [(i, 1, 100, 1, 4) for i in range(0, 200, 50)]
    assert most == 0 or 0 < rows < 0.1 * 200 * 97
