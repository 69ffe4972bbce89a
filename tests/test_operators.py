import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.operators import curate, evaluate, flow, index, records, retrieve
from careflow.plans import catalog
from careflow.settings import Settings
from careflow.sources import tables


def test_dedup_keeps_the_least_id(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, curate.dedup_exact(rows).collect())) == [(1, 2), (2, 1), (4, 1)]


def test_split_is_stable_and_groups_stay_together(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "concat('g', id % 40) as source")
    a = {r["doc_id"]: r["split"] for r in curate.split(rows, "source").collect()}
    b = {r["doc_id"]: r["split"] for r in curate.split(rows.repartition(7), "source").collect()}
    assert a == b and len(set(a.values())) >= 2
    assert all(a[i] == a[i + 40] for i in range(400))


def test_leaks_equal_a_plain_search(spark):
    docs = [(1, "one two three four five six seven eight nine"), (2, "zz four five zz"), (3, None), (4, ""), (5, "xfour fivey  z"), (6, "é  é nine ten"), (7, "one two three four five six seven eight nine")]
    items = [(1, "wo three four five six seven ei"), (2, "four five"), (3, "nine one"), (4, ""), (5, None), (6, "e"), (7, "é "), (8, "our fiv"), (9, "two three four"), (10, "o three four five s"), (11, "  z"), (12, "é  é"), (13, "nine")]
    want = sorted((d, i) for d, t in docs for i, p in items if t and p and p in t)
    got = curate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want
    assert curate.leaks(got.limit(0).selectExpr("doc_id", "'' as text"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert curate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_masks(spark):
    r = spark.createDataFrame([("mail a.b@c.example.com at 10.0.0.1, card 1234-5678-9012-3456.",)], "text string")
    assert curate.masked(r).first()["text"] == "mail <email> at <ip>, card <number>."


def vectors(spark, n=120, dims=8):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in v[i]], i % 3) for i in range(n)], "vec_id long, embedding array<double>, label int").repartition(3)


def brute(v, q, k):
    score = np.round(v @ v[q], 9)
    score[q] = -np.inf
    return list(np.lexsort((np.arange(len(v)), -score))[:k])


def test_topk_is_exact_whatever_the_block(spark, monkeypatch):
    v, df = vectors(spark)
    asked = df.filter("vec_id % 50 = 0")
    for limit in (20_000, 1):
        monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", limit)
        got = retrieve.topk(asked, df).orderBy("query_id", "rank").collect()
        for q in (0, 50, 100):
            assert [r["neighbour"] for r in got if r["query_id"] == q] == brute(v, q, 5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_registered_approximate_query_reaches_its_recall(spark):
    pairs = lambda name: {(r["query_id"], r["neighbour"]) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    want = pairs("knn_topk")
    assert len(want) == 50 and len(pairs("ann_topk") & want) / len(want) >= 0.9


def test_mmr_starts_with_the_nearest_and_repeats_nothing(spark):
    v, df = vectors(spark)
    got = retrieve.mmr(df.filter("vec_id = 0"), df).orderBy("rank").collect()
    assert got[0]["neighbour"] == brute(v, 0, 1)[0] and len({r["neighbour"] for r in got}) == 5


def test_chunks_cover_the_text(spark):
    rows = spark.createDataFrame([(1, "é" * 401), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["chunk_no"], len(r["chunk"])) for r in retrieve.chunks(rows).orderBy("chunk_no").collect()] == [(0, 200), (1, 200), (2, 81)]


def test_latest_record(spark):
    p = spark.createDataFrame([(1,), (2,)], "p int")
    r = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c")], "q int, at int, v string")
    assert sorted(map(tuple, records.latest(p, r, "p", "q", ["at", "v"], ["v"]).collect())) == [(1, "c"), (2, None)]


def test_odd_vectors_neither_ask_nor_are_found(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, None, 1), (3, [], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [float("inf"), 1.0], 1), (8, [0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    built = index.build(df, tables.scratch(spark, "odd"), lists=2, parts=2)
    for find in (retrieve.topk(df, df, k=3), built.search(df, k=3)):
        got = {(r["query_id"], r["neighbour"]) for r in find.collect()}
        assert got <= {(a, b) for g in ((0, 1, 8), (6, 9)) for a in g for b in g if a != b} and (0, 1) in got
    assert retrieve.topk(df.filter("vec_id = 2"), df).count() == 0 and retrieve.topk(df, df.limit(0)).count() == 0


def test_embedding_equals_a_plain_version(spark):
    import hashlib
    import math

    rows = [(1, "a b a c"), (2, "b  c\nd"), (3, None), (4, " "), (5, "a")]
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 8
    counts = {d: {} for d, _ in rows}
    for d, t in rows:
        for w in (t or "").split():
            counts[d][place(w)] = counts[d].get(place(w), 0) + 1
    df = {p: sum(p in c for c in counts.values()) for p in range(8)}
    got = {r["doc_id"]: r["embedding"] for r in retrieve.embed(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    for d, c in counts.items():
        x = [c.get(p, 0) * (math.log(6 / (1 + df[p])) + 1) for p in range(8)]
        length = math.sqrt(sum(v * v for v in x)) or 1.0
        assert got[d] == pytest.approx([v / length for v in x])


def test_metrics(spark):
    r = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False)], "query_id long, rank int, ok boolean")
    totals = spark.createDataFrame([(1, 4), (2, 0)], "query_id long, n_relevant long")
    m = evaluate.retrieval(r, F.col("ok"), totals, k=2).first()
    assert (m["n_queries"], m["hit_at_k"], m["precision_at_k"], m["recall_at_k"], m["mrr"]) == (2, 0.5, 0.25, 0.125, 0.25)
    answers = spark.createDataFrame([("a", ["p", "q"]), ("b", []), ("c", None), ("d", ["x"])], "trace_id string, sources array<string>")
    expected = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "trace_id string, source string")
    assert tuple(evaluate.correct_source(answers, expected).first()) == (3, 0.333333)
    judged = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "trace_id string, score double")
    got = evaluate.groundedness(answers.withColumn("v", F.lit("base")), judged, "v").first()
    assert tuple(got) == ("base", 4, 2, 0.75, 0.5)


def test_readers_and_writers(spark, tmp_path):
    from careflow.sources import tables

    rows = spark.createDataFrame([(1, "é, x", 1.5), (2, None, None)], "id long, name string, value double")
    for kind in ("csv", "json"):
        tables.write_metrics(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, tables.records(spark, f"{tmp_path}/{kind}", rows.schema, kind).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "bad.csv").write_text("id,name,value\nx,y,z\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.records(spark, f"{tmp_path}/bad.csv", rows.schema).collect()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo é")
    (tmp_path / "docs" / "b.txt").write_text("")
    found = {r["origin"].rpartition("/")[2]: r for r in tables.documents(spark, f"{tmp_path}/docs").collect()}
    assert found["a.txt"]["text"] == "one\ntwo é" and "b.txt" not in found and found["a.txt"]["version"] is not None
    tables.write_lines(spark.createDataFrame([("l1",), ("l2",)], "line string"), f"{tmp_path}/lines")
    tables.write_lines(spark.createDataFrame([("l3",)], "line string"), f"{tmp_path}/lines")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["l1", "l2", "l3"]
    tables.write_manifest(curate.split(rows, "id"), f"{tmp_path}/manifest", "id")
    assert {r["id"] for r in spark.read.json(f"{tmp_path}/manifest").collect()} == {1, 2}


def test_flow_paths(spark):
    asked = spark.createDataFrame([("a", "ok?", "1"), ("b", "prescreva", "1"), ("c", " ", None), ("d", "ok?", "9")], "trace_id string, question string, patient_id string")
    patients = spark.createDataFrame([("1", "ctx")], "patient_id string, patient_context string")
    protocols = spark.createDataFrame([("a", ["p"]), ("b", ["p"])], "trace_id string, sources array<string>")
    verdicts = spark.createDataFrame([("b", "approved")], "trace_id string, verdict string")
    done = {r["trace_id"]: r for r in flow.run(asked, patients, protocols, verdicts).collect()}
    assert done["a"]["response"] == "Sources: p" and done["a"]["verdict"] == "not_needed"
    assert done["b"]["requires_human_review"] and done["b"]["response"] == "Sources: p"
    assert done["c"]["route"] == "invalid" and done["c"]["response"] is None
    assert done["d"]["fallback"] == "no_context" and done["d"]["verdict"] == "pending"
    assert evaluate.missing_steps(flow.run(asked, patients, protocols), ["format_response"]).count() == 0
    events = flow.audit_log(flow.run(asked, patients, protocols))
    assert "patient_id" not in events.columns and events.count() == 4


def test_settings_keep_an_empty_variable(monkeypatch):
    monkeypatch.setenv("CAREFLOW_ENV", "")
    monkeypatch.delenv("CAREFLOW_DATA_DIR", raising=False)
    s = Settings()
    assert s.environment == "" and str(s.data_dir) == "data"


def test_intervals_do_not_depend_on_partitions_and_hold_the_mean(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(a + 0.2 + d)) for i, (a, d) in enumerate(rng.normal(size=(400, 2)))] + [(900, None, 1.0), (901, 1.0, None)]
    df = spark.createDataFrame(rows, "q long, a double, b double")
    one, two = (evaluate.paired_difference(df.repartition(n), "q", "a", "b").first() for n in (1, 7))
    assert one.asDict() == two.asDict() and one["n"] == 400 and one["low"] < one["difference"] < one["high"]
    d = np.array([b - a for _, a, b in rows[:400]])
    assert abs((one["high"] - one["low"]) - 2 * 1.96 * d.std() / 20) < 0.25 * (one["high"] - one["low"])
    assert evaluate.paired_difference(df.limit(0), "q", "a", "b").first()["n"] == 0


def test_cube_and_its_sketch(spark):
    rows = spark.range(20_000).selectExpr("id % 2 as a", "id % 3 as b", "id % 5 = 0 as ok", "id % 7000 as x")
    got = {(r["a"], r["b"]): r for r in evaluate.metric_cube(rows, ["a", "b"], evaluate.F.col("ok"), "x").collect()}
    assert len(got) == 12 and got[None, None]["n"] == 20_000 and got[None, None]["grouping"] == 3 and got[0, None]["grouping"] == 1 and got[None, None]["accuracy"] == 0.2
    assert abs(got[None, None]["n_distinct"] / 7000 - 1) < 0.05


def test_two_labels_of_one_id(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "x" * 60), (3, "x" * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None)], "doc_id long, quality int")
    assert sorted(r["doc_id"] for r in curate.valid(docs, labels).collect()) == [1, 3]


def test_masks_take_time_in_proportion(spark):
    import time

    def seconds(n):
        began = time.perf_counter()
        got = curate.masked(spark.createDataFrame([("a" * n + " x.y@z.org,a@b.c-d@e.fr " + "9" * n,)], "text string")).first()["text"]
        assert got == "a" * n + " <email>,a@b.c-<email> " + "9" * n or got.count("<email>") == 2
        return time.perf_counter() - began

    seconds(10)
    assert seconds(400_000) < 20
