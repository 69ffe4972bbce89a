import collections
import os

import pytest

import corpus_pipeline
from careflow.llm import mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.common.table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stash(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4]
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == counts[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_each_stage_equals_a_plain_version(spark):
    """Quality and toxicity against their operators (which have plain twins of their own), the rest against brute force."""
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from careflow.llm import bpe, quality, toxicity
    from test_minhash import brute

    read, write = lambda df: {r["doc_id"]: r for r in df.collect()}, lambda df: corpus_pipeline.common.stash(df, "test")
    docs = corpus_pipeline.common.table(spark, SF, "documents")
    clean = write(corpus_pipeline.keep_quality(spark, docs, SF))
    assert read(clean).keys() == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    civil = write(corpus_pipeline.keep_civil(spark, clean, SF))
    labels = corpus_pipeline.common.table(spark, SF, "labels")
    assert read(civil).keys() == {r["doc_id"] for r in toxicity.score(clean, labels).filter("predicted = 0").collect()}
    distinct = write(corpus_pipeline.keep_distinct(spark, civil, SF))
    groups = brute([(r["doc_id"], r["text"]) for r in civil.collect()], 5, 80)
    assert read(distinct).keys() == {d for d, n, least, kept in groups if kept}
    mixed = write(corpus_pipeline.mix_sources(spark, distinct, SF))
    assert read(mixed) == read(distinct)
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.encoding(P.path(bpe.RANKS), P.PATTERN)._mergeable_ranks, special_tokens={})
    last = read(corpus_pipeline.encode(spark, mixed, SF))
    assert last.keys() == read(mixed).keys()
    for d, r in read(mixed).items():
        ids = plain.encode_ordinary(r["text"] or "")
        raw = (r["text"] or "").encode()
        assert (last[d]["n_tokens"], last[d]["ids_sha256"], last[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_rows_have_their_place_in_the_mixture(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in corpus_pipeline.common.table(spark, SF, "documents").collect()}
    counts = collections.Counter(source[r["doc_id"]] for r in got)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in counts.items()}
    want = [(slot, place, s) for s, k, slot, _, _ in mixing.blocks_in_order(mixing.exact({s: n**0.5 for s, n in counts.items()}), blocks) for place in range(min(mixing.BLOCK, counts[s] - k * mixing.BLOCK))]
    # Sources are ordered under a prefix of "=" in mix(), which keeps their order.
    assert sorted((r["slot"], r["place"], source[r["doc_id"]]) for r in got) == sorted(want)


def test_stages_on_an_empty_table(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_a_lazy_result_outlives_another_stage_and_a_run_leaves_its_rows_only(spark):
    docs = corpus_pipeline.common.table(spark, SF, "documents")
    a, b = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    first = corpus_pipeline.mix_sources(spark, a, SF).select("doc_id")
    second = corpus_pipeline.keep_distinct(spark, b, SF)
    assert second.count() and {r[0] for r in first.collect()} == {r[0] for r in a.select("doc_id").collect()}
    folder = corpus_pipeline.common.shared_dir(spark)
    held = set(os.listdir(folder))
    derived = second.filter("doc_id > 10").select("doc_id")
    del first, second
    corpus_pipeline.common.sweep(spark)
    freed = held - set(os.listdir(folder))
    n = derived.count()
    assert freed and n
    del derived
    corpus_pipeline.common.sweep(spark)
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) & held}
    assert held - set(os.listdir(folder)) > freed, left
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF)
    assert {x.partition("-")[0] for x in set(os.listdir(folder)) - before} == {"pipeline"} and len(set(os.listdir(folder)) - before) == 1
    assert got.count()
