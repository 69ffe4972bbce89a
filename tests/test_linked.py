import random

import pytest

from careflow.operators import linked

KIND = "doc_id long, grp string, text string"


def plain(rows):
    import hashlib

    digest = lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest()
    own = {i: g if g is not None else "text:" + digest(t) for i, g, t in rows}
    up = {g: g for g in own.values()}

    def root(g):
        while up[g] != g:
            g = up[g]
        return g

    first = {}
    for i, _, t in rows:
        if t is not None:
            a, b = root(own[i]), root(own[first.setdefault(t, i)])
            up[max(a, b)] = min(a, b)
    return {i: root(own[i]) for i, _, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_crosses_a_split(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None] + [f"g{k}" for k in range(60)] * 2), rng.choice([None, ""] + [f"t{i}"] * 12 + [f"s{k}" for k in range(12)])) for i in range(220)]
    rows += [(1000 + i, f"chain{i:02}", f"link{i // 2}") for i in range(40)] + [(2000 + i, f"chain{i:02}", f"knil{(i + 1) // 2}") for i in range(40)]  # a long path
    rows += [(3000 + i, "hot", f"own{i}") for i in range(300)]
    got = {r["doc_id"]: (r["component"], r["split"]) for r in linked.linked_split(spark.createDataFrame(rows, KIND).repartition(4), "grp", "text").collect()}
    want = plain(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    texts = {}
    for i, _, t in rows:
        if t is not None:
            assert texts.setdefault(t, got[i][1]) == got[i][1]


def test_empty_and_without_links(spark):
    none = spark.createDataFrame([], KIND)
    assert linked.linked_split(none, "grp", "text").count() == 0
    one = linked.linked_split(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, None)], KIND), "grp", "text")
    assert {r["doc_id"]: r["component"] for r in one.collect()} == {1: "a", 2: "b", 3: "text:"}
