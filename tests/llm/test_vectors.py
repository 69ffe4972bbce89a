import math

import numpy as np
import pytest

from careflow.llm import ego

KIND = "vec_id long, embedding array<double>, label int"


def table():
    rng = np.random.default_rng(0)
    rows, c = [], rng.normal(size=(6, 8))
    for i in range(400):
        v = c[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])
        rows.append((i + 1, [float(x) for x in v], int(i % 3) if i % 50 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, float("nan")] + [0.0] * 6, 1), (1003, [1.0, None] + [1.0] * 6, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [1e200, 2e200], 1), (1008, [float("inf"), 1.0], 1)]
    return rows + [(2000 + i, rows[5][1], rows[5][2]) for i in range(5)]


def brute(rows, cosine=0.93):
    fine = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    n, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[2] is not None and a[2] == b[2] and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = root(a[0]), root(b[0])
                    up[max(p, q)] = min(p, q)
    return sorted((r[0], n[r[0]], root(r[0]), root(r[0]) == r[0]) for r in rows)


@pytest.mark.parametrize("block,leaf", [(512, 64), (16, 4)])
def test_links_and_components_equal_brute_force(spark, with_clashes, monkeypatch, block, leaf):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "LEAF", leaf)
    monkeypatch.setattr(ego, "HELD", 10 * block)
    rows = table()
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(4))
    assert sorted(map(tuple, ego.near_vectors(df).collect())) == brute(rows)


def test_a_large_group_of_equal_vectors_and_ids_with_several(spark):
    rng = np.random.default_rng(4)
    a, b, c = ([float(x) for x in rng.normal(size=8)] for _ in range(3))
    near = [x + 1e-3 for x in a]
    rows = [(i, a, 1) for i in range(3_000)] + [(5_000 + i, near, 1) for i in range(40)] + [(9_000, b, 1), (9_001, c, 1), (9_001, b, 1), (9_002, c, 2), (9_003, [2 * x for x in c], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in ego.near_vectors(spark.createDataFrame(rows, KIND).repartition(6)).collect()}
    assert got[0] == (3_039, 0, True) and got[2_999] == (3_039, 0, False) and got[5_039] == (3_039, 0, False)
    assert got[9_000] == (1, 9_000, True) and got[9_001] == (2, 9_000, False) and got[9_002] == (0, 9_002, True) and got[9_003] == (1, 9_000, False)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], KIND)
    assert ego.near_vectors(df.limit(0)).count() == 0
    assert sorted(map(tuple, ego.near_vectors(df).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


def test_labels_that_round_alike_stay_apart(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i % 20]], 2**53 + i // 20) for i in range(60)]
    got = ego.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
