import random

import numpy as np
import pytest

from careflow.llm import minhash, sketch
from careflow.llm.components import connected

KIND = "doc_id long, text string"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent, ids_link=True):
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if (a and b and 100 * len(a & b) >= percent * len(a | b)) or (ids_link and sets[i][0] is not None and sets[i][0] == sets[j][0]):
                up[root(i)] = root(j)
    if not ids_link:
        return [root(i) if s else None for i, (_, s) in enumerate(sets)]
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)), d == least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One two"), (6, "one"), (None, "one two"), (7, "one two three"), (7, "zz yy xx ww"), (None, "only here"), (6, "aa bb cc dd ee"), (7, "AA bb cc dd ee"), (8, "zz yy xx ww")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(60):
        x = list(base)
        for _ in range(i % 6):
            x[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(x)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(20)]
    rows += [(500 + i, rows[30][1].upper()) for i in range(5)]
    return rows + [(900, " ".join(rng.choice(words) for _ in range(20_000)))]


@pytest.mark.parametrize("width,percent,block", [(3, 85, 16), (5, 80, 256)])
def test_components_equal_brute_force(spark, with_clashes, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(5))
    assert sorted(map(tuple, minhash.near_duplicates(df, width, percent).collect()), key=str) == brute(rows, width, percent)


def test_one_of_each_group_stays(spark, with_clashes):
    rows = corpus() + [(None, "only here"), (1, None), (7, "one two three"), (400, "one two three")] + [(None, rows_text) for rows_text in ("q r s t u v", "q R s t u v")]
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(3))
    kept = minhash.keep_distinct(df, 5, 80)
    group = brute(rows, 5, 80, ids_link=False)
    first = {}
    for g, (d, t) in zip(group, rows):
        if g is not None:
            first[g] = min(first.get(g, (True, 0)), (d is None, d or 0))
    want = sorted([str(None if nameless else d) for nameless, d in first.values()] + [str(d) for g, (d, _) in zip(group, rows) if g is None])
    got = kept.collect()
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in got) == want
    assert all((r["doc_id"], r["text"]) in set(rows) for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_distinct(empty).count() == 0


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for size in (3, 40, 2000):
        for share in (0.5, 0.9):
            both = int(size * share)
            a, b = base[:size], np.concatenate([base[:both], base[size : 2 * size - both]])
            s = sketch.fast_sketch([np.unique(a), np.unique(b)], 2000)
            true = both / (2 * size - both)
            assert abs((s[0] == s[1]).mean() - true) < 0.06


def test_bands_miss_almost_nothing():
    for percent in (80, 85):
        n, least = minhash.plan(percent)
        assert (1 - (percent / 100) ** minhash.ROWS) ** n <= minhash.MISS and least < percent / 100


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 9), (7, 7), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got[3] == 1 and got[9] == 8 and got[7] == 7 and got[140] == 100 and 4 not in got


def test_components_with_a_large_centre(spark, monkeypatch):
    monkeypatch.setattr("careflow.llm.components.CENTRE", 5)
    rng = random.Random(5)
    links = [(50, i) for i in range(300, 900)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)] + [(20, 880), (50, 2999)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: root(n) for n in up}
