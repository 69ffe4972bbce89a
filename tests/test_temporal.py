import datetime
import random

import pytest

from careflow.operators import temporal

T0 = datetime.datetime(2026, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + datetime.timedelta(minutes=minutes)


def data(seed=1, n=400, hot=0.5):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
    left = [(i, key(), at(rng.choice([None] + list(range(200)) * 2))) for i in range(n)]
    right = [(i, key(), at(rng.choice([None] + list(range(-10, 220, 3)) * 2)), rng.choice([f"v{i}", None])) for i in range(n)]
    return left, right


@pytest.mark.parametrize("hot", [temporal.HOT, 30])
@pytest.mark.parametrize("within", [None, 5])
def test_as_of_equals_a_search(spark, monkeypatch, hot, within):
    monkeypatch.setattr(temporal, "HOT", hot)
    left, right = data()
    left += left[:5]
    want = []
    for i, k, t in left:
        found = [(s, j, v) for j, q, s, v in right if q == k and k is not None and t is not None and s is not None and s <= t]
        best = max(found, key=lambda x: x[:2], default=None)
        if best and within is not None and t - best[0] > datetime.timedelta(minutes=within):
            best = None
        want.append((i, k, t, best and best[1], best and best[2]))
    a = spark.createDataFrame(left, "i long, k string, t timestamp").repartition(3)
    b = spark.createDataFrame(right, "j long, k string, s timestamp, v string").repartition(3)
    got = temporal.as_of(a, b, ["k"], "t", "s", ["j", "v"], ["j"], within and within * 60_000_000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert temporal.as_of(a, b.limit(0), ["k"], "t", "s", ["j"], ["j"]).filter("j is null").count() == len(left)
    assert temporal.as_of(a.limit(0), b, ["k"], "t", "s", ["j"], ["j"]).count() == 0


@pytest.mark.parametrize("crowd", [temporal.CROWD, 10])
def test_overlaps_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(temporal, "CROWD", crowd)
    rng = random.Random(3)
    span = lambda: (lambda s: (s, s and at(rng.randrange(200)) if rng.random() < 0.1 else s and s + datetime.timedelta(minutes=rng.choice([0, 1, 5, 90]))))(at(rng.choice([None] + list(range(200)))))
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("abc") if rng.random() < 0.9 else None
    a = [(i, key(), *span()) for i in range(150)]
    b = [(i, key(), *span()) for i in range(150)]
    ok = lambda s, e: s is not None and e is not None and s < e
    want = sorted((i, j) for i, k, s, e in a for j, q, u, w in b if k is not None and k == q and ok(s, e) and ok(u, w) and s < w and u < e)
    x = spark.createDataFrame(a, "i long, k string, s timestamp, e timestamp").repartition(3)
    y = spark.createDataFrame(b, "j long, k string, u timestamp, w timestamp").repartition(3)
    got = temporal.overlaps(x, y, ["k"], ("s", "e"), ("u", "w"), 20 * 60_000_000)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def plain_sessions(rows, gap):
    out = []
    for k in {k for k, t in rows if k is not None}:
        times = sorted(t for q, t in rows if q == k and t is not None)
        for t in times:
            if out and out[-1][0] == k and t - out[-1][2] <= gap:
                out[-1][2:] = [t, out[-1][3] + 1]
            else:
                out.append([k, t, t, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("hot", [temporal.HOT, 20])
def test_sessions_equal_a_scan(spark, monkeypatch, hot):
    monkeypatch.setattr(temporal, "HOT", hot)
    rows = [(k, t) for _, k, t in data(7, 120)[0]]
    got = temporal.sessions(spark.createDataFrame(rows, "k string, t timestamp").repartition(3), "k", "t", 2 * 60_000_000)
    assert sorted(map(tuple, got.collect())) == plain_sessions(rows, datetime.timedelta(minutes=2))
