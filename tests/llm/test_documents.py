"""Quality, toxicity, language model and mixing."""

import collections
import math
import random
import re

import numpy as np
import pytest

from careflow.llm import brown, mixing, quality, toxicity
from careflow.llm.common import crc_mod_py

KIND = "doc_id long, text string, lang string, source string"


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


EDGES = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "a b c a b c d", "en", None), (3, "x\n\nx\n x\nx y", "en", "a"), (None, "a a a a a # $", "de", "a"), (5, "one two three four one two three five two three four", "en", "a"),
    (6, "é\x0bü\x1cq  |x|", "en", "a"), (7, "w " * 30_000, "en", "a"), (8, " ".join(f"w{i}" for i in range(60)), "en", "a"), (8, " ".join(f"w{i}" for i in range(60)), "en", "a"),
]


def test_base_rules_equal_a_plain_version(spark, with_clashes):
    df = with_clashes(spark.createDataFrame(EDGES, KIND).repartition(3))
    got = sorted((tuple(r)[:7] for r in quality.judge(df).collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t, _, _ in EDGES), key=str)
    assert quality.judge(df.limit(0)).count() == 0
    kept = quality.keep_clean(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [8, 8]


def mixed(n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        if i % 20 == 0:
            w = [x + "#$%" for x in w]
        rows.append((i, " ".join(w), "en", "big" if i % 3 else "small"))
    return rows


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(mixed(), KIND)).collect()}
    assert all(got[i] == bool(i % 20) for i in got)


def plain_estimate(groups):
    """Concentration steps and the pooling of moments in numpy; ``groups``: (lang, source) to rows. Quantiles are exact at this size."""
    floors = np.array(list(quality.FLOORS.values()))
    low = lambda v, q: np.sort(v)[math.ceil(q * len(v)) - 1]
    dist = {}
    for g, x in groups.items():
        med = np.array([low(x[:, i], 0.5) for i in range(5)])
        mad = np.array([low(np.abs(x[:, i] - med[i]), 0.5) for i in range(5)])
        dist[g] = (((x - med) / np.maximum(1.4826 * mad, floors)) ** 2).sum(axis=1)
    for _ in range(quality.STEPS + 1):
        near = {g: x[dist[g] <= low(dist[g], quality.COVER)] for g, x in groups.items()}
        sums = {g: np.concatenate([x.sum(axis=0), (x.T @ x).ravel()]) for g, x in near.items()}
        every = sum(sums.values()) / sum(map(len, near.values()))
        out = {}
        for g, x in groups.items():
            own = [h for h in groups if h[0] == g[0]]
            lang = (sum(sums[h] for h in own) + quality.PRIOR * every) / (sum(len(near[h]) for h in own) + quality.PRIOR)
            m = (sums[g] + quality.PRIOR * lang) / (len(near[g]) + quality.PRIOR)
            mean, cov = m[:5], (m[5:].reshape(5, 5) - np.outer(m[:5], m[:5])) * quality.CONSISTENCY + np.diag(floors**2)
            out[g] = mean, cov
            dist[g] = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    return out, dist


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(1)
    names = list(quality.FLOORS)
    groups = {("l", "s"): 500, ("l", "t"): 7, ("m", "s"): 1, ("m", "t"): 60}
    groups = {g: rng.normal(size=(n, 5)) * [1, 0.2, 0.3, 0.4, 0.5] + i for i, (g, n) in enumerate(groups.items())}
    groups["l", "s"][:40] += 9
    rows = spark.createDataFrame([(*g, *map(float, r)) for g, x in groups.items() for r in x], "g_lang string, g_source string, " + ", ".join(f"{c} double" for c in names))
    want, _ = plain_estimate(groups)
    got = quality.estimate(rows).collect()
    assert len(got) == 4
    for r in got:
        mean, cov = want[r["g_lang"], r["g_source"]]
        assert np.allclose([r[f"m{i}"] for i in range(5)], mean)
        assert np.allclose(np.linalg.cholesky(cov)[4], [r[f"l4{j}"] for j in range(5)])


def test_verdicts_equal_numpy_and_cover_every_document(spark):
    rows = mixed(120) + [(1000 + i, t, "de", f"s{i % 9}") for i, (_, t, _, _) in enumerate(mixed(30))] + [(2000, mixed(2)[1][1], "fr", "alone")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, KIND)).collect()}
    groups = {}
    for d, t, lang, source in rows:
        n, chars, symbols, lines, repeats, failed = base(t)
        if not failed:
            groups.setdefault((lang, source), []).append((d, [math.log(n), math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(lines / n), math.sqrt(repeats / n)]))
    _, dist = plain_estimate({g: np.array([x for _, x in v]) for g, v in groups.items()})
    for g, v in groups.items():
        for (d, _), d2 in zip(v, dist[g]):
            assert got[d]["distance"] == pytest.approx(d2, rel=1e-6) and got[d]["kept"] == (d2 <= quality.CUTOFF)
    assert all(r["distance"] is not None for r in got.values() if not r["base_failed"])


def test_quality_plan_has_no_python(spark):
    plan = quality.judge(spark.createDataFrame(EDGES[:3], KIND))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def toxic_corpus(n=900):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "zork" + rng.choice("abcdefgh"))
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_toxicity(spark, with_clashes):
    rows, labels = toxic_corpus()
    rows += [(5000, None, "en", "a"), (5001, "", "en", "a"), (None, "zorka", "en", "a"), (None, "x", None, None)]
    docs = with_clashes(spark.createDataFrame(rows, KIND).repartition(3))
    marks = with_clashes(spark.createDataFrame(labels + [(None, 1, 1), (7777, 1, None)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (crc_mod_py(r["doc_id"], 5) == 0) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) >= 0.97 and np.mean([b for a, b in held if a]) >= 0.9
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001)} == {0}
    kept = toxicity.keep_civil(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_toxicity_equals_a_plain_version(spark):
    rows, labels = toxic_corpus(300)
    rows += [(9000, "w " * 30_000, "en", "a"), (9000, "other text of the id", "en", "a"), (9001, "Ärger! it's A-B", "en", "a")]
    truth = {d: t for d, _, t in labels}
    words = lambda t: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w]
    train = [(words(t), truth[d]) for d, t, _, _ in rows if d in truth and crc_mod_py(d, 5)]
    n = [collections.Counter(w for ws, t in train if t == k for w in set(ws)) for k in (0, 1)]
    pairs = {(a, b) for ws, _ in train for a, b in zip(["^", *ws], ws)}
    after = collections.Counter(b for _, b in pairs)
    kinds, total = len(after), sum(after.values())

    def discount(k, c):
        of = collections.Counter(n[k].values())
        if not (of[1] and of[2]):
            return [0, 0.75, 0.75, 0.75][min(c, 3)]
        y, c = of[1] / (of[1] + 2 * of[2]), min(c, 3)
        return 0 if not c else min(max(c - (c + 1) * y * of[c + 1] / of[c], 0), c) if of[c] and of[c + 1] else 0.75

    free = [sum(discount(k, c) for c in n[k].values()) / sum(n[k].values()) for k in (0, 1)]

    def ratio(w, without=None):
        if w not in after:
            return 0.0
        shared, out = (max(after[w] - 0.75, 0) + 0.75 * kinds / (kinds + 1)) / total, []
        for k in (0, 1):
            c = n[k][w] - (without == k)
            out.append((max(c - discount(k, c), 0) / sum(n[k].values()) + free[k] * shared) / free[k])
        return math.log(out[1] / out[0])

    def plain(ws, without=None):
        x = [ratio(w, without) for w in ws]
        if not x:
            return [0.0] * 11
        highest = [max(sum(x[i : i + k]) / k for i in range(len(x) - k + 1)) for k in (min(k, len(x)) for k in toxicity.WINDOWS)]
        most = sorted([*(ratio(w, without) for w in set(ws) if w in after), *[0.0] * 10], reverse=True)
        return [sum(x) / len(x), sum(x) / math.sqrt(len(x)), *highest, *(sum(most[:k]) / k for k in toxicity.TOP), math.log1p(len(x))]

    curve = toxicity.fit_curve(np.array([plain(ws, t) for ws, t in train]), np.array([t for _, t in train], float), np.ones(len(train)))
    usual = math.log(sum(truth[d] for d in truth if crc_mod_py(d, 5)) / sum(1 - truth[d] for d in truth if crc_mod_py(d, 5)))
    logit = lambda f: float(np.dot(f, curve[:-1]) + curve[-1]) if any(f[:-1]) else usual
    want = sorted((d, 1 / (1 + math.exp(-logit(plain(words(t)))))) for d, t, _, _ in rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(spark.createDataFrame(rows, KIND).repartition(3), marks).collect())
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-3)


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "a")], KIND)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs, none).collect()] == [0]
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.keep_civil(docs, none).count() == 1


def test_language_model(spark, with_clashes, monkeypatch):
    rng = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(w for _ in range(60) for w in ("the", rng.choice(nouns), rng.choice(verbs))), None, None) for i in range(120)]
    rows += [(None, None, None, None), (7777, "The the THE zzz", None, None), (7777, "", None, None), (8, "word " * 20_000, None, None)]
    count = collections.Counter()
    for d, t, _, _ in rows:
        if crc_mod_py(d, 7) != 2:
            count.update([*(t or "").encode().lower().split(), "END"])
    n, v, want = sum(count.values()), len(count), []
    for d, t, _, _ in rows:
        w = [*(t or "").encode().lower().split(), "END"]
        want.append((d, crc_mod_py(d, 7) == 2, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)))
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(4))
    for known in (0, 30, 250_000):
        monkeypatch.setattr(brown, "KNOWN", known)
        got = brown.score(df).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 4)) for r in got), key=str) == sorted(want, key=str)
    held = [(r["score"], r["base_score"]) for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert held and all(a > b for a, b in held)
    assert brown.score(df.limit(0)).count() == 0


def test_language_model_equals_a_plain_version(spark, monkeypatch):
    """Everything but the exchange among the core (tested below) in plain loops; KNOWN changes nothing."""
    import pyarrow as pa

    from careflow.llm.words import hash_words

    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "CLASSES", 5)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.08)), 79)] for _ in range(rng.randint(0, 60))) + (f" only{i}" if i % 3 else f" twice{i // 2} new{i} new{i}")) for i in range(70)] + [(500, None), (501, "")]
    split = lambda t: (t or "").encode().lower().split()
    train = [split(t) for d, t in rows if crc_mod_py(d, 7) != 2]
    n = collections.Counter(w for ws in train for w in ws)
    number = dict(zip(n, hash_words(pa.array([w.decode() for w in n]))[0].tolist()))
    signed = lambda w: number[w] - (1 << 64) * (number[w] >> 63)
    core = sorted(sorted(n, key=lambda w: (-n[w], signed(w)))[:12], key=number.get)
    unit = {w: i for i, w in enumerate(core)}
    table = np.zeros((14, 14), np.int64)
    for ws in train:
        u = [13, *(unit.get(w, 12) for w in ws), 13]
        for a, b in zip(u, u[1:]):
            table[a, b] += 1
    of = brown.exchange(table, 7)
    kind = {w: int(of[i]) for w, i in unit.items()}
    coarse = np.zeros((7, 7))
    for a in range(14):
        for b in range(14):
            coarse[of[a], of[b]] += table[a, b]
    logs, gains = brown.transitions(coarse), {w: np.zeros(5) for w in n if w not in unit}
    for ws in train:
        c = [6, *(kind[w] if w in unit else 5 for w in ws), 6]
        for i, w in enumerate(ws, 1):
            if w not in unit:
                gains[w] += logs[c[i - 1], :5] + logs[:5, c[i + 1]] - np.log10(np.maximum(coarse.sum(axis=0)[:5], 1))
    kind |= {w: int(np.argmax(np.round(g, 5))) for w, g in gains.items()}
    n_of, kinds_of = np.zeros(5), np.zeros(5)
    for w, c in kind.items():
        n_of[c] += n[w]
        kinds_of[c] += 1
    pairs = np.zeros((6, 6))
    for ws in train:
        u = ["", *ws, ""]
        for a, b in zip(u, u[1:]):
            pairs[kind.get(a, 5), kind.get(b, 5)] += 1
    step = 10 ** brown.transitions(pairs)
    free = [0.75 * kinds_of[c] / n_of[c] if n_of[c] else 1.0 for c in range(5)]
    like = kinds_of / kinds_of.sum()
    after = lambda a: step[a] if a is not None else sum(like[c] * step[c] for c in range(5))  # noqa: E731  None: the unseen type
    want = {}
    for d, t in rows:
        total, a = 0.0, 5
        for w in [*split(t), ""]:
            row = after(a)
            if w and w not in n:
                total, a = total + math.log10(sum(row[c] * free[c] for c in range(5))), None
            else:
                a = kind[w] if w else 5
                total += math.log10(row[a]) + (math.log10((n[w] - 0.75) / n_of[a]) if w else 0)
        want[d] = total
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for known in (0, 25, 250_000):
        monkeypatch.setattr(brown, "KNOWN", known)
        got = {r["doc_id"]: r["score"] for r in brown.score(df).collect()}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-5) for d in want)
    # The chances of all words, the unseen type and the end sum to one after any class.
    full = 10 ** brown.with_unseen(brown.transitions(pairs), n_of, kinds_of)
    seen = np.array([1 - 0.75 * k / m if m else 0.0 for k, m in zip(kinds_of, n_of)])
    assert np.allclose(full[:, :5] @ seen + full[:, 5] + full[:, 6], 1)


def test_exchange_finds_classes_and_never_lowers_the_likelihood():
    counts = np.zeros((14, 14))
    counts[:6, 6:12] = 50  # six words are always followed by one of six others
    counts[6:12, :6] = 50
    counts[13, :6] = 5
    of = brown.exchange(counts, classes=4)
    assert len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6] and of[12] == 2 and of[13] == 3


def test_transitions_are_distributions():
    table = np.random.default_rng(0).poisson(0.7, (9, 9)) * np.arange(9)[:, None]
    assert np.allclose((10 ** brown.transitions(table.astype(float))).sum(axis=1), 1)


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.9, "b": 0.1}, {"hot": 0.9} | {f"s{i}": 0.1 / 19 for i in range(19)}, {"hot": 0.9} | {f"s{i}": 0.1 / 249 for i in range(249)}, {f"s{i}": 1.0 + i**2 for i in range(250)}])
def test_schedule_deviates_by_less_than_a_block_from_the_target_weights(weights):
    total, seen = sum(weights.values()), collections.Counter()
    blocks = {s: int(9_000 * w / total) + 1 for s, w in weights.items()}
    for n, (s, k, slot, release, due) in enumerate(mixing.blocks_in_order(mixing.exact(weights), blocks)):
        assert k == seen[s] and release <= slot < due
        seen[s] += 1
        if n % 53 == 0 and n < 8_000:
            assert all(abs(seen[x] - w / total * (slot + 1)) < 1 + 1e-9 for x, w in weights.items() if seen[x] < blocks[x])
    assert seen == blocks


def test_mixing(spark, with_clashes):
    rng = random.Random(7)
    rows = [(i, f"t{i}", "en", rng.choice(["big"] * 6 + ["mid"] * 2 + ["low", None])) for i in range(3000)] + [(5, "again", "en", "big"), (None, "n", "en", "low")]
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(5))
    got = mixing.mix(df, block=4).collect()
    assert sorted(str(r["mixed_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    slots = sorted({(r["slot"], r["mixed_source"], r["block"]) for r in got}, key=lambda x: x[0])
    assert len({s for s, _, _ in slots}) == len(slots)
    out = mixing.in_order(df, block=4)
    assert out.columns == df.columns and out.count() == len(rows)
    order = [r["text"] for r in out.collect()]
    place = {(r["slot"], r["place"]): r["mixed_source"] for r in got}
    sources = {t: s for _, t, _, s in rows}
    assert [sources[t] for t in order] == [place[k] for k in sorted(place)]
    assert mixing.mix(df.limit(0)).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("MapInArrow|FlatMapGroups|EvalPython", plan)


def test_the_deviation_from_the_weights_does_not_grow(spark):
    """Over many times 1,000 slots, against the weights themselves."""
    weights = {"hot": (1 / 3) ** 0.5} | {f"s{i}": (2 / 3 / 19) ** 0.5 for i in range(19)}
    total, seen = sum(weights.values()), collections.Counter()
    blocks = {s: int(30_000 * w / total) for s, w in weights.items()}
    for s, k, slot, release, due in mixing.blocks_in_order(mixing.exact(weights), blocks):
        assert k == seen[s] and release <= slot < due
        seen[s] += 1
        if slot % 97 == 0:
            assert all(abs(seen[x] - w / total * (slot + 1)) < 1 for x, w in weights.items() if seen[x] < blocks[x])
    assert seen == blocks
    # The rows of mix() have the same times, also of a source without weight, which stands last.
    df = spark.createDataFrame([(i, "t", "en", "abcz"[min(i % 7, 3)]) for i in range(14_000)], KIND)
    weights = {"a": 0.13961, "b": 0.2, "c": 0.66039, "z": 0}
    got = mixing.mix(df, weights, block=1).collect()
    assert len({r["slot"] for r in got}) == len(got) == 14_000
    w = lambda r: weights[r["mixed_source"]]
    assert all(r["release"] <= r["slot"] < r["deadline"] and (not w(r) or abs(r["block"] + 0.5 - w(r) * (r["slot"] + 0.5)) < 1.5) for r in got)
    assert max(r["slot"] for r in got if w(r)) < min(r["slot"] for r in got if not w(r))


def test_rows_follow_a_plain_schedule(spark):
    """Earliest deadline first over the released blocks, searched slot by slot; of given weights only those that are named count."""
    from fractions import Fraction

    sizes = {"a": 50, "b": 23, "c": 9, None: 4, "unnamed": 6}
    df = spark.createDataFrame([(i, "t", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], KIND)
    weights = {"a": 0.5, "b": 0.25, "c": 0.2, None: 0.05}
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    done, want, slot = collections.Counter(), {}, 0
    left = {s: -(-sizes[s] // 4) for s in weights}
    while any(left.values()):
        ready = [(math.ceil((done[s] + 1) / share[s]), "null" if s is None else f"={s}", s) for s in weights if left[s] and math.floor(done[s] / share[s]) <= slot]
        if ready:
            s = min(ready, key=lambda r: r[:2])[2]
            want[s, done[s]] = slot
            done[s] += 1
            left[s] -= 1
        slot += 1
    got = {(r["mixed_source"], r["block"]): r["slot"] for r in mixing.mix(df, weights, block=4).collect()}
    assert {k: v for k, v in got.items() if k[0] != "unnamed"} == want
    assert min(v for k, v in got.items() if k[0] == "unnamed") > max(want.values())


def test_many_sources(spark):
    df = spark.createDataFrame([(i, "t", "en", f"s{i % 300}") for i in range(900)] + [(None, f"n{i}", "en", "s1") for i in range(40)], KIND)
    assert mixing.mix(df, block=1, carry=["text"]).select("slot").distinct().count() == 940


def test_exchange_ends_where_no_single_move_helps():
    """The likelihood of class bigrams by its definition, for the result and for every move of one unit."""
    rng = np.random.default_rng(11)
    for _ in range(5):
        free, fixed, classes = 14, brown.FIXED, 4 + brown.FIXED
        size = free + fixed
        counts = rng.poisson(rng.gamma(0.5, 6, size=(size, size)))

        def likelihood(of):
            table = np.zeros((classes, classes))
            for i in range(size):
                for k in range(size):
                    table[of[i], of[k]] += counts[i, k]  # noqa: B023
            total, rows, cols = table.sum(), table.sum(axis=1), table.sum(axis=0)
            # log P(class | class before) + log P(unit | class), up to what the units' own counts add
            return sum(table[a, b] * (np.log(table[a, b]) - np.log(rows[a]) - np.log(cols[b])) for a in range(classes) for b in range(classes) if table[a, b]) + 0 * total

        of = brown.exchange(counts, classes, passes=100)
        best = likelihood(of)
        assert list(of[free:]) == list(range(classes - fixed, classes))
        for u in range(free):
            for c in range(classes - fixed):
                moved = of.copy()
                moved[u] = c
                assert likelihood(moved) <= best + 1e-6
