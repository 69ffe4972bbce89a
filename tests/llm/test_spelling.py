import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from careflow.llm import spelling
from careflow.llm.wavelet import WaveletTree

KIND = "doc_id long, text string"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w):
    """All words at one edit."""
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in LETTERS} | {a + c + b for a, b in cut for c in LETTERS}) - {w}


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = [], {}
    close = {w: [x for x in (edits(w) if len(w) < 100 else [x for x in n if abs(len(x) - len(w)) < 2 and x != w and w in edits(x)]) if x in n] for w in n}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([5, 5, 6, 7, 9, 12]))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "straße", "strasse", "naïve×", "ÀÉÎõü", "z" * 300, "z" * 299, "z" * 150 + "y" + "z" * 149]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 4, 9, 30])
        for _ in range(6):
            k, c = rng.randrange(len(w)), rng.choice("abcéA")
            words += [rng.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])] * rng.choice([1, 3, 5, 7, 60])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "3", "\n", "中", "\U0001f600"]).join(words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    return rows + [(None, "hello hello hello hellos hellos hellos hallo"), (7, None), (8, ""), (9, "1234 ..."), (10, "Hello" * 3000), (10, "Hello" * 3000), (11, "Hello" * 3000)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("big", [spelling.BIG, 40, 7])
def test_equals_all_edits_of_all_words(spark, with_clashes, big):
    df = with_clashes(spark.createDataFrame(corpus(), KIND).repartition(5)).withColumns({n: spelling.F.lit(1) for n in ("word", "n", "id", "g", "blocks", "form", "root")})
    assert got(spelling.variants(df, big=big)) == brute(corpus())


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], KIND)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a bc"), (None, "words words")], KIND)).count() == 0


@pytest.mark.parametrize("m", [0, 1, 2, 3, 100, 1000])
def test_tree_reports_what_is_in_the_ranges(m):
    rng = np.random.default_rng(m)
    values = rng.permutation(m)
    x1, x2, y1, y2 = rng.integers(0, m + 1, (4, 60))
    query, y = WaveletTree(values).report(x1, x2, y1, y2)
    want = [(q, v) for q in range(60) for x, v in enumerate(values) if x1[q] <= x < x2[q] and y1[q] <= v < y2[q]]
    assert sorted(zip(query.tolist(), y.tolist())) == sorted((q, int(v)) for q, v in want)


def test_half_words_meet_once():
    words = [b"aaaab", b"aaab", b"aaaa", b"aaaaa"]
    there = np.array([len(w) == 5 for w in words])
    pairs = set()
    for low, high in ((0, 2), (2, 5)):
        a, b = spelling.near(words, 5, there, np.ones(4, bool), low, high)
        new = [(words[i], words[k]) for i, k in zip(a, b)]
        assert len(set(new)) == len(new) and not pairs & set(new)
        pairs |= set(new)
    assert pairs == {(b"aaab", b"aaaab"), (b"aaaa", b"aaaab"), (b"aaaa", b"aaaaa"), (b"aaaaa", b"aaaab"), (b"aaaab", b"aaaaa")}
