import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from careflow.llm import repair

KIND = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        r = "user" if h == 4 else r
        out += [(c, t, r, x)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation by recursion over (turn, what has been said), over whole audit texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: repair.HEAD], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for t, r, x in rows:
        body = x.rstrip(SPACES)
        kinds.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))

    def step(said, r):
        """said: '', 's', 'u' or 'a', the last role; None where the grammar forbids r."""
        return r if (said, r) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    @functools.lru_cache(None)
    def best(i, said, inserted):
        options = []
        if i == len(rows) and said in ("", "a"):
            options.append((0, "", ()))
        if inserted < 4:
            for full in ("user", "assistant"):
                if step(said, full[0]):
                    c, a, out = best(i, full[0], inserted + 1)
                    options.append((c + 3, "I" + a, (f"{full}:",) + out))
        if i < len(rows):
            t, r, x = rows[i]
            c, a, out = best(i + 1, said, 0)
            options.append((c + 4, "D" + a, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                if r[:1] and step(said, r[:1]):
                    c, a, out = best(i + 1, r[:1], 0)
                    options.append((c + more, "K" + a, (f"{r}:{x}",) + out))
                for full in ("user", "assistant"):
                    if step(said, full[0]):
                        c, a, out = best(i + 1, full[0], 0)
                        options.append((c + more + 3, "R" + a, (f"{full}:{x}",) + out))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    convs = defaultdict(list, {c: [] for c, *_ in rows})
    for c, *r in plain_damage(rows):
        convs[c].append(tuple(r))
    return sorted(((c, *plain_repair(r)) for c, r in convs.items()), key=str)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "uncle", None]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", None, "Fine. \n", "é.", "a:b\nuser:c."]
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 5])
            rows.append((c, rng.choice([turn] * 9 + [None]), rng.choice(roles), rng.choice(texts + [f"say {rng.random()}."] * 6)))
    rows += [(None, i, "user" if i % 2 else "assistant", f"t{i // 3}.") for i in range(40)]
    rows += [(900, i % 7 or None, ("system", "user", "assistant")[i % 3], "x" * rng.choice([1, 70]) + rng.choice(["", ".", "y."])) for i in range(150)]
    rows += [(901, 5, "user", "same.")] * 60 + [(902, 20, "user", "long. " * 60_000)] + [(903, None, None, None)]
    return rows + [(c, t, r, x) for c in range(1000, 1040) for t, r, x in [(0, "system", "Be good."), (1, "user", "Hi!"), (2, "assistant", "Hello.")]]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("segment", [4096, 3, 1])
def test_equals_plain_recursion_however_it_is_cut(spark, with_clashes, segment):
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, KIND).repartition(5)).withColumns({n: repair.F.lit(1) for n in ("conv", "seg", "mono", "head", "fault", "digest", "edit", "h")})
    assert got(repair.damaged_and_repaired(df, segment)) == plain(rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = corpus(60, 5)
    made = repair.repaired(repair.edits(spark.createDataFrame(rows, KIND))).collect()
    convs = defaultdict(list)
    for r in sorted(made, key=lambda r: (r["seg"], r["k"])):
        convs[r["conv_id"]].append(r["role"][0])
    assert convs and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in convs.values())


def test_stretches_compose():
    rng = random.Random(2)
    for _ in range(200):
        turns = [(rng.choice("suat"), rng.randrange(4)) for _ in range(rng.randrange(1, 20))]
        v = repair.END
        for t in reversed(turns):
            v = repair._before(t, v)
        cut = rng.randrange(len(turns) + 1)
        right = repair.through(repair.matrix(turns[cut:]), repair.END)
        assert repair.through(repair.matrix(turns[:cut]), right) == v
        edits, state = repair.walk(turns[:cut], right, repair.START)
        more, end = repair.walk(turns[cut:], repair.END, state)
        assert edits + [(e, i + cut if i >= 0 else i, r) for e, i, r in more] == repair.walk(turns, repair.END, repair.START)[0]


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert repair.damaged_and_repaired(none).count() == 0 and repair.edits(none).count() == 0
