import hashlib
import random

import public_tokenizers as P
import pytest

from careflow.llm import bpe, edits

ENC = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
KIND = "doc_id long, text string"
ROWS = [
    (1, "hello world"), (2, None), (None, ""), (3, "x" * 500 + " " + "y" * 100), (3, "x" * 500 + " " + "y" * 100), (3, "other"), (4, "it's we'll  \n\n 12 a1  ,.;" * 40),
    (5, " " * 600 + "z"), (6, "a b\n\nc 'tis don't " * 100), (8, "Ünï çode ñ 漢字 😀 " * 60), (9, "<|endoftext|> \0 \x1c"), (None, "null id " * 50),
]


def expected(rows):
    out = []
    for d, t in rows:
        ids = ENC.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(bpe.ids_bytes(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 32), (100_000, 10)])
def test_equals_the_library_on_whole_texts(spark, with_clashes, chunk, overlap):
    df = with_clashes(spark.createDataFrame(ROWS, KIND).repartition(3))
    got = bpe.encode_documents(df, chunk=chunk, overlap=overlap).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], KIND)).collect() == []


def test_stitches_are_used(spark):
    """Chunks of plain text meet within the overlap, so no document is encoded as a whole."""
    text = "the quick brown fox, it's 12 times as quick " * 40
    marks = [bpe.sync_marks(text[k * 100 : k * 100 + 160], P.PATTERN, k * 100, k * 100, k * 100 + 160) for k in range(8)]
    assert all(set(a) & set(b) for a, b in zip(marks, marks[1:]))


def test_long_runs_of_one_class():
    assert bpe.encode("\n" * 300_000 + "q", ENC)[-1] == ENC.encode_ordinary("q")[0]
    text = "a" * 30_000 + " " * 5_000 + "b"
    assert ENC.decode(bpe.encode(text, ENC)) == text and bpe.encode(text, ENC) == ENC.encode_ordinary(text)


def test_edits_count_like_encoding_anew(monkeypatch):
    rng = random.Random(5)
    parts = ["a", "it's", " ", "  ", "\n", "x y", "12", "!?", "é", "word", "　", "'ll", " the", " of", " and"]
    monkeypatch.setattr(edits, "LEAF", 12)
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        tree = edits.CountTree(text, ENC)
        for _ in range(5):
            at, delete, insert = rng.randint(-2, len(text) + 3), rng.randint(-1, 9), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
            tree.edit(at, delete, insert)
            a = min(max(at, 0), len(text))
            text = text[:a] + insert + text[a + min(max(delete, 0), len(text) - a) :]
            assert (tree.text, tree.n_chars, tree.n_tokens) == (text, len(text), len(ENC.encode_ordinary(text)))


def test_an_edit_encodes_its_region_only():
    text = "some words and more of them " * 4_000
    tree = edits.CountTree(text, ENC)
    tree.edit(50_000, 4, "new text")
    assert 0 < tree.encoded < 4 * edits.LEAF and tree.n_tokens == len(ENC.encode_ordinary(tree.text))


def test_edit_tables(spark, with_clashes):
    kind = KIND + ", edits array<struct<at:long,delete:long,insert:string>>"
    rows = [(1, "hello world", [(5, 1, "-"), (0, 0, "oh ")]), (2, None, [(3, 9, "x")]), (None, "abc", None), (4, "", []), (4, "a b", [None, (None, None, None)]), (4, "a b", [(1, 99, "")])]
    df = with_clashes(spark.createDataFrame(rows, kind))
    got = sorted(((r["doc_id"], r["text"], r["n_tokens_before"], r["n_edits"], r["n_tokens"]) for r in edits.apply(edits.plant(df, edits_col="edits")).collect()), key=str)
    n = lambda t: len(ENC.encode_ordinary(t))
    want = [(1, "oh hello-world", n("hello world"), 2, n("oh hello-world")), (2, "x", 0, 1, n("x")), (None, "abc", n("abc"), 0, n("abc")), (4, "", 0, 0, 0), (4, "a b", n("a b"), 1, n("a b")), (4, "a", n("a b"), 1, n("a"))]
    assert got == sorted(want, key=str)
    assert edits.apply(edits.plant(df.limit(0), edits_col="edits")).count() == 0


@pytest.mark.parametrize("name", ["chinese", "lines", "tabs", "code", "digits", "spaces"])
def test_texts_without_single_blanks_have_leaves_too(name):
    rng = random.Random(name)
    make = {
        "chinese": lambda: "".join(rng.choice("漢字仮名交文書") for _ in range(rng.randrange(3, 30))) + rng.choice("。，、！"),
        "lines": lambda: "word" * rng.randrange(1, 4) + "\n" * rng.choice([1, 1, 2]),
        "tabs": lambda: f"{rng.randrange(10**6)}\tcell{rng.randrange(99)}\t" + rng.choice(["", "\n"]),
        "code": lambda: rng.choice(["if(x){", "}\n\n\n", "    y='s'+\"don't\";\n", "// 'll 've\r\n", "a[b]->c++"]),
        "digits": lambda: f"{rng.random()};",
        "spaces": lambda: rng.choice(["  ", "   \n ", "a  b", "'  s", "　", "x"]),
    }[name]
    text = "".join(make() for _ in range(6_000))
    tree = edits.CountTree(text, ENC)
    assert len([x for x in tree.leaves if x]) > len(text) / (4 * edits.LEAF) and tree.n_tokens == len(ENC.encode_ordinary(text))
    for _ in range(40):
        at, delete, insert = rng.randrange(len(text) + 1), rng.choice([0, 0, 1, 3, 3000]), rng.choice(["", "x", "'", " ", "\n", make(), make() * 3])
        before = tree.encoded
        tree.edit(at, delete, insert)
        text = text[:at] + insert + text[at + delete :]
        assert tree.text == text and tree.n_tokens == len(ENC.encode_ordinary(text)), (at, delete, insert)
        assert tree.encoded - before < 10 * edits.LEAF
