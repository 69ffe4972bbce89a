import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from careflow.llm import tokenfile as T

TOK = T.tokenizer(P.path(T.VOCABULARY))


def test_pieces_encode_like_whole_texts():
    rng = random.Random(3)
    parts = ["a", "it's", " ", "  ", "\n", "\n\n", "\t", "x y", "12", "!?", "é", "\xa0", "　", "'ll", "\r", "\x1c", "\x85", "漢", "<|endoftext|>", "​", "Z.", "\0"]
    known = T.Pieces(P.path(T.VOCABULARY))
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert known.ids(text).tolist() == TOK.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    segments = np.zeros(3, T._SEGMENT)
    segments["n"] = [1, 2, 3]
    a, b = T.unpack_block(T.pack_block(ids, segments))
    assert (a == ids).all() and (b == segments).all()
    with pytest.raises(ValueError):
        T.unpack_block(b"nonsense" * 4)


def test_files_have_a_chunk_index(tmp_path):
    out = T.FileWriter(f"{tmp_path}/x.bps")
    for block in (b"one", b"", b"three"):
        out.add(block)
    assert out.close() == 3
    at = T.chunk_index(f"{tmp_path}/x.bps")
    assert [T.read_block(f"file://{tmp_path}/x.bps", a, b - a) for a, b in zip(at[:-1].tolist(), at[1:].tolist())] == [b"one", b"", b"three"]
    (tmp_path / "y.bps").write_bytes(b"nonsense" * 4)
    with pytest.raises(ValueError):
        T.chunk_index(f"{tmp_path}/y.bps")


def test_joined_checksums():
    a, b = b"hello world", b"xyz" * 50
    assert T.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store_equals_a_plain_stream(spark, with_clashes, monkeypatch):
    """Expected ids come from the library's tokenizer as its file describes it, untouched."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path(T.VOCABULARY))
    assert plain.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    rows = [(5, "hello world"), (2, None), (None, "x"), (3, ""), (9, "word " * 3000), (9, "abc"), (9, "abc"), (1, "a b\nc"), (4, "a<|endoftext|>b <|endoftext|> c")]
    monkeypatch.setattr(T, "BLOCK_IDS", 700)
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = [(d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t in rows]
    start, want = 0, []
    for d, ids in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(map(tuple, T.store(df).orderBy("start").collect())) == want
    assert T.store(df.limit(0)).count() == 0


def test_files_of_lost_attempts_are_deleted(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    (tmp_path / "shard-000000-lost.bps").write_bytes(b"half a file")
    folder, files = T.write(df, folder=f"file://{tmp_path}", shards=3)
    assert sorted(p.name for p in tmp_path.glob("*.bps")) == sorted(r[0] for r in files.select("name").collect())
    assert T.read(folder, files).count() == 50


def test_shards_go_with_the_bytes_of_text(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text of document {i} " * 20) for i in range(60)], "doc_id long, text string")
    usual = sorted(map(tuple, T.store(df).collect()))
    monkeypatch.setattr(T, "SHARD", 2_000)
    assert T.write(df)[1].count() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, T.store(df).collect())) == usual
