"""Byte-level BPE by overlapping chunks (operator 3).

A text of at most ``CHUNK`` code points is encoded where it lies, without a shuffle. A longer
one is cut into chunks that overlap by ``OVERLAP`` code points; the chunks are dealt out once,
each task pre-tokenises its own, and neighbours are stitched at the first boundary that both
have in their overlap. From a common boundary on both splits are the same, since the pattern
looks only ahead; so the pieces between the stitches are encoded alone, and only their ids move
once more, to be hashed in order, a batch at a time. Where neighbours never meet (one run of a
class fills the overlap), the texts between the stitches on both sides are put together and
encoded as one piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import slices

#: Code points of a chunk's own part, and of the part that it shares with the next chunk.
CHUNK, OVERLAP = 16_384, 1_024
#: A boundary so close to a chunk's end may move when more text follows (a contraction has three characters).
UNSURE = 3
#: Runs of white space from this length on are split without the library's own pattern matcher, which overflows its stack on them.
LONG_SPACE = 4_096

RANKS = "byte_bpe_50k.tiktoken"
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file's encoding, loaded once in each process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@functools.lru_cache(maxsize=1)
def spaces() -> regex.Pattern:
    return regex.compile(rf"\s{{{LONG_SPACE},}}")


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a text, in code points."""
    return [m.end() for m in splitter(pattern).finditer(text)]


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    """Ids of a text: each match of the pattern separately, no special tokens."""
    if len(text) >= LONG_SPACE and spaces().search(text):
        out: list[int] = []
        for m in splitter(enc._pat_str).finditer(text):
            out += enc._encode_single_piece(m.group().encode("utf-8", "surrogatepass"))
        return out
    return enc.encode_ordinary(text)


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def sync_marks(text: str, pattern: str, start: int, low: int, high: int) -> list[int]:
    """Sure boundaries of a chunk within [low, high), as positions in the whole text.

    Only boundaries after a character that isn't white space count: a piece that ends there
    is split in the same way with or without what follows.
    """
    last = len(text) - UNSURE
    return [start + e for e in boundaries(text, pattern) if e <= last and low <= start + e < high and not text[e - 1].isspace()]


def _encode_rows(path: str, pattern: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in (part for whole in batches for part in slices(whole, 1)):
            n, ids_hash, text_hash = [], [], []
            for text in b.column(1):
                ids = encode(text.as_py() or "", enc)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids_bytes(ids)).hexdigest())
                text_hash.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _mark_chunks(pattern: str, chunk: int, overlap: int):
    """A chunk's sure boundaries in its two overlaps."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 4)):
            head, tail = [], []
            for k, body in zip(b.column("k").to_pylist(), b.column("body")):
                at = k * chunk
                marks = sync_marks(body.as_py(), pattern, at, at, at + chunk + overlap)
                head.append([p for p in marks if p < at + overlap])
                tail.append([p for p in marks if p >= at + chunk])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "k", "n_chunks")), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["key", "k", "n_chunks", "head", "tail"])

    return run


def _encode_pieces(path: str, pattern: str, chunk: int):
    """Ids of each piece between two stitches; a chunk that misses one passes on its own text instead."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in (part for whole in batches for part in slices(whole, 6)):
            ids_out, text_out = [], []
            for k, n_chunks, begin, end, body in zip(*(b.column(c).to_pylist() for c in ("k", "n_chunks", "begin", "end")), b.column("body")):
                whole, text = (k == 0 or begin is not None) and (k == n_chunks - 1 or end is not None), body.as_py()
                text = text[0 if begin is None else begin - k * chunk : (chunk if k < n_chunks - 1 else None) if end is None else end - k * chunk]
                ids_out.append(ids_bytes(encode(text, enc)) if whole else None)
                text_out.append(None if whole else text)
            last = pa.array([e is not None or k == n - 1 for k, n, e in zip(*(b.column(c).to_pylist() for c in ("k", "n_chunks", "end")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "k", "n_chunks")), pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string()), last], ["doc_id", "key", "k", "n_chunks", "ids", "part", "last"])

    return run


def _join_pieces(path: str, pattern: str):
    """Hashes each document's pieces in order; rows come by key and chunk, equal rows (copies) next to each other.

    What is held is one hash state, and texts between two stitches that are still apart.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        key = k = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc_id, own, at, n_chunks, ids, part, last = (b.column(c)[i].as_py() for c in range(7))
                if own != key:
                    key, k, held, n, a, c = own, -1, [], 0, hashlib.sha256(), hashlib.sha256()
                if at == k:  # a copy's
                    if at == n_chunks - 1:
                        out.append(row)
                    continue
                k = at
                if part is not None:
                    held.append(part)
                    ids = ids_bytes(encode("".join(held), enc)) if last else b""
                    held = [] if last else held
                a.update(ids)
                c.update(enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()))
                n += len(ids) // 4
                if at == n_chunks - 1:
                    row = (doc_id, n, a.hexdigest(), c.hexdigest())
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encodes and decodes every whole text.

    One row for each row of ``docs``: doc_id, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes). A null text counts as
    empty (no ids, hash of nothing); a null id stays null; repeated rows and repeated ids each
    give their own row; other columns of ``docs``, whatever their names, are not read. An empty
    table gives an empty result. ``path`` is the rank file, ``pattern`` the pre-token pattern.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")
    short = rows.filter(size <= chunk).mapInArrow(_encode_rows(path, pattern), OUT)

    # A row's key: equal keys are equal rows (copies), whose chunks lie next to each other when they are joined.
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    last = ((size - 1) / chunk).cast("int")
    cut = rows.filter(size > chunk).select("doc_id", key.alias("key"), "text").select("doc_id", "key", F.explode(F.sequence(F.lit(0), last)).alias("k"), (last + 1).alias("n_chunks"), "text")
    cut = cut.select("doc_id", "key", "k", "n_chunks", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("body"))
    # The texts move once: both readers below use this one exchange.
    cut = cut.repartition("key", "k")
    marked = cut.mapInArrow(_mark_chunks(pattern, chunk, overlap), "key string, k int, n_chunks int, head array<long>, tail array<long>")

    # The stitch of two neighbours: the first boundary that both have. Each chunk gets the one before and the one behind it.
    sides = F.array(F.struct(F.col("k").alias("at"), F.col("tail"), F.lit(None).cast("array<long>").alias("head")), F.struct((F.col("k") - 1).alias("at"), F.lit(None).cast("array<long>").alias("tail"), F.col("head")))
    sides = marked.select("key", "n_chunks", F.inline(sides)).filter("at between 0 and n_chunks - 2")
    met = sides.groupBy("key", "at").agg(F.array_min(F.array_intersect(F.max("tail"), F.max("head"))).alias("p"))
    ends = met.select("key", F.inline(F.array(F.struct(F.col("at").alias("k"), F.lit(None).cast("long").alias("begin"), F.col("p").alias("end")), F.struct((F.col("at") + 1).alias("k"), F.col("p").alias("begin"), F.lit(None).cast("long").alias("end")))))
    ends = ends.groupBy("key", "k").agg(F.max("begin").alias("begin"), F.max("end").alias("end"))
    pieces = cut.join(ends, ["key", "k"], "left").select("doc_id", "key", "k", "n_chunks", "begin", "end", "body").mapInArrow(_encode_pieces(path, pattern, chunk), "doc_id long, key string, k int, n_chunks int, ids binary, part string, last boolean")
    long = pieces.repartition("key").sortWithinPartitions("key", "k").mapInArrow(_join_pieces(path, pattern), OUT)
    return short.unionByName(long)
