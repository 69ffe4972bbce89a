"""Token ids in a binary format of bit-plane shuffled, compressed blocks (operator 9).

Texts are encoded where they lie; only their ids (two bytes each, if the vocabulary allows) are
dealt by ranges of doc_id into shards, so that shards in order and documents in a shard are in
ascending order of doc_id. A shard's ids, each document's followed by the end id, form one
stream that is cut into blocks of ``BLOCK_IDS``. A shard is one file in the shared folder:

    blocks | chunk index: offset of each block and of the end (uint64 each) | number of blocks (uint64) | magic "BPS1"

and a block in it is

    magic "BPS1" | number of ids | number of planes | number of segments | bytes of the table   (little-endian uint32)
    segment table, compressed: doc_id, serial number in the shard, offset in the block, ids here,
        ids of the whole document, offset of the segment in its document     (int64 each)
    plane lengths (uint32 each) | planes, each compressed by zstandard

where plane i holds bit i of every id (a byte holds eight ids). High planes are nearly
constant and vanish. The segment table says which documents lie where, and the chunk index where a
block lies, so that a reader fetches and decodes single blocks.

Each attempt of a task writes a file of its own and reports its name; names of attempts that
ended well are kept (in a Parquet table, by Spark's committer), files of others are deleted. Files are
written and read through ``pyarrow.fs``, so the shared folder may be on any store that it knows.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .common import tidy
from .words import buffers, slices

VOCABULARY = "byte_bpe_50k.json"
#: Ids of a block, and the id that ends a document.
BLOCK_IDS, END = 65_536, 0
#: Pieces of text whose ids a worker keeps at once, and the longest piece (in bytes) that is kept.
KEPT, KEPT_BYTES = 400_000, 48
#: Bytes of text that are encoded at once.
AT_ONCE = 8 << 20
#: Bytes of text of a shard, about.
SHARD = 256 << 20
#: Stands for a null id; such documents come first.
NULL_ID = -(2**63)
MAGIC = b"BPS1"
_SEGMENT = np.dtype([("doc_id", "<i8"), ("serial", "<i8"), ("at", "<i8"), ("n", "<i8"), ("total", "<i8"), ("begin", "<i8")])


# --- encoding -------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer as its file describes it. A worker has one core, so the library's own threads only cost."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes beside which nothing is cut: separators that some tools call white space, and last and first bytes of wider white space.
_UNSURE_BEFORE, _UNSURE_BEHIND = np.zeros(256, bool), np.zeros(256, bool)
_UNSURE_BEFORE[[0x1C, 0x1D, 0x1E, 0x1F]] = _UNSURE_BEHIND[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
#: Letters of ASCII, and second bytes of the Latin letters whose first byte is 0xC3.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Wider white space in UTF-8: first byte, and for longer ones the second, of the characters that are looked at byte by byte.
_WIDE = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}


def cuts(data: np.ndarray, special: frozenset[int] = frozenset(), whole_marks: bool = False) -> np.ndarray:
    """Whether UTF-8 bytes may be cut before each byte: the pre-token pattern has a boundary there whatever the rest is.

    A boundary always lies before white space that follows another character; before the last
    character of a run of white space that something else follows; and behind that character unless it is a
    space, which goes with the word. Where a byte's kind is in doubt nothing is cut; ``special``
    has the first bytes of special tokens, since white space before these is split as at a text's end.
    A boundary also lies between a letter and an ASCII mark behind it; ``whole_marks`` leaves it out,
    as there may be special tokens with letters and marks in them.
    """
    n, out = len(data), np.zeros(len(data), bool)
    if n < 2:
        return out
    space = _SPACE[data]
    ends = ~space  # what surely isn't white space, as a last byte of its character
    ends &= ~_UNSURE_BEFORE[data]
    for first, lasts in _WIDE.items():
        k = len(first)
        if n > k:
            hit = data[: n - k] == first[0]
            if hit.any():
                for i, x in enumerate(first[1:], 1):
                    hit &= data[i : n - k + i] == x
                ends[k:][hit & np.isin(data[k:], lasts)] = False
    doubt = _UNSURE_BEHIND.copy()
    doubt[list(special)] = True
    begins = ~(space | doubt[data])  # what surely isn't white space, as a first byte
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & begins[1:]
    out[1:] = space[1:] & ends[:-1]
    sure_run = out | (np.concatenate([[False], space[:-1]]) & space)  # a run that began with a doubtful character isn't touched
    out |= last & sure_run
    out[1:] |= (last & sure_run)[:-1] & (data[:-1] != 0x20)
    if not whole_marks:  # between a letter and the mark behind it
        mark, letter = _MARK[data], _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        out[1:] |= letter[:-1] & mark[1:]
    out[0] = False
    return out


#: The signs that stand for bytes in the vocabulary: printable ones for themselves, the others from U+0100 on.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGNS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


class Pieces(dict):
    """Ids of pieces of text by the tokenizers library; pieces come back again and again, so each is encoded once while it is kept."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.merge = self.tok.model.tokenize
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end."""
        data, at = buffers(texts)
        if not len(data):
            return np.empty(0, self.kind), at
        raw = data.tobytes()
        cut = cuts(data, frozenset(x[0] for x in self.special), any(x in raw for x in self.special))
        inner = at[(at > 0) & (at < len(data))]
        cut[inner] = True
        begin = np.concatenate([[0], np.flatnonzero(cut)])
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.get, words))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(gaps, self._encode([words[i] for i in gaps])):
                found[i] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = sizes[which]
        ends = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.arange(counts.sum()) + np.repeat(starts - (ends - counts), counts)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(begin, at)]

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.batch(pa.array([text], pa.string()))[0]

    def _encode(self, unknown: list[str]) -> list[bytes]:
        """Encodes pieces and keeps the short ones.

        A space and letters are one match of the pattern by themselves, so the library's model merges
        them at once; letters beyond the Latin ones, whose kind may depend on the version of
        Unicode, and all other pieces go through the whole tokenizer.
        """
        ids: list = [None] * len(unknown)
        space, merge = _SIGNS[0x20], self.merge
        for i, p in enumerate(unknown):
            if (p[1:] if p[0] == " " else p).isalpha():
                if p.isascii():
                    ids[i] = [t.id for t in merge(p.replace(" ", space))]
                elif max(p) < "\u0250":
                    ids[i] = [t.id for t in merge(p.encode().decode("latin-1").translate(_SIGNS))]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([unknown[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        ends = list(itertools.accumulate(map(len, ids), initial=0))
        raw, size = np.fromiter(itertools.chain.from_iterable(ids), self.kind, ends[-1]).tobytes(), self.kind.itemsize
        new = [raw[size * a : size * b] for a, b in itertools.pairwise(ends)]
        if len(self) + len(new) > KEPT:
            self.clear()
        self.update((p, x) for p, x in zip(unknown, new) if len(p) <= KEPT_BYTES)
        return new


@functools.lru_cache(maxsize=1)
def _known(path: str) -> Pieces:
    """The pieces that a worker process keeps from task to task."""
    return Pieces(path)


def _encode(path: str, bounds: list[int]):
    """Each document's shard and its ids, with the end id, as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        end = np.array([END], known.kind).tobytes()
        for b in (part for whole in batches for part in slices(whole, 1, AT_ONCE)):
            ids, at = known.batch(b.column(1))
            raw = ids.tobytes()
            size = known.kind.itemsize
            shard = np.searchsorted(bounds, pc.fill_null(b.column(0), NULL_ID).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), pa.array([raw[size * x : size * y] + end for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["shard", "doc_id", "ids"])

    return run


# --- blocks ---------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, segments: np.ndarray) -> bytes:
    """One block's bytes; ``segments`` is an array of ``_SEGMENT``."""
    press = zstandard.ZstdCompressor(level=3)
    width = int(ids.max()).bit_length() if len(ids) else 0
    planes = [press.compress(np.packbits((ids >> np.uint32(i)).astype(np.uint8) & 1, bitorder="little").tobytes()) for i in range(width)]
    table = press.compress(segments.astype(_SEGMENT).tobytes())
    head = MAGIC + struct.pack("<4I", len(ids), width, len(segments), len(table))
    return head + table + struct.pack(f"<{width}I", *map(len, planes)) + b"".join(planes)


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, segments) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, width, n_segments, size = struct.unpack_from("<4I", payload, 4)
    open_ = zstandard.ZstdDecompressor()
    at = 20
    segments = np.frombuffer(open_.decompress(payload[at : at + size], max_output_size=n_segments * _SEGMENT.itemsize), _SEGMENT) if n_segments else np.empty(0, _SEGMENT)
    at += size
    lengths = struct.unpack_from(f"<{width}I", payload, at)
    at += 4 * width
    ids = np.zeros(n, np.uint32)
    for i, length in enumerate(lengths):
        bits = np.unpackbits(np.frombuffer(open_.decompress(payload[at : at + length], max_output_size=(n + 7) // 8), np.uint8), count=n, bitorder="little")
        ids |= bits.astype(np.uint32) << np.uint32(i)
        at += length
    return ids, segments


class _Shard:
    """Takes documents in order and gives out full blocks."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.segments: list[tuple] = []
        self.held = self.serial = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[bytes]:
        begin, total = 0, len(ids)
        while begin < total:
            n = min(total - begin, BLOCK_IDS - self.held)
            self.parts.append(ids[begin : begin + n])
            self.segments.append((doc_id, self.serial, self.held, n, total, begin))
            self.held += n
            begin += n
            if self.held == BLOCK_IDS:
                yield self.flush()
        self.serial += 1

    def flush(self) -> bytes:
        out = pack_block(np.concatenate(self.parts).astype(np.uint32), np.array(self.segments, _SEGMENT))
        self.parts, self.segments, self.held = [], [], 0
        return out


class FileWriter:
    """Writes blocks one by one, and the chunk index behind them."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.out, self.offsets = store.open_output_stream(at), [0]

    def add(self, block: bytes) -> None:
        self.out.write(block)
        self.offsets.append(self.offsets[-1] + len(block))

    def close(self) -> int:
        """Number of blocks."""
        n = len(self.offsets) - 1
        self.out.write(np.array(self.offsets, "<u8").tobytes() + struct.pack("<Q", n) + MAGIC)
        self.out.close()
        return n


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if ":" in path else (pa.fs.LocalFileSystem(), path)


def chunk_index(path: str) -> np.ndarray:
    """Offsets of a file's blocks and of their end."""
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        size = f.size()
        n, magic = struct.unpack("<Q4s", f.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        return np.frombuffer(f.read_at(8 * (n + 1), size - 12 - 8 * (n + 1)), "<u8").astype(np.int64)


def read_block(path: str, offset: int, size: int) -> bytes:
    """One block of a file."""
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        return f.read_at(size, offset)


def _write(kind: str, folder: str):
    """Writes the files of the shards, whose rows come in order; a row for each with its name, blocks and ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[int, str, FileWriter, _Shard] | None = None
        total = 0

        def close() -> pa.RecordBatch:
            no, name, out, shard = open_
            if shard.held:
                out.add(shard.flush())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((no, name, out.close(), total), (pa.int32(), pa.string(), pa.int32(), pa.int64()))], ["shard", "name", "n_blocks", "n_ids"])

        for b in batches:
            for no, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if open_ is None or open_[0] != no:
                    if open_ is not None:
                        yield close()
                    name = f"shard-{no:06d}-{uuid.uuid4().hex}.bps"
                    open_, total = (no, name, FileWriter(f"{folder}/{name}"), _Shard()), 0
                ids = np.frombuffer(raw.as_buffer(), kind)
                total += len(ids)
                for block in open_[3].add(NULL_ID if doc_id is None else doc_id, ids):
                    open_[2].add(block)
        if open_ is not None:
            yield close()

    return run


def _index(folder: str):
    """A row for each block of the files, from their chunk indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, name in zip(b.column("shard").to_pylist(), b.column("name").to_pylist()):
                at = chunk_index(f"{folder}/{name}")
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(at[:-1]), pa.array(np.diff(at))], ["shard", "name", "offset", "size"])

    return run


def _read(folder: str):
    """A row for each segment of the blocks: whose it is, where it lies, and its checksum."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, name, offset, size in zip(*(b.column(c).to_pylist() for c in ("shard", "name", "offset", "size"))):
                ids, seg = unpack_block(read_block(f"{folder}/{name}", offset, size))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(seg["at"].tolist(), seg["n"].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(seg), pa.int32()), *(pa.array(seg[c].copy()) for c in ("serial", "doc_id", "total", "begin", "n")), pa.array(crc, pa.int64())], ["shard", "serial", "doc_id", "total", "begin", "n", "crc"])

    return run


# --- combining checksums --------------------------------------------------------------------


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


@functools.lru_cache(maxsize=4096)
def _zeros(n: int) -> tuple[int, ...]:
    """The linear map of a checksum over n zero bytes."""
    one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        one = [_times(one, x) for x in one]
    out = [1 << i for i in range(32)]
    while n:
        if n & 1:
            out = [_times(one, x) for x in out]
        one = [_times(one, x) for x in one]
        n >>= 1
    return tuple(out)


def crc32_join(a: int, b: int, length_b: int) -> int:
    """crc32 of two strings in a row from their own and the second one's length."""
    return _times(list(_zeros(length_b)), a) ^ b


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            parts.sort(key=lambda p: p["begin"])
            crc = 0
            for p in parts:
                crc = crc32_join(crc, p["crc"], 4 * p["n"]) if p["begin"] else p["crc"]
            out.append(crc)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "serial", "doc_id", "n_tokens")), pa.array(out, pa.int64())], ["shard", "serial", "doc_id", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes all documents' ids to files; their folder, and the table of the files (shard, name, n_blocks, n_ids).

    The files lie in ``folder`` (a new one in the shared folder, if none is given), one a shard; a shard is a range of ids, as many
    as the session has shuffle partitions, or more where one would hold more than about ``SHARD`` bytes of text.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(VOCABULARY)
    folder = folder or common.folder(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:  # as many as there are partitions, more if that makes them too large
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(common.shuffle_partitions(docs), -(-size // SHARD))
    # Bounds of the shards: quantiles of the ids, so that a range's rows can be told where a text is encoded.
    found = rows.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else None
    coded = rows.mapInArrow(_encode(path, sorted(set(found or []))), "shard int, doc_id long, ids binary")
    coded = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    files = common.stash(coded.mapInArrow(_write(Pieces(path).kind.str, folder), "shard int, name string, n_blocks int, n_ids long"), "token-files-index")
    _sweep(spark, folder, files)
    return folder, files


def _sweep(spark: SparkSession, folder: str, files: DataFrame) -> None:
    """Deletes the files of attempts that failed or were overtaken; there is one row and one file a shard."""
    kept = {r[0] for r in files.select("name").collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.listStatus(at) if store.exists(at) else []:
        if found.getPath().getName() not in kept and found.getPath().getName().endswith(".bps"):
            store.delete(found.getPath(), False)


def read(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 of every document, from the files alone."""
    blocks = files.select("shard", "name").mapInArrow(_index(folder), "shard int, name string, offset long, size long")
    segments = blocks.repartition("shard", "offset").mapInArrow(_read(folder), "shard int, serial long, doc_id long, total long, begin long, n long, crc long")
    # A document over several blocks has one part in each, so a row of parts is as large as the document at most.
    docs = segments.groupBy("shard", "serial").agg(F.first("doc_id").alias("doc_id"), F.first("total").alias("n_tokens"), F.collect_list(F.struct("begin", "n", "crc")).alias("parts"))
    docs = docs.mapInArrow(_join_segments, "shard int, serial long, doc_id long, n_tokens long, ids_crc32 long")
    # One row a shard: as many as there were partitions.
    base = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).selectExpr("shard", "sum(n) over (order by shard rows between unbounded preceding and current row) - n as base")
    within = docs.selectExpr("*", "sum(n_tokens) over (partition by shard order by serial rows between unbounded preceding and current row) - n_tokens as within")
    out = within.join(F.broadcast(base), "shard")
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every whole text's ids and reads the files back: one row per row of ``docs``.

    Texts are encoded as the library does by its file, so the string of a special token in a text becomes
    that token's id. A null text counts as empty (the end id only); null ids come first and stay
    null; repeated ids are ordered by their token ids and each keep their row. Other columns aren't
    read; an empty table gives an empty result.
    """
    return read(*write(docs, path, id_col, text_col))
