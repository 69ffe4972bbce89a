"""Grouping of spelling variants by two-dimensional range reporting (operator 11).

Two words are near if they differ by one inserted, deleted or replaced code point. Whatever the
edit, what stands before it is a common prefix and what stands behind it a common suffix; so for each edit
position the words sought are those in the prefix's interval of the forward order and in the suffix's interval of
the reverse order: points of a grid, reported by a wavelet tree (``wavelet``). For words of L code points and edit
position i both kinds of queries, from words of L (replaced) and of L - 1 code points (inserted), have a prefix of i
and a suffix of L - 1 - i.

The dictionary is dealt out twice for each length: by its first half, where edits in the second half are found, and by its second
half, where those in the first are. A group of words that share a half is worked on in one place, many groups in one tree. A
group of more than ``BIG`` words (halves of two letters are few) is dealt out as pairs of blocks, words to be found
against words that ask; nothing is capped. Tasks pass on counts and the best near word, never pairs.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash, tidy
from .wavelet import WaveletTree

#: Shortest word in code points, and the least number of occurrences.
SHORTEST, RAREST = 5, 3
#: A text's run is damaged if this divides its hash.
DAMAGED = 97
#: A near word must be so many times as frequent to be a word's form.
TIMES = 2
#: Different words that a task counts before it passes them on.
COUNTED = 300_000
#: Words, and bytes of words, that share a tree; words of a group that is dealt out as pairs of blocks.
BATCH, BYTES, BIG = 32_768, 1 << 23, 65_536
#: Groups up to so many are told by broadcast (16 bytes each), more by a join.
TOLD = 250_000


@functools.lru_cache(maxsize=1)
def _letters() -> bytes:
    """By Latin-1 code: letters stay, A-Z in lower case, all else becomes a blank."""
    keep = {*range(0x61, 0x7B), *range(0xC0, 0x100)}
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in keep else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text in Latin-1, A-Z in lower case."""
    return (text or "").encode("latin-1", "replace").translate(_letters()).split()


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers in parts of the texts; each is damaged by the rule on its document's id first."""
    total = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for b in batches:
        for key, text in zip(b.column("id").to_pylist(), b.column("text")):
            before, n_of = zlib.crc32(f"{'' if key is None else key}:".encode()), Counter(runs(text.as_py()))
            for run, n in n_of.items():
                if len(run) < SHORTEST:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
                if h % DAMAGED == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < SHORTEST:
                        continue
                total[run] += n
            if len(total) >= COUNTED:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST) -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` code points in Latin-1 and their occurrences, ``rarest`` or more. Null texts have none, a null id counts as empty."""
    read = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def _common(m: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row and the one before (the first: 0)."""
    out = np.zeros(len(m), np.int64)
    for low in range(1, len(m), 4_096):
        other = m[low : low + 4_096] != m[low - 1 : low - 1 + len(m[low : low + 4_096])]
        out[low : low + 4_096] = np.where(other.any(axis=1), other.argmax(axis=1), m.shape[1])
    return out


def _intervals(common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of the words that share the first ``n`` bytes with each."""
    at = np.arange(len(common))
    new = common < n
    new[0] = True
    first = np.maximum.accumulate(np.where(new, at, 0))
    ends = np.append(at[new][1:], len(common))
    return first, ends[np.cumsum(new) - 1]


def near(words: list[bytes], length: int, there: np.ndarray, asks: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): numbers of words that are near, b being one of ``there`` (of ``length``), by edits at positions low..high-1.

    Each of ``asks`` has ``length`` code points, then b differs by one replaced, or one less, then b has one
    more; a position that the letter before makes equal isn't counted again, so each pair comes once over all positions.
    """
    m = np.array(words, f"S{length}").view(np.uint8).reshape(len(words), length)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    back = m[:, ::-1].copy()
    short = sizes < length
    back[short, :-1], back[short, -1] = back[short, 1:], 0
    forward, reverse = (np.argsort(x.view(f"S{length}").ravel(), kind="stable") for x in (m, back))
    lcp, lcs = _common(m[forward]), _common(back[reverse])
    place_f, place_r = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    place_f[forward], place_r[reverse] = np.arange(len(words)), np.arange(len(words))
    before_f, before_r = (np.concatenate([[0], np.cumsum(there[o])]) for o in (forward, reverse))
    found_at = reverse[there[reverse]]  # by reverse rank among the words to be found
    tree = WaveletTree(before_r[place_r[forward[there[forward]]]])
    own, a, b = there.astype(np.int64), [], []
    for i in range(max(low, length - 1 - int(lcs.max(initial=0))), min(high, int(lcp.max(initial=0)) + 1)):
        (f1, f2), (r1, r2) = _intervals(lcp, i), _intervals(lcs, length - 1 - i)
        x1, x2 = before_f[f1[place_f]], before_f[f2[place_f]]
        y1, y2 = before_r[r1[place_r]], before_r[r2[place_r]]
        some = np.flatnonzero(asks & (x2 - x1 > own) & (y2 - y1 > own))  # a word is in its own intervals
        if not len(some):
            continue
        query, y = tree.report(x1[some], x2[some], y1[some], y2[some])
        query, other = some[query], found_at[y]
        new = query != other
        if i:
            new &= ~short[query] | (m[other, i] != m[other, i - 1])
        a.append(query[new])
        b.append(other[new])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


FOUND = "word binary, n_near long, best_n long, best binary"


def _best(words: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> pa.RecordBatch:
    """Each word's number of near words, and the one of largest n (ties: least word)."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, f"S{length}"), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(a)))
    take = lambda ids: pa.array([words[i] for i in ids.tolist()], pa.binary())
    return pa.RecordBatch.from_arrays([take(a[first]), pa.array(counts, pa.int64()), pa.array(n[b[first]], pa.int64()), take(b[first])], names=["word", "n_near", "best_n", "best"])


@tidy
def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of whole groups; rows lie in order of (by_end, length, half, block, asking)."""
    rows, size, group = [], 0, None

    def search() -> pa.RecordBatch:
        by_end, length = group[:2]
        words = [r[0] for r in rows]
        n, there, asks = (np.array([r[k] for r in rows], t) for k, t in ((1, np.int64), (2, bool), (3, bool)))
        half = length // 2
        a, b = near(words, length, there, asks, *((0, half) if by_end else (half, length)))
        longer = np.array([len(w) for w in words], np.int64)[a] < length  # found from the shorter word only
        return _best(words, n, np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]]), length)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("by_end", "length", "half", "block", "asking", "word", "n", "there", "asks")]
        for *key, word, n, there, asks in zip(*columns):
            if key != group:
                # Groups of one kind share a tree; a pair of blocks stands alone.
                if rows and (group[:2] != key[:2] or group[3] >= 0 or key[3] >= 0 or len(rows) >= BATCH or size >= BYTES):
                    yield search()
                    rows, size = [], 0
                group = key
            rows.append((word, n, there, asks))
            size += len(word)
    if rows:
        yield search()


def _half(by_end: bool, length: Column) -> Column:
    """The half by which a word meets words of ``length``."""
    half = (length / 2).cast("int")
    return F.substring(F.col("word"), -(length - half), length - half) if by_end else F.substring(F.col("word"), F.lit(1), half)


def neighbours(words: DataFrame, big: int = BIG) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has a near one; ``big`` doesn't change the result."""
    size, kinds = F.length("word"), []
    for by_end in (False, True):
        for more in (0, 1):  # a word among those of its own length, and asking for those that are longer by one
            length = size + more
            kinds.append(F.struct(F.lit(by_end).alias("by_end"), length.cast("int").alias("length"), _half(by_end, length).alias("half"), F.lit(more == 0).alias("there")))
    rows = words.select("word", "n", F.explode(F.array(*kinds)).alias("x")).select("word", "n", "x.*")
    rows = rows.withColumn("g", F.xxhash64("by_end", "length", "half"))
    crowds = stash(rows.groupBy("g").count().filter(F.col("count") > big).select("g", F.ceil(F.col("count") / big).cast("int").alias("blocks")), "spelling-crowds")
    n = crowds.count()
    rows = rows.join(F.broadcast(crowds) if n <= TOLD else crowds, "g", "left") if n else rows.withColumn("blocks", F.lit(None).cast("int"))
    # In a crowd a word is found in the pairs of its own block with all, and asks in those of all with its own.
    own, every = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda block, asking, there, asks: F.struct(block.cast("int").alias("block"), asking.cast("int").alias("asking"), there.alias("there"), asks.alias("asks"))
    asked = F.transform(every, lambda k: pair(k, own, (k == own) & F.col("there"), F.lit(True)))
    found = F.transform(F.filter(every, lambda k: (k != own) & F.col("there")), lambda k: pair(own, k, F.lit(True), F.lit(False)))
    alone = F.array(pair(F.lit(-1), F.lit(-1), F.col("there"), F.lit(True)))
    rows = rows.select("by_end", "length", "half", "word", "n", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(asked, found))).alias("y")).select("by_end", "length", "half", "word", "n", "y.*")
    group = ["by_end", "length", "half", "block", "asking"]
    dealt = rows.repartition(shuffle_partitions(words), *group).sortWithinPartitions(*group)
    parts = dealt.mapInArrow(_searched, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x"))
    return parts.select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", big: int = BIG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts that occurs ``RAREST`` times or more.

    Words are the maximal runs of letters of whole texts, A-Z in lower case, after the damage that crc32 of ``<id>:<run>`` sets.
    ``form`` is the near word of largest n (ties: the least), if that is ``TIMES`` the word's own; ``root`` is where forms lead in the end.
    Null and empty texts have no words, a null id counts as empty in the hash, repeated rows count as often as they
    stand; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    words = stash(vocabulary(docs, id_col, text_col), "spelling-words")
    best = neighbours(words, big)
    is_form = F.col("best_n") >= TIMES * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    known = stash(known, "spelling-forms")
    roots = known.filter("form is not null").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n")).first()[0] or 1
    # Forms grow by TIMES at each step, which bounds the steps; each round doubles those that are done.
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, TIMES))))):
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        roots = stash(roots.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    text = lambda c: F.decode(c, "ISO-8859-1")
    return known.join(roots, "word", "left").select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
