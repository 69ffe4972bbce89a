"""Brown class-based bigrams (operator 5).

P(word | word before) = P(class | class before) * P(word | class), and every word of the training
texts has a class by exchange. The ``CORE`` most frequent words are clustered on the driver: a
word moves to the class that raises the likelihood of all class bigrams most, until none moves.
All other words of the vocabulary, however many, are then placed in Spark, each by the same
criterion on the class counts of its own neighbours (words outside the core count as one unit
there). No word is left out and none is classed by its form.

Transitions are counted over all neighbours in the training texts once every word has its class;
they are absolutely discounted and back off to class frequencies. Within a class
a word has its count less a discount, and what the discounts free is the class's share for unseen
words, which count as one type, as in the base score. An unseen word takes its chance from all
classes, and what follows it is expected as after a mixture of the classes by what they have freed; so the
probabilities of all words and the unseen type sum to one after any word.

Words travel as 64-bit hashes. Classes and counts of the ``KNOWN`` most frequent words are
broadcast; the others' come by a join and are put back in their places. That
choice of plan changes no result. Texts are read once for it: what goes on to the transitions and the
scores is a byte a token, its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import crc_mod, tidy
from .words import hash_words, look_up, slices

#: Words that are clustered by exchange among themselves, and the classes for words.
CORE, CLASSES = 1_000, 62
#: Units with a class of their own: all words outside the core (while these are placed), and the text's end.
FIXED = 2
#: Most passes of the exchange.
PASSES = 8
#: Words whose counts and classes are broadcast (17 bytes each).
KNOWN = 250_000
#: Discounts of class bigrams and of words.
DISCOUNT, WORD_DISCOUNT = 0.5, 0.75
FOLDS, HELD_OUT = 7, 2

#: The class of a word that waits for the join; all others are less, so that a class is a byte.
WAITING = 255

_DOC = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, seq binary, gaps array<struct<pos:int,word:long>>"
_SEQ = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, seq binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each part of a batch."""
    for b in (part for whole in batches for part in slices(whole, 0)):
        words, n = np.unique(hash_words(b.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _sequence(of_words: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row with an end after each; positions of the words in it; begin of each text."""
    docs = len(at) - 1
    owner = np.repeat(np.arange(docs), np.diff(at))
    place = np.arange(len(of_words)) + owner
    out = np.full(len(of_words) + docs, end, np.int64)
    out[place] = of_words
    return out, place, at[:-1] + np.arange(docs)


def _bigrams(model):
    """Counts of the units' bigrams in a partition; units are the core's words, all others, and the end."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = model.value
        size = len(core) + FIXED
        cells = np.zeros(size * size, np.int64)
        for b in (part for whole in batches for part in slices(whole, 0)):
            h, at = hash_words(b.column(0))
            u = look_up(core, h)
            u[u < 0] = size - 2
            seq, _, _ = _sequence(u, at, size - 1)
            cells += np.bincount(np.concatenate([[size - 1], seq[:-1]]) * size + seq, minlength=size * size)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """A class for each unit; the last ``FIXED`` units have the last classes to themselves.

    Starts with the units dealt out by frequency and moves one unit at a time to the class that
    raises the likelihood of the class bigrams most (ties: the least class).
    """
    counts = counts.astype(float)
    size, free = len(counts), classes - FIXED
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    of = np.empty(size, np.int64)
    of[np.argsort(-weight[:-FIXED], kind="stable")] = np.arange(size - FIXED) % free
    of[-FIXED:] = np.arange(free, classes)
    ind = np.eye(classes)[of]
    right, left = counts @ ind, counts.T @ ind  # units by classes
    table = ind.T @ right
    for _ in range(passes):
        moved = 0
        for u in np.argsort(-weight[:-FIXED], kind="stable"):
            if not weight[u]:
                continue
            a, r, l, own = of[u], right[u].copy(), left[u].copy(), counts[u, u]
            r[a] -= own
            l[a] -= own
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] -= own
            gain = (_xlogx(table + r) - _xlogx(table)).sum(axis=1) + (_xlogx(table.T + l) - _xlogx(table.T)).sum(axis=1)
            diag = np.diag(table)
            gain += -(_xlogx(diag + r) - _xlogx(diag)) - (_xlogx(diag + l) - _xlogx(diag)) + _xlogx(diag + r + l + own) - _xlogx(diag)
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain -= _xlogx(rows + r.sum() + own + l) - _xlogx(rows + l) + _xlogx(cols + l.sum() + own + r) - _xlogx(cols + r)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                of[u] = b
                right[:, a] -= counts[:, u]
                right[:, b] += counts[:, u]
                left[:, a] -= counts[u, :]
                left[:, b] += counts[u, :]
                moved += 1
        if not moved:
            break
    return of


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
    back = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    seen = np.maximum(table - DISCOUNT, 0) / np.maximum(total, 1)
    free = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return np.log10(seen + free * back)


def _contexts(model, classes: int):
    """Words outside the core with the classes of their neighbours (before * classes + behind), counted in each part of a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, of = model.value
        for b in (part for whole in batches for part in slices(whole, 0)):
            h, at = hash_words(b.column(0))
            u = look_up(core, h)
            seq, place, _ = _sequence(np.where(u >= 0, of[u], classes - 2), at, classes - 1)
            seq = np.concatenate([[classes - 1], seq])
            rare = np.flatnonzero(u < 0)
            code = (seq[place[rare]] * classes + seq[place[rare] + 2]).astype(np.int64)
            order = np.lexsort((code, h[rare]))
            word, code = h[rare][order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (code[1:] != code[:-1])])) if len(word) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(word)))
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(code[first].astype(np.int16)), pa.array(n.astype(np.int32))], ["word", "code", "n"])

    return run


def _place(model):
    """Classes of words from their contexts, which come word by word; a row is (word, class, n)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, out_of, size = model.value  # by class before, by class behind: log10 of the chances for each class of the word
        held = None  # the last word's sums, since its contexts may go on in the next batch

        def rows(words: np.ndarray, n: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
            of = np.argmax(np.round(gains - n[:, None] * size, 6), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(of.astype(np.int32)), pa.array(n)], ["word", "class", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            word, code, n = (b.column(c).to_numpy() for c in ("word", "code", "n"))
            left, right = np.divmod(code.astype(np.int64), len(into))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words, total = word[first], np.add.reduceat(n.astype(np.int64), first)
            gains = np.add.reduceat(n[:, None] * (into[left] + out_of[right]), first, axis=0)
            if held is not None and held[0][0] == words[0]:
                total[0] += held[1][0]
                gains[0] += held[2][0]
            elif held is not None:
                yield rows(*held)
            if len(words) > 1:
                yield rows(words[:-1], total[:-1], gains[:-1])
            held = words[-1:].copy(), total[-1:].copy(), gains[-1:].copy()
        if held is not None:
            yield rows(*held)

    return run


def with_unseen(trans: np.ndarray, n_of: np.ndarray, kinds_of: np.ndarray) -> np.ndarray:
    """log10 transitions with the unseen type as one class more; ``trans`` has the classes of words and the end's, the others have the classes of words."""
    size = len(n_of)
    free = np.where(n_of > 0, WORD_DISCOUNT * kinds_of / np.maximum(n_of, 1), 1.0)
    like = kinds_of / kinds_of.sum() if kinds_of.sum() else np.full(size, 1 / size)
    p = 10.0**trans
    out = np.empty((size + 2, size + 2))
    out[:-1, :-1] = p
    out[:-1, -1] = p[:, :size] @ free
    out[-1, :-1] = like @ p[:size]
    out[-1, -1] = like @ out[:size, -1]
    return np.log10(out)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bytes with the places where each row's begin (and the last one's end) as an array."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def _classes(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of an array of texts, and where each text's begin in them (and the last one's end)."""
    if not len(seq):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1]
    return np.frombuffer(seq.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def _draw(model, vocabulary, end: int):
    """Per text its classes and what needs no join, and its other words with their places."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_class, base_all, ends = model.value
        known, counts, of = vocabulary.value
        row = TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in slices(whole, 2)):
            h, at = hash_words(b.column(2))
            u = look_up(known, h)
            seq, place, begin = _sequence(np.where(u >= 0, of[u], WAITING) if len(known) else np.full(len(h), WAITING), at, end)
            n = np.diff(np.append(begin, len(seq)))
            inner, base, seen = np.zeros(len(seq)), np.zeros(len(seq)), np.zeros(len(seq), np.int64)
            there = np.flatnonzero(u >= 0)
            c = counts[u[there]].astype(float) if len(there) else np.empty(0)
            inner[place[there]] = np.log10(c - WORD_DISCOUNT) - in_class[seq[place[there]]]
            base[place[there]] = np.log10(c + 1)
            seen[place[there]] = 1
            base = np.add.reduceat(base, begin) + np.log10(ends + 1.0) - n * base_all
            n_known = np.add.reduceat(seen, begin) + (ends > 0)
            rest = np.flatnonzero(u < 0)
            owner = np.repeat(np.arange(b.num_rows), np.diff(at))[rest]
            cut = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            fields = [(place[rest] - begin[owner]).astype(np.int32), h[rest].view(np.int64)]
            gaps = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(x) for x in fields], ["pos", "word"]))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(np.add.reduceat(inner, begin)), _binary(seq, np.append(begin, len(seq))), gaps],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "seq", "gaps"],
            )

    return run


def _fill(model, end: int):
    """Puts the joined words' classes and chances into their texts; a text's own row comes first (pos -1)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_class, _, _ = model.value
        for t, begin, stop in common.sorted_groups(batches, ["row"]):
            pos, n = t.column("pos").to_numpy(), t.column("n").fill_null(0).to_numpy()
            own = t.column("class").fill_null(end + 1).to_numpy()  # the unseen type
            word = np.flatnonzero(pos >= 0)
            head = t.take(pa.array(begin)).combine_chunks()
            column = lambda c: pa.concat_arrays(head.column(c).chunks)  # noqa: B023, E731
            seq, at = _classes(column("seq"))
            seq = seq.copy()
            seq[at[:-1].repeat(stop - begin)[word] + pos[word]] = own[word]
            inner = np.where(n > 0, np.log10(np.maximum(n - WORD_DISCOUNT, 1e-9)) - in_class[np.minimum(own, len(in_class) - 1)], 0.0)
            add = lambda x: np.add.reduceat(np.where(pos >= 0, x, 0), begin)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [column("doc_id"), column("held_out"), column("n_tokens"), pa.array(column("n_known").to_numpy() + add(n > 0)), pa.array(column("base").to_numpy() + add(np.log10(n + 1.0))), pa.array(column("inner").to_numpy() + add(inner)), _binary(seq, at)],
                [c.split()[0] for c in _SEQ.split(", ")],
            )

    return run


def _pairs(size: int):
    """Counts of the classes' bigrams in a partition (class before * size + class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for b in batches:
            seq, _ = _classes(b.column(0))
            for low in range(0, len(seq), 1 << 20):
                now = seq[low : low + (1 << 20)].astype(np.int64)
                before = np.concatenate([[seq[low - 1] if low else size - 1], now[:-1]])  # an end comes before every text
                cells += np.bincount(before * size + now, minlength=size * size)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "n"])

    return run


def _score(model, end: int):
    """Adds the transitions of each text's classes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for whole in batches:
            seq, at = _classes(whole.column("seq"))
            total, low = np.empty(whole.num_rows), 0
            while low < whole.num_rows:  # about a million tokens (or one text) at once
                high = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 20), side="right")) - 1)
                now = seq[at[low] : at[high]]
                total[low:high] = np.add.reduceat(logs[np.concatenate([[end], now[:-1]]), now], at[low:high] - at[low])
                low = high
            score = pa.array(whole.column("inner").to_numpy() + total)
            yield pa.RecordBatch.from_arrays([*whole.columns[:5], score], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows outside the held-out fold. A null text counts as empty: one token, the
    end. A null id is in the fold of the empty text. Repeated rows are learned from and scored
    each. Words that training hasn't seen share the mass that the discounts free, as one
    type. Other columns aren't read; an empty table gives an empty result; without training
    rows every word is unseen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.filter("not held_out").select("text")
    counted = common.stash(training.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "brown-counts")
    kinds, total = counted.agg(F.count("*"), F.sum("n")).first()
    ends = training.count()
    train_tokens, kinds = (total or 0) + ends, kinds + (ends > 0)

    # The core, its bigrams and its classes.
    top = counted.orderBy(F.desc("n"), "word").limit(CORE).toArrow()
    core, core_n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(core)
    core, core_n = core[order], core_n[order]
    size, classes = len(core) + FIXED, CLASSES + FIXED
    cells = training.mapInArrow(_bigrams(common.spread(spark, core)), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    bigrams = np.zeros(size * size, np.int64)
    bigrams[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    bigrams = bigrams.reshape(size, size)
    of = exchange(bigrams, classes)
    ind = np.eye(classes, dtype=np.int64)[of]
    table = ind.T @ bigrams @ ind

    # All other words, each in one group: none of these has more than one of CORE parts of all tokens.
    logs = transitions(table)
    chances = (logs[:, :CLASSES].astype(np.float32), logs[:CLASSES].T.astype(np.float32).copy(), np.log10(np.maximum(table.sum(axis=0)[:CLASSES], 1)).astype(np.float32))
    contexts = training.mapInArrow(_contexts(common.spread(spark, (core, of)), classes), "word long, code short, n int").repartition("word").sortWithinPartitions("word")
    rest = common.stash(contexts.mapInArrow(_place(common.spread(spark, chances)), "word long, class int, n long"), "brown-words")
    sums = {r[0]: r[1:] for r in rest.groupBy("class").agg(F.sum("n"), F.count("*")).collect()}  # a row a class
    n_of, kinds_of = (np.array([sums.get(c, (0, 0))[i] for c in range(CLASSES)], float) for i in (0, 1))
    np.add.at(n_of, of[: len(core)], core_n)
    np.add.at(kinds_of, of[: len(core)], 1)

    base_all = float(np.log10(train_tokens + kinds + 1))
    model = common.spread(spark, (np.append(np.log10(np.maximum(n_of, 1)), 0.0), base_all, ends))

    # The most frequent words, by the finest frequency band that leaves at most KNOWN above it: no task has to sort them all.
    band = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    at_least, above = None, 0
    for r in sorted(rest.groupBy(band.alias("band")).count().collect(), reverse=True):  # at most 64 * 63 rows
        above += r[1]
        if above > KNOWN:
            break
        at_least = r[0]
    frequent = rest.filter(F.lit(False) if at_least is None else band >= at_least).toArrow()
    known = np.concatenate([core, frequent.column("word").to_numpy().view(np.uint64)])
    counts = np.concatenate([core_n, frequent.column("n").to_numpy()])
    class_of = np.concatenate([of[: len(core)], frequent.column("class").to_numpy()]).astype(np.int64)
    order = np.argsort(known)
    vocabulary = common.spread(spark, (known[order], counts[order], class_of[order]))

    # Every text as its words' classes.
    drawn = common.stash(rows.mapInArrow(_draw(model, vocabulary, CLASSES), _DOC), "brown-rows")
    heads = drawn.select("row", F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("class"), F.lit(None).cast("long").alias("n"), "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "seq")
    gaps = drawn.select("row", F.inline("gaps")).join(rest, "word", "left").select("row", "pos", "class", "n", *(F.lit(None).cast(t).alias(c) for c, t in heads.dtypes[4:]))
    texts = common.stash(heads.unionByName(gaps).repartition("row").sortWithinPartitions("row", "pos").mapInArrow(_fill(model, CLASSES), _SEQ), "brown-texts")

    # Transitions from all neighbours in the training texts; after an end comes a text's beginning.
    final = np.zeros((CLASSES + 1) ** 2, np.int64)
    for cell, n in texts.filter("not held_out").select("seq").mapInArrow(_pairs(CLASSES + 1), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # at most (CLASSES + 1)**2 rows
        final[cell] = n
    full = with_unseen(transitions(final.reshape(CLASSES + 1, -1)), n_of, kinds_of)
    out = texts.mapInArrow(_score(common.spread(spark, full), CLASSES), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
