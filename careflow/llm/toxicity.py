"""Toxicity by class-conditional Kneser-Ney models (operator 7).

Both classes, toxic and ordinary, have a model of words: the documents of the class that have a
word, less a discount that depends on the count (the three of modified Kneser-Ney, from the
counts of counts), and a backoff to continuation counts that the classes share: after how many
different words a word was seen in either class. A rare expression thus has the same likelihood in
both as far as only the shared counts speak for it. Counting documents and not occurrences keeps
one text that repeats itself from speaking for its class.

A text's log-likelihoods under the two are compared by length-normalised ratios: over the whole
text (its mean, and its sum by the root of the length), the highest over windows of 1 to 32 words,
so that a long text isn't excused by its length, and the mean of its 2 to 10 most toxic different
words. A logistic curve over them and the length (the highest of many is higher by chance) makes them a probability; it is fitted on the documents learned from, each
scored by counts without itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import crc_mod, tidy
from .words import MARKS, hash_words, look_up, slices

#: Learnable documents at most that are used of each class (ordinary, toxic): the first by a hash of the id; and
#: the most code points of them together and of one (48 million in all, so the model has at most some 12 million words; usual are 500,000 of 12 bytes).
SAMPLE, CHARS, LONGEST = (12_000, 6_000), (32_000_000, 16_000_000), 1_000_000
#: The discount of continuation counts, and of class counts where they are too few to estimate it.
DISCOUNT = 0.75
#: Words of the windows, and numbers of the most toxic words.
WINDOWS, TOP = (1, 2, 8, 32), (2, 3, 5, 10)
FEATURES = 3 + len(WINDOWS) + len(TOP)
#: The fold that labels are never learned from, of so many.
FOLDS, HELD_OUT = 5, 0

OUT = "doc_id long, held_out boolean, score double, predicted int"


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch (lower case, without marks), and where each text's words begin and end in them."""
    return hash_words(pc.utf8_lower(texts.fill_null("")), MARKS)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of documents of each class that have a word."""
    for b in (part for whole in batches for part in slices(whole, 0)):
        h, at = words_in(b.column(0))
        seen = [np.empty(0, np.uint64)] * 2
        for k in (0, 1):
            parts = [np.unique(h[x:y]) for x, y, t in zip(at[:-1], at[1:], b.column(1).to_pylist()) if t == k]
            seen[k] = np.concatenate(parts) if parts else seen[k]
        for k in (0, 1):
            word, n = np.unique(seen[k], return_counts=True)
            ns = [n if k == i else np.zeros(len(n), np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in ns)], ["word", "n0", "n1"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word, word before) of each batch; 0 stands before a text's first word."""
    for b in (part for whole in batches for part in slices(whole, 0)):
        h, at = words_in(b.column(0))
        before = np.concatenate([np.zeros(1, np.uint64), h])[: len(h)]
        before[at[:-1][at[:-1] < len(h)]] = 0
        pairs = np.unique(np.stack([h, before]), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["word", "before"])


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount of the counts 0, 1, 2 and 3 or more, from the counts of counts."""
    of = [int((n == k).sum()) for k in range(5)]
    if not (of[1] and of[2]):
        return np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    y = of[1] / (of[1] + 2 * of[2])
    found = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] and of[k + 1] else DISCOUNT for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))])


def ratios(n0: np.ndarray, n1: np.ndarray, continued: np.ndarray, without: int | None = None) -> np.ndarray:
    """Log-likelihood ratio (toxic against ordinary) of each word, against that of unseen words.

    With ``without`` it is that for a document of this class which is left out, for the words that it has.
    """
    shared = (np.maximum(continued - DISCOUNT, 0) + DISCOUNT * len(continued) / (len(continued) + 1)) / max(1, continued.sum())
    out = 0.0
    for k, n in ((1, n1), (0, n0)):
        d = discounts(n)
        total, free = n.sum(), d[np.minimum(n, 3)].sum() / n.sum()
        free = max(free, 1e-9)
        own = np.maximum(n - (without == k), 0)
        p = np.maximum(own - d[np.minimum(own, 3)], 0) / total + free * shared
        out = out + (1 if k else -1) * (np.log(p) - math.log(free))
    return out


def features(h: np.ndarray, keys: np.ndarray, llr: np.ndarray) -> list[float]:
    """Length-normalised ratios of a text, given its words' hashes and the model; all 0 for a text without words."""
    n = len(h)
    if not n:
        return [0.0] * FEATURES
    at = look_up(keys, h)
    x = np.where(at >= 0, llr[at], 0.0) if len(keys) else np.zeros(n)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    out = [sums[-1] / n, sums[-1] / math.sqrt(n)]
    for k in WINDOWS:
        k = min(k, n)
        out.append((sums[k:] - sums[:-k]).max() / k)
    most = np.concatenate([llr[np.unique(at[at >= 0])], np.zeros(TOP[-1])])
    most = np.sort(np.partition(most, len(most) - TOP[-1])[-TOP[-1] :])[::-1]
    return [*out, *(most[:k].mean() for k in TOP), math.log1p(n)]


def _features(model):
    """Features of the documents learned from, each by the model without itself."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *llr = model.value
        for b in (part for whole in batches for part in slices(whole, 0)):
            h, at = words_in(b.column(0))
            rows = [features(h[x:y], keys, llr[t]) for x, y, t in zip(at[:-1], at[1:], b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    return run


def _logits(texts: pa.Array, model: tuple, curve: np.ndarray) -> np.ndarray:
    """By the curve (slopes, offset, and the value of a text without evidence, that is without a word that was learned)."""
    h, at = words_in(texts)
    rows = np.array([features(h[x:y], *model) for x, y in zip(at[:-1], at[1:])]).reshape(len(at) - 1, FEATURES)
    return np.where(rows[:, :-1].any(axis=1), rows @ curve[:-2] + curve[-2], curve[-1])


def _scores(model, curve: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            score = 1 / (1 + np.exp(-np.clip(_logits(b.column(2), model.value, curve), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and offset of a weighted logistic regression with a weak ridge on the scaled features, by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    m = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(m.shape[1])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = m @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + w @ ridge @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
        grad = m.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve(m.T @ (m * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), grad)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(broadcast model, curve) learned from the labelled rows outside the held-out fold.

    At most ``SAMPLE`` documents of each class are read, of these no text of more than ``LONGEST`` code points (such a text
    is scored like all others, but never learned from), and no more once a class has ``CHARS`` code points; without both classes the curve is flat at
    the share of toxic labels. Of an id with several texts the least one is learned from.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    own = own.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}  # two rows
    first = [own.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    picked = common.stash(first[0].unionByName(first[1]), "toxicity-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.filter(F.length("text") <= LONGEST).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most sum(SAMPLE) ids
    texts = common.stash(texts, "toxicity-sample")
    sizes = texts.select("doc_id", "toxic", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().to_pydict()  # at most sum(SAMPLE) rows
    used, over = [0, 0], []
    for _, doc_id, k, n in sorted(zip(sizes["h"], sizes["doc_id"], sizes["toxic"], sizes["n"])):
        if used[k] > CHARS[k]:
            over.append(doc_id)
        used[k] += n
    sample = texts.select("doc_id", "text", "toxic")
    if over:
        sample = sample.join(F.broadcast(spark.createDataFrame([(x,) for x in over], "doc_id long")), "doc_id", "left_anti")
    sample = sample.select("text", "toxic")

    counts = sample.mapInArrow(_count_documents, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    after = sample.mapInArrow(_pairs, "word long, before long").distinct().groupBy("word").agg(F.count("*").alias("continued"))
    table = counts.join(after, "word").toArrow()  # bounded by CHARS
    order = np.argsort(key := table.column("word").to_numpy().view(np.uint64))
    key, (n0, n1, continued) = key[order], (table.column(c).to_numpy()[order] for c in ("n0", "n1", "continued"))

    share = total.get(1, 0) / max(1, sum(total.values()))
    usual = math.log((share + 1e-9) / (1 - share + 1e-9))
    if not n0.sum() or not n1.sum():
        return common.spread(spark, (np.empty(0, np.uint64), np.empty(0, np.float32))), np.array([0.0] * FEATURES + [usual] * 2)
    model = spark.sparkContext.broadcast((key, *(ratios(n0, n1, continued, k).astype(np.float32) for k in (0, 1))))
    rows = sample.mapInArrow(_features(model), "x array<double>, toxic int").collect()  # at most sum(SAMPLE) rows of a few numbers
    model.destroy()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    have = [max(1, int((y == k).sum())) for k in (0, 1)]
    curve = fit_curve(x, y, np.array([total[int(k)] / have[int(k)] for k in y]))
    return common.spread(spark, (key, ratios(n0, n1, continued).astype(np.float32))), np.append(curve, usual)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text enters a score. Null and empty texts score like a text without any evidence.
    A null id belongs to the fold of the empty text and is never learned from. Repeated rows give
    their own rows; ids that are labelled twice count as toxic if one label says so. Other
    columns aren't read; empty tables give empty results, missing labels a constant score.
    """
    model, curve = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scores(model, curve), OUT)


def _verdicts(model, curve: np.ndarray, at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, at)):
            yield b.filter(pa.array(_logits(b.column(at), model.value, curve) < 0))

    return run


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with their own columns whatever their names.

    Null and empty texts are scored as by ``score``, repeated rows stay or go together, null ids are
    scored and never learned from, an empty table gives an empty result.
    """
    model, curve = train(docs, labels, id_col, text_col, label_col)
    return docs.mapInArrow(_verdicts(model, curve, docs.columns.index(text_col)), docs.schema)
