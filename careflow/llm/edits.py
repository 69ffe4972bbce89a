"""Edit-aware token counts (operator 4).

A document's tree has a leaf for every run of pre-tokens of about ``LEAF`` code points; a node
holds the code points and the tokens of its subtree. Leaves are cut at boundaries of the
pre-token pattern behind a character that isn't white space: the pattern looks only ahead, so a piece that ends there is split in the
same way with or without what follows, and a document's count is the sum of its leaves'. An edit descends to the leaves that
it touches; where it comes so near to the cut on the left that this one might move, the neighbour is taken in as context, and on the
right leaves are taken in until the new split meets an old cut again; only
this region is encoded again, spread over the same leaves, and the sums above are updated.
Only a single pre-token longer than a leaf makes a longer one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import tidy
from .words import slices

#: Code points of a leaf when a tree is built; a leaf that has grown beyond GROWN times this has its tree built anew.
LEAF, GROWN = 1_024, 8
#: A boundary wherever it stands, found without splitting: before a space between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _cut_from(text: str, at: int, least: int, pattern: str) -> int:
    """The first boundary from ``least`` on behind a character that isn't white space, by splitting from the boundary ``at``; the text's end without one."""
    reach = max(least + 64, at + (least - at) * 5 // 4)
    while True:
        part = text[at:reach]
        for e in bpe.boundaries(part, pattern):
            if at + e >= least and not part[e - 1].isspace() and (reach >= len(text) or e <= len(part) - bpe.UNSURE):
                return at + e
        if reach >= len(text):
            return len(text)
        reach = at + 2 * (reach - at)


def cut(text: str, size: int, pattern: str, ahead: str = "") -> list[str]:
    """Leaves of at least ``size`` code points (but the last); the text begins and ends at cuts, ``ahead`` is what follows it."""
    out, at, whole = [], 0, text + ahead
    while at < len(text):
        to = len(text)
        if at + size < len(text):
            m = _CUT.search(whole, at + size, at + 2 * size + 2)
            to = min(to, m.start() if m else _cut_from(whole, at, at + size, pattern))
        out.append(text[at:to])
        at = to
    return out or [""]


class CountTree:
    """A segment tree of (code points, tokens) over a text's leaves, as two arrays in heap order."""

    def __init__(self, text: str, enc: tiktoken.Encoding, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.enc, self.encoded, self.pattern = enc, 0, enc._pat_str
        if chars is None or tokens is None:
            self._build(text)
            self.encoded = 0
            return
        self.size, self.chars, self.tokens = len(chars) // 2, list(chars), list(tokens)
        self.leaves, at = [], 0
        for n in self.chars[self.size :]:
            self.leaves.append(text[at : at + n])
            at += n

    def _build(self, text: str) -> None:
        self.leaves = cut(text, LEAF, self.pattern)
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [""] * (self.size - len(self.leaves))
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        self.tokens = [0] * self.size + [self._count(x) for x in self.leaves]
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(bpe.encode(text, self.enc)) if text else 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a position, and the position in it (the last leaf with text, at the end)."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replaces ``delete`` code points from ``at`` on by ``insert``; what lies outside the text is left off."""
        at = min(max(at, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - at)
        first, inner = self._leaf(at)
        last, _ = self._leaf(max(at + delete - 1, at)) if delete else (first, 0)
        region = "".join(self.leaves[first : last + 1])
        region = region[:inner] + insert + region[inner + delete :]
        # Boundary context: on the left until what decides on the cut there is as it was, on the right until the split meets a cut again.
        while inner < bpe.UNSURE and (left := self._beside(first, -1)) is not None:
            region, inner, first = "".join(self.leaves[left:first]) + region, inner + self.chars[self.size + left], left
        take = 1
        while (right := self._beside(last, 1)) is not None and not self._meets(region, right):
            for _ in range(take):
                region, last = region + self.leaves[right], right
                if (right := self._beside(last, 1)) is None:
                    break
            take *= 2
        n = last - first + 1
        parts = cut(region, max(1, len(region) // n), self.pattern, self._ahead(last))
        parts = parts[: n - 1] + ["".join(parts[n - 1 :])] + [""] * (n - 1 - len(parts)) if len(parts) > n - 1 else parts + [""] * (n - len(parts))
        if max(map(len, parts)) > GROWN * LEAF:
            self._build("".join(self.leaves[:first] + parts + self.leaves[last + 1 :]))
            return
        for k, part in enumerate(parts, first):
            if part != self.leaves[k]:
                self.leaves[k] = part
                self.chars[self.size + k], self.tokens[self.size + k] = len(part), self._count(part)
        low, high = (first + self.size) // 2, (last + self.size) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2

    def _ahead(self, last: int, least: int = 64) -> str:
        """What follows a leaf: so many code points at least, if there are."""
        out = ""
        while len(out) < least and (right := self._beside(last, 1)) is not None:
            out, last = out + self.leaves[right], right
        return out

    def _meets(self, region: str, right: int) -> bool:
        """Whether the split of a region, which begins at a cut, has one where the leaf ``right`` begins."""
        if not region or region[-1].isspace():
            return not region
        if re.match(r" \S", self.leaves[right]):
            return True
        ahead = self.leaves[right] + self._ahead(right)
        return len(region) in bpe.boundaries(region + ahead, self.pattern)

    def _beside(self, leaf: int, step: int) -> int | None:
        """The nearest leaf with text on one side."""
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None


def _plant(path: str, pattern: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoding(path, pattern)
        for b in (part for whole in batches for part in slices(whole, 1)):
            trees = [CountTree(t.as_py(), enc) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens"))], [*b.schema.names, "tree_chars", "tree_tokens"])

    return run


def _apply(path: str, pattern: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoding(path, pattern)
        for b in (part for whole in batches for part in slices(whole, 1)):
            trees, before, n_edits = [], [], []
            for text, chars, tokens, edits in zip(*(b.column(c).to_pylist() for c in ("text", "tree_chars", "tree_tokens", "edits"))):
                tree = CountTree(text, enc, chars, tokens)
                before.append(tree.n_tokens)
                edits = [e for e in edits or [] if e]
                for e in edits:
                    tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                n_edits.append(len(edits))
                trees.append(tree)
            longs = [pa.array(x, pa.int64()) for x in ([t.n_tokens for t in trees], before, n_edits, [t.n_chars for t in trees], [t.encoded for t in trees])]
            lists = [pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.text for t in trees], pa.string()), *lists, *longs], ["doc_id", "text", "tree_chars", "tree_tokens", "n_tokens", "n_tokens_before", "n_edits", "n_chars", "n_encoded_chars"])

    return run


def plant(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """doc_id, text, edits, tree_chars, tree_tokens for every row: the trees are arrays in heap order, the root at 1.

    A null text counts as empty; ids are carried, never compared; columns not named aren't read.
    """
    path, pattern = path or public_tokenizers.path(bpe.RANKS), pattern or public_tokenizers.PATTERN
    kind = "array<struct<at:long,delete:long,insert:string>>"
    edits = F.col(edits_col) if edits_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), edits.cast(kind).alias("edits"))
    return rows.mapInArrow(_plant(path, pattern), f"doc_id long, text string, edits {kind}, tree_chars array<int>, tree_tokens array<int>")


def apply(trees: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Applies each row's edits (in order, each to the text that the ones before left) to its tree.

    ``trees`` has the columns of ``plant``. Returns doc_id, the new text and tree, n_tokens,
    n_tokens_before, n_edits, n_chars and n_encoded_chars (code points that were encoded again).
    Edits reaching beyond the text are cut off at its ends; null edits and nulls in an edit do nothing. An
    empty table gives an empty result.
    """
    path, pattern = path or public_tokenizers.path(bpe.RANKS), pattern or public_tokenizers.PATTERN
    kind = "doc_id long, text string, tree_chars array<int>, tree_tokens array<int>, n_tokens long, n_tokens_before long, n_edits long, n_chars long, n_encoded_chars long"
    return trees.select("doc_id", "text", "edits", "tree_chars", "tree_tokens").mapInArrow(_apply(path, pattern), kind)
