"""Repair of conversations by the cheapest edits that make their roles grammatical (operator 13).

The roles of a whole conversation follow ``(s?(ua)+)?``: nothing, or an optional system turn and then user
and assistant in turn. Keeping a turn costs nothing, giving it the role that fits 3, deleting it 4
(blank and duplicate turns must go), inserting an empty turn 3; a truncated turn that stays adds 3.
A backward dynamic program has the cost to go for each turn and each of the four states of the
grammar; a greedy walk from the front then takes, of the edits that keep the cost tight, the one whose initial is the least in ASCII.

Turns are sorted by range, so one conversation may lie in many tasks. Costs of a stretch of turns are a
4 x 4 matrix (least cost from each state before to each state behind), so stretches (``SEGMENT`` turns or
``BYTES`` of text at most) are worked on apart: a conversation that lies within one task and one stretch is
walked there at once; for all others only the matrices, and then the states where walks leave, pass
through one task a conversation, in order and one at a time. The digest of a repaired conversation
can only be computed in order; that last pass holds one turn, a hash, the counts and the result's own audit text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, shuffle_partitions, stash, tidy

#: Turns, and about how many characters of text, of a stretch at most.
SEGMENT, BYTES = 4_096, 1 << 22
#: Code points of a text by which turns are dealt out and ordered within a turn number.
HEAD = 64
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: States: start, after a system turn, after a user turn, after an assistant turn. Only first and last end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: The state behind an inserted or re-roled turn, and its role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: By a role's initial: the state behind a turn that is kept, for each state before; -1 where the grammar forbids it.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NOWHERE = (-1, -1, -1, -1)

Turn = tuple[str, int]  # the role's initial, the fault


def _inserting(v: list[int]) -> tuple[int, ...]:
    """Costs with insertions: two in a row at most help, from the start or a system turn three."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


#: Cost to go behind the last turn.
END = _inserting([0, NEVER, NEVER, 0])


def _before(turn: Turn, v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before a turn, from that behind it."""
    initial, fault = turn
    if fault in (BLANK, DUPLICATE):
        return _inserting([DELETE + x for x in v])
    more, kept = REROLE if fault == TRUNCATED else 0, KEPT.get(initial, NOWHERE)
    return _inserting([min(DELETE + v[s], REROLE + more + v[NEXT[s]], KEEP + more + v[kept[s]] if kept[s] >= 0 else NEVER) for s in range(4)])


def matrix(turns: list[Turn]) -> list[int]:
    """Least costs of a stretch from each state before it to each state behind it, row by row."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else NEVER for s in range(4))
        for turn in reversed(turns):
            v = _before(turn, v)
        columns.append(v)
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


def through(m: list[int], v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before a stretch, from that behind it."""
    return tuple(min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4))


def walk(turns: list[Turn], behind: tuple[int, ...], state: int) -> tuple[list[tuple[str, int, str | None]], int]:
    """The edits (initial, turn's number or -1, new role) of a stretch and the state behind it; ``behind``: cost to go there."""
    costs = [behind]
    for turn in reversed(turns):
        costs.append(_before(turn, costs[-1]))
    costs.reverse()
    out = []
    for i, (initial, fault) in enumerate(turns):
        stays, more = fault not in (BLANK, DUPLICATE), REROLE if fault == TRUNCATED else 0
        while True:
            now, then = costs[i][state], costs[i + 1]
            if now == DELETE + then[state]:
                out.append(("D", i, None))
                break
            if now == INSERT + costs[i][NEXT[state]]:
                out.append(("I", -1, ROLE[state]))
                state = NEXT[state]
                continue
            kept = KEPT.get(initial, NOWHERE)[state]
            if stays and kept >= 0 and now == KEEP + more + then[kept]:
                out.append(("K", i, None))
                state = kept
            else:
                out.append(("R", i, ROLE[state]))
                state = NEXT[state]
            break
    return out, state


def finish(state: int) -> list[tuple[str, int, str | None]]:
    """The insertions behind the last turn."""
    out = []
    while state in (SYSTEM, USER):
        out.append(("I", -1, ROLE[state]))
        state = NEXT[state]
    return out


def faults(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) with their fault (0: none), their copy number's place in order, and a digest of the text."""
    said = turns.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("mono", F.monotonically_increasing_id())
    said = stash(said, "repair-turns")  # numbers stay as they are from here on
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("mono").alias("mono"))
    firsts = said.groupBy("conv", "role", "digest").agg(F.min(order).alias("f")).select(F.col("f.mono").alias("mono"), F.lit(True).alias("is_first"))
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(body == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return said.join(firsts, "mono", "left").withColumn("fault", fault.cast("int")).drop("is_first")


EDITS = "conv long, seg long, k long, turn long, role string, text string, fault int, edit string, new_role string, m array<long>"
_FIELDS = ("conv", "seg", "k", "turn", "role", "text", "fault", "edit", "new_role", "m")
_SCHEMA = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("k", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("edit", pa.string()), ("new_role", pa.string()), ("m", pa.list_(pa.int64()))])


class _Out:
    """Rows of edits, passed on in batches cut by bytes."""

    def __init__(self):
        self.rows, self.size = [], 0

    def put(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += 100 + len(row[5] or "")

    def batches(self, least: int = BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), _SCHEMA.types)], schema=_SCHEMA)
            self.rows, self.size = [], 0


def _edited(out: _Out, conv, seg: int, rows: list[tuple], edits: list[tuple]) -> None:
    """rows: (turn, role, text, fault) of a stretch."""
    for k, (edit, i, role) in enumerate(edits):
        turn, was, text, fault = rows[i] if i >= 0 else (None, None, "", None)
        out.put((conv, seg, k, turn, was, text, fault, edit, role, None))


def _turn(row: tuple) -> Turn:
    return row[1][:1], row[3]


def _first_walk(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Edits of conversations that lie within this task and one stretch; the turns of all others, cut into stretches."""
    out, seg, run, size = _Out(), TaskContext.get().partitionId() << 33, [], 0
    conv, began = None, False  # the run's conversation; whether its beginning is sure to be here
    known, cut = False, False

    def stretch(closed: bool) -> None:
        nonlocal seg
        if not run:
            return
        if closed:
            edits, state = walk([_turn(r) for r in run], END, START)
            _edited(out, conv, seg, run, edits + finish(state))
        else:
            m = matrix([_turn(r) for r in run])
            for k, (turn, role, text, fault) in enumerate(run):
                out.put((conv, seg, k, turn, role, text, fault, None, None, m if k == 0 else None))
        seg += 1

    for b in batches:
        for c, *row in zip(*(b.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "fault"))):
            if known and c != conv:
                stretch(closed=began and not cut)
                run, size, cut, began = [], 0, False, True
            elif run and (len(run) >= segment or size >= BYTES):
                stretch(closed=False)
                run, size, cut = [], 0, True
            conv, known = c, True
            run.append(tuple(row))
            size += len(row[2])
            yield from out.batches()
    stretch(closed=False)
    yield from out.batches(0)


def _in_order(df: DataFrame, key: str, order: list[Column], run, kind: str) -> DataFrame:
    """A function over rows that are dealt by a key and sorted within it."""
    return df.repartition(shuffle_partitions(df), key).sortWithinPartitions(*order).mapInArrow(run, kind)


@tidy
def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost to go behind each stretch, conversations from behind."""
    last, v = "none yet", END
    for b in batches:
        segs, out = b.column("seg").to_pylist(), []
        for conv, m in zip(b.column("conv").to_pylist(), b.column("m").to_pylist()):
            v = END if conv != last else v
            out.append(v)
            last, v = conv, through(m, v)
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["seg", "behind"])


@tidy
def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each stretch, and whether it is its conversation's last one (``last`` comes with the rows)."""
    conv, state = "none yet", START
    for b in batches:
        segs, out = b.column("seg").to_pylist(), []
        for c, exits in zip(b.column("conv").to_pylist(), b.column("exits").to_pylist()):
            state = START if c != conv else state
            out.append(state)
            conv, state = c, exits[state]
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(out, pa.int32())], names=["seg", "state"])


def _stretches(batches: Iterator[pa.RecordBatch], more: tuple[str, ...]) -> Iterator[tuple]:
    """(conv, seg, turns, values of ``more``) of whole stretches; rows lie in order."""
    seg, conv, rows, held = None, None, [], None
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("seg", "conv", "turn", "role", "text", "fault", *more)]
        for s, c, turn, role, text, fault, *rest in zip(*columns):
            if s != seg and rows:
                yield conv, seg, rows, held
                rows = []
            seg, conv, held = s, c, rest
            rows.append((turn, role, text, fault))
    if rows:
        yield conv, seg, rows, held


@tidy
def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch, the state behind it for each state before."""
    for conv, seg, rows, (behind,) in _stretches(batches, ("behind",)):
        turns = [_turn(r) for r in rows]
        exits = [walk(turns, tuple(behind), s)[1] for s in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([seg], pa.int64()), pa.array([exits], pa.list_(pa.int32()))], names=["conv", "seg", "exits"])


@tidy
def _second_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for conv, seg, rows, (behind, state, last) in _stretches(batches, ("behind", "state", "last")):
        edits, state = walk([_turn(r) for r in rows], tuple(behind), state)
        _edited(out, conv, seg, rows, edits + (finish(state) if last else []))
        yield from out.batches()
    yield from out.batches(0)


def edits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The edits of every conversation in order: (conv, seg, k, turn, role, text, fault, edit, new_role), order by seg and k.

    ``edit`` is K, R, D or I; ``new_role`` is the role of R and I; a repaired conversation is the rows but for D,
    each with ``coalesce(new_role, role)`` and its text. ``turn``, ``role`` and ``fault`` are null for I.
    Turns are taken in the order of ``turn`` (nulls first), those of one number by role, the first ``HEAD`` code points and the
    digest of the text. Null roles and texts count as one blank; roles count by their initials, and others than s, u, a
    are never kept. Rows without conversation id are one conversation. Repeated rows are duplicates of
    the first; an empty table has no edits; other columns are ignored, whatever their names. ``segment`` doesn't change the result.
    """
    plain = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("mono")]
    said = faults(plain).withColumn("head", F.substring("text", 1, HEAD))
    dealt = said.repartitionByRange(shuffle_partitions(said), *order).sortWithinPartitions(*order)
    done = stash(dealt.select("conv", "turn", "role", "text", "fault").mapInArrow(tidy(functools.partial(_first_walk, segment=segment)), EDITS), "repair-walk")
    open_ = done.filter("edit is null").drop("edit", "new_role")
    down = [F.col("conv").asc_nulls_first(), F.col("seg").desc()]
    up = [F.col("conv").asc_nulls_first(), F.col("seg")]
    inside = [F.col("seg"), F.col("k")]
    heads = open_.filter("m is not null").select("conv", "seg", "m")
    behind = stash(_in_order(heads, "conv", down, _costs, "seg long, behind array<long>"), "repair-costs")
    exits = stash(_in_order(open_.join(behind, "seg"), "seg", inside, _exits, "conv long, seg long, exits array<int>"), "repair-exits")
    last = exits.groupBy("conv").agg(F.max("seg").alias("seg")).select("seg", F.lit(True).alias("last"))
    states = _in_order(exits, "conv", up, _states, "seg long, state int").join(last, "seg", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    known = stash(behind.join(states, "seg"), "repair-states")
    rest = _in_order(open_.join(known, "seg"), "seg", inside, _second_walk, EDITS)
    return done.filter("edit is not null").unionByName(rest).drop("m")


SUMMARY = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@tidy
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its edits in order."""
    out, conv, known = [], None, False

    def flush() -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        out.clear()

    def close() -> None:
        gaps = last - first + 1 - distinct if distinct else 0
        out.append((conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, "".join(audit), digest.hexdigest()))

    for b in batches:
        for c, turn, role, text, fault, edit, new in zip(*(b.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "fault", "edit", "new_role"))):
            if not known or c != conv:
                if known:
                    close()
                    if len(out) >= 4_096:
                        yield from flush()
                conv, known, before, lines = c, True, None, 0
                first = last = None
                distinct = illegal = cost = 0
                counts, audit, digest = [0, 0, 0, 0], [], hashlib.sha256()
            audit.append(edit)
            if len(audit) > 4_096:
                audit = ["".join(audit)]
            if edit != "I":
                counts[fault] += 1
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                before = role[:1]
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
            if edit == "D":
                cost += DELETE
                continue
            cost += (REROLE if edit in "RI" else KEEP) + (REROLE if fault == TRUNCATED else 0)
            digest.update(f"{chr(10) if lines else ''}{new or role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1
    if known:
        close()
        yield from flush()


def summaries(edits: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and digest of each repaired conversation that has edits: the columns of ``SUMMARY``."""
    order = [F.col("conv").asc_nulls_first(), F.col("seg"), F.col("k")]
    return _in_order(edits.select("conv", "seg", "k", "turn", "role", "text", "fault", "edit", "new_role"), "conv", order, _summaries, SUMMARY)


def repaired(edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, seg, k, role, text), order by seg and k."""
    return edits.filter("edit <> 'D'").select(F.col("conv").alias("conv_id"), "seg", "k", F.coalesce("new_role", "role").alias("role"), "text")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that crc32 of ``conv_id:turn`` modulo 20 sets: 0 drops a turn, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    t = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), h.cast("int").alias("h")).filter("h <> 0")
    t = t.withColumn("text", F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return t.select("conv_id", "turn", "role", "text", copies).drop("copy")


def damaged_and_repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every conversation id of (conv_id, turn, role, text) with what its damaged turns need: see ``damaged`` and ``summaries``.

    A conversation without turns after the damage has zeros, an empty audit and the digest of the empty text.
    """
    found = summaries(edits(damaged(turns), segment=segment))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
