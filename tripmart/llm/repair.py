"""Repair of the structure of conversations by Hirschberg's method.

A conversation should be an optional system turn and pairs of a user's and an
assistant's turn, or nothing. Keeping a row costs 0, giving it another role 2,
deleting it 3, inserting an empty turn 2, and a truncated row that stays 1 more;
blank and duplicate rows must go. Four states say what a prefix ended with:
nothing, system, user, assistant. A forward vector of the costs of a first half
and a backward vector of those of a second half meet in the middle; the
cheapest crossing is kept, and both halves are split again. Memory is linear in
the rows, 16 numbers each at most, and all conversations of a task are split
level by level together.

Of equally cheap edits those whose initials (D, I, K, R) are the least string
win. Inserted turns belong to the row behind them. So the strings that lead to
different states at a crossing have as many rows each and end in a row's
letter, none begins another, and the forward vector carries their order: the
least crossing is known without spelling out either half.

Rows are dealt by ranges of (conversation, turn, role, hash) and sorted, so no
conversation is one task's. What lies whole inside a partition is repaired
there. The conversations that a border cuts, or that are longer than ``BLOCK``
rows or ``BYTES``, become blocks: a block is a matrix of costs from state to
state, the matrices of a conversation's blocks give each its first and last
state, and blocks are then repaired apart. Only the hash of a repaired text is one
stream a conversation, which holds one row at a time.

Faults: blank (no character but spaces), else duplicate (role and text occurred
before), else truncated (the last character but spaces is none of ``.!?``).
Defined results: rows are taken by turn (null first), then role, then a hash of the
text, so repeated rows are neighbours; null roles and texts are one space; a role
that begins with another letter than s, u or a can't stay; rows without conv_id
are one conversation; an empty table gives no rows; other columns are ignored,
whatever their names. turn has to be an integer; conv_id has any type that sorts.
Texts of any length are held one batch of rows at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, grouped, small

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 16_384
BYTES = 32 << 20
AT_ONCE = 50_000

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: After an inserted turn or a new role.
NEXT = (USER, USER, ASSISTANT, USER)
#: After a row that stays, by the initial of its role.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Inserted turns that end a conversation well.
TAILS = ("", "II", "I", "")
#: What may happen to a row, and to the gap before it, in the order of strings.
EDITS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
NEVER = 1 << 40
_TAIL = np.array([2 * len(t) for t in TAILS])

# A row is a code: its initial (s, u, a, other) and 4 if it is truncated; 8 if it must go; 9 if it is not there.
MUST_GO, ABSENT = 8, 9


def _after(edit: str, state: int, initial: str) -> tuple[int, int] | None:
    """Cost without truncation, and state, behind an edit."""
    cost = 0
    for letter in edit:
        if letter == "D":
            cost += 3
        elif letter == "K":
            if initial not in KEPT[state]:
                return None
            state = KEPT[state][initial]
        else:
            cost, state = cost + 2, NEXT[state]
    return cost, state


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and edit of the best way from state to state, by code."""
    cost, edit = np.full((10, 4, 4), NEVER), np.zeros((10, 4, 4), np.int64)
    for code in range(9):
        for state in range(4):
            for k, name in enumerate(EDITS):
                if code == MUST_GO and name[-1] != "D":
                    continue
                if (end := _after(name, state, "sua?"[code % 4])) is not None:
                    total = end[0] + (code in (4, 5, 6, 7) and name[-1] != "D")
                    if total < cost[code, state, end[1]]:
                        cost[code, state, end[1]], edit[code, state, end[1]] = total, k
    cost[ABSENT, range(4), range(4)] = 0
    return cost, edit


COST, EDIT = _tables()


def _falling(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of segments by falling length, and how many are longer than 0, 1, 2, ... rows."""
    order = np.argsort(-length, kind="stable")
    return order, len(length) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), "right")


def forward(codes: np.ndarray, low: np.ndarray, high: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of reaching each state at the end of segments, and the order of the least strings that do."""
    order, active = _falling(high - low)
    cost, rank = np.full((len(low), 4), NEVER), np.tile(np.arange(4), (len(low), 1))
    cost[np.arange(len(low)), state[order]] = 0
    low = low[order]
    for t, m in enumerate(active.tolist()):
        code = codes[low[:m] + t]
        total = cost[:m, :, None] + COST[code]
        via = (total * 8 + rank[:m, :, None]).argmin(axis=1)
        row = np.arange(m)[:, None]
        key = rank[row, via] * 16 + EDIT[code][row, via, np.arange(4)]
        cost[:m] = np.minimum(total[row, via, np.arange(4)], NEVER)
        rank[:m] = key.argsort(axis=1, kind="stable").argsort(axis=1)
    back = np.argsort(order)
    return cost[back], rank[back]


def backward(codes: np.ndarray, low: np.ndarray, high: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from each state at the beginning of segments to their ends."""
    order, active = _falling(high - low)
    cost, high = end[order].copy(), high[order]
    for t, m in enumerate(active.tolist()):
        cost[:m] = np.minimum((COST[codes[high[:m] - 1 - t]] + cost[:m, None, :]).min(axis=2), NEVER)
    return cost[np.argsort(order)]


def solve(codes: np.ndarray, low: np.ndarray, high: np.ndarray, state: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each row of segments, and its edit, for first states and costs of last states."""
    before, edit = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    while len(low):
        one = high - low == 1
        at, p, code = low[one], state[one], codes[low[one]]
        q = ((COST[code, p] + end[one]) * 16 + EDIT[code, p]).argmin(axis=1)
        before[at], edit[at] = p, EDIT[code, p, q]
        low, high, state, end = low[~one], high[~one], state[~one], end[~one]
        middle = (low + high) // 2
        cost, rank = forward(codes, low, middle, state)
        crossing = ((cost + backward(codes, middle, high, end)) * 8 + rank).argmin(axis=1)
        there = np.where(np.arange(4) == crossing[:, None], 0, NEVER)
        low, high, state, end = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([state, crossing]), np.concatenate([there, end])
    return before, edit


def steps(code: int, before: int, edit: int) -> list[tuple[str, int]]:
    """Letters of a row's edit, each with the state behind it."""
    out, state = [], before
    for letter in "" if code == ABSENT else EDITS[edit]:
        if letter == "K":
            state = KEPT[state]["sua?"[code % 4]]
        elif letter != "D":
            state = NEXT[state]
        out.append((letter, state))
    return out


_ROW = ("turn", "role", "text", "hash", "present", "blank", "ended", "initial")


class _Stats:
    """What is counted in rows in order, and can be added up over blocks."""

    names = ("blank", "duplicate", "truncated", "illegal", "distinct_turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct_turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def feed(self, turn: int | None, initial: int, blank: bool, duplicate: bool, ended: bool) -> int:
        """Count a row; its code."""
        self.add(_one(turn, initial))
        if blank or duplicate:
            self.blank += blank
            self.duplicate += not blank
            return MUST_GO
        self.truncated += not ended
        return initial + 4 * (not ended)

    def add(self, other: _Stats) -> None:
        """The same of both, ``other`` being what follows."""
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        self.distinct_turns += other.distinct_turns
        if other.first_initial is not None:
            self.illegal += self.last_initial is not None and (self.last_initial, other.first_initial) not in ((0, 1), (1, 2), (2, 1))
            self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
            self.last_initial = other.last_initial
        if other.first_turn is not None:
            self.distinct_turns -= self.last_turn == other.first_turn
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct_turns

    def row(self) -> tuple:
        return tuple(getattr(self, n) for n in self.names)

    @classmethod
    def of(cls, row: tuple) -> _Stats:
        out = cls()
        for name, value in zip(cls.names, row, strict=True):
            setattr(out, name, value)
        return out


def _one(turn: int | None, initial: int) -> _Stats:
    out = _Stats()
    out.first_initial = out.last_initial = initial
    out.first_turn = out.last_turn = turn
    out.distinct_turns = turn is not None
    return out


class _Turns:
    """Every edit as a row: its block and place, letter, role and text, and the turn of the row it comes from."""

    keys = ("conv_id", "block")
    fields = ("block", "place", "turn", "edit", "role", "text")
    schema = "block long, place long, turn long, edit string, role string, text string"
    types = (*[pa.int64()] * 3, *[pa.string()] * 3)

    def __init__(self, conv_id, block: int = 0):
        self.conv_id, self.block, self.n, self.out = conv_id, block, 0, []

    def feed(self, letter: str, role: str, text: str, turn: int | None) -> None:
        self.out.append((self.conv_id, self.block, self.n, turn, letter, role, text))
        self.n += 1

    def ready(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def close(self, stats: _Stats, cost: int) -> list[tuple]:
        return self.ready()


class _Digest:
    """A row per conversation."""

    keys = ("conv_id",)
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    schema = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    types = (*[pa.int64()] * 6, pa.string(), pa.string())

    def __init__(self, conv_id, block: int = 0):
        self.conv_id, self.hash, self.audit, self.some = conv_id, hashlib.sha256(), [], False

    def feed(self, letter: str, role: str, text: str, turn: int | None) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True

    def ready(self) -> list[tuple]:
        return []

    def close(self, stats: _Stats, cost: int) -> list[tuple]:
        return [(self.conv_id, stats.gaps, stats.blank, stats.duplicate, stats.truncated, stats.illegal, cost, "".join(self.audit), self.hash.hexdigest())]


def _feed(sink: _Turns | _Digest, rows: list[tuple], codes: list[int], before: list[int], edits: list[int]) -> tuple[int, int]:
    """Hand rows (turn, role, text, ...) with their edits to a sink; the cost, and the last state."""
    cost = state = 0
    for (turn, role, text, *_), code, state, edit in zip(rows, codes, before, edits, strict=True):
        for letter, state in steps(code, state, edit):  # noqa: B020
            if letter == "I":
                sink.feed("I", ROLES[state], "", None)
                cost += 2
            else:
                sink.feed(letter, ROLES[state] if letter == "R" else role, text, turn)
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and 4 <= code < 8)
    return cost, state


def _finish(sink: _Turns | _Digest, state: int, stats: _Stats, cost: int) -> list[tuple]:
    for letter in TAILS[state]:
        state = NEXT[state]
        sink.feed(letter, ROLES[state], "", None)
        cost += 2
    return sink.close(stats, cost)


def sorted_rows(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows in ranges of their order, with their faults but for duplicates."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    bare = F.rtrim("text", F.lit(SPACES))
    known = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(known).cast("string"), F.lit(":"), known, F.length("role").cast("string"), F.lit(":"), "role", "text")))
    initial = reduce(lambda a, k: F.when(F.substring("role", 1, 1) == "sua"[k], k).otherwise(a), range(3), F.lit(3))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("present"))
    out = out.withColumns({"hash": digest, "blank": bare == "", "ended": F.right(bare, F.lit(1)).isin(".", "!", "?"), "initial": initial})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "hash", "present"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), *_ROW)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[tuple], bool]]:
    """Rows of one conversation, its id, partition, and whether all of it is here and fits one block."""
    now, first, rows, size, part = None, True, [], 0, 0
    cut_before = True  # the partition before may hold the beginning
    for batch in small(batches):
        for conv, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first or conv != now:
                if not first:
                    yield now, part, rows, not cut_before
                    cut_before = False
                now, first, rows, size = conv, False, [], 0
            elif len(rows) >= BLOCK or size >= BYTES:
                yield now, part, rows, False
                rows, size, cut_before = [], 0, True
            rows.append(tuple(row))
            size += len(row[2])
    if not first:
        yield now, part, rows, False


def _first_pass(kind: type, conv_kind: str):
    """Repair what lies whole inside a partition, and hand on the rows of the rest in blocks."""
    names = ["conv_id", "done", *kind.fields, "at_block", "seq", "at_turn", "at_role", "at_text", "hash", "present", "blank_row", "ended", "initial", "first"]
    schema = f"conv_id {conv_kind}, done boolean, {kind.schema}, at_block long, seq int, at_turn long, at_role string, at_text string, hash binary, present boolean, blank_row boolean, ended boolean, initial int, first boolean"
    own = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, waiting, n_waiting, n_blocks = None, [], 0, 0

        def seen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in stream:
                conv_type = batch.column("conv_id").type
                yield batch

        def out(rows: list[tuple], done: bool) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), 1000):
                cols = list(zip(*rows[a : a + 1000], strict=True))
                given = [pa.array(cols[0], conv_type), pa.array([done] * len(cols[0]))]
                types = kind.types if done else own
                values = [pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]
                empty = [pa.nulls(len(cols[0]), t) for t in (own if done else kind.types)]
                yield pa.RecordBatch.from_arrays([*given, *(values + empty if done else empty + values)], names=names)

        def repaired() -> list[tuple]:
            stats, codes = [], []
            for _, rows in waiting:
                stats.append(_Stats())
                known: set[bytes] = set()
                for turn, _, _, digest, present, blank, ended, initial in rows:
                    codes.append(stats[-1].feed(turn, initial, blank, digest in known, ended) if present else ABSENT)
                    if present:
                        known.add(digest)
            high = np.cumsum([len(rows) for _, rows in waiting])
            low = np.concatenate([[0], high[:-1]])
            codes = np.array(codes)
            before, edits = solve(codes, low, high, np.zeros(len(low), np.int64), np.tile(_TAIL, (len(low), 1)))
            made = []
            for (conv, rows), s, a, b in zip(waiting, stats, low.tolist(), high.tolist(), strict=True):
                sink = kind(conv)
                cost, state = _feed(sink, rows, codes[a:b].tolist(), before[a:b].tolist(), edits[a:b].tolist())
                made += _finish(sink, state, s, cost)
            waiting.clear()
            return made

        for conv, part, rows, whole in _split(seen(batches)):
            if whole:
                waiting.append((conv, rows))
                n_waiting += len(rows)
                if n_waiting >= AT_ONCE:
                    yield from out(repaired(), True)
                    n_waiting = 0
            else:
                known: set[bytes] = set()
                block, held = (part << 32) + n_blocks, []
                n_blocks += 1
                for seq, row in enumerate(rows):
                    held.append((conv, block, seq, *row, row[4] and row[3] not in known))
                    if row[4]:
                        known.add(row[3])
                yield from out(held, False)
        if waiting:
            yield from out(repaired(), True)

    return run, schema


def _blocks(rows: DataFrame, conv_kind: str) -> DataFrame:
    """A row per block: codes of its rows, what is counted in them, and the matrix of costs between states."""
    firsts = rows.where("first").select("hash", "block", "seq")
    repeated = firsts.groupBy("hash").agg(F.min("block").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "least")
    again = firsts.join(repeated, "hash").where("block > least").select("block", "seq", F.lit(True).alias("again"))
    narrow = rows.select("conv_id", "block", "seq", "at_turn", "present", "blank_row", "ended", "initial", "first").join(again, ["block", "seq"], "left")
    counts = ", ".join(f"{n} long" for n in _Stats.names)

    def summary(t: pa.Table) -> pa.RecordBatch:
        stats, codes = _Stats(), []
        for turn, present, blank, ended, initial, first, late in zip(*(t[c].to_pylist() for c in ("at_turn", "present", "blank_row", "ended", "initial", "first", "again")), strict=True):
            codes.append(stats.feed(turn, initial, blank, not first or bool(late), ended) if present else ABSENT)
        codes = np.array(codes)
        cost, rank = forward(codes, np.zeros(4, np.int64), np.full(4, len(codes)), np.arange(4))
        given = [t["conv_id"].slice(0, 1).combine_chunks(), t["block"].slice(0, 1).combine_chunks(), pa.array([codes.astype(np.uint8).tobytes()], pa.binary())]
        cells = [pa.array([None if v is None else int(v)], pa.int64()) for v in stats.row()]
        return pa.RecordBatch.from_arrays([*given, *cells, pa.array([cost.ravel().tolist()]), pa.array([rank.ravel().tolist()])], names=["conv_id", "block", "codes", *_Stats.names, "costs", "ranks"])

    return grouped(narrow, ["block"], ["seq"], summary, f"conv_id {conv_kind}, block long, codes binary, {counts}, costs array<long>, ranks array<long>")


def _crossings(matrices: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, list[int]]]:
    """First state and costs of last states of each of a conversation's blocks."""
    out: list = [None] * len(matrices)
    todo = [(0, len(matrices), START, _TAIL)]
    while todo:
        low, high, state, end = todo.pop()
        if high - low == 1:
            out[low] = (state, end.tolist())
            continue
        middle = (low + high) // 2
        cost, rank = np.where(np.arange(4) == state, 0, NEVER), np.arange(4)
        for costs, ranks in matrices[low:middle]:
            total = cost[:, None] + costs
            via = (total * 8 + rank[:, None]).argmin(axis=0)
            cost = np.minimum(total[via, range(4)], NEVER)
            rank = (rank[via] * 16 + ranks[via, range(4)]).argsort(kind="stable").argsort()
        back = end
        for costs, _ in reversed(matrices[middle:high]):
            back = np.minimum((costs + back).min(axis=1), NEVER)
        crossing = int(((cost + back) * 8 + rank).argmin())
        todo += [(low, middle, state, np.where(np.arange(4) == crossing, 0, NEVER)), (middle, high, crossing, end)]
    return out


def _ways(t: pa.Table) -> pa.RecordBatch:
    """How each block of one conversation begins and ends."""
    square = lambda c: [np.array(x).reshape(4, 4) for x in t[c].to_pylist()]
    found = _crossings(list(zip(square("costs"), square("ranks"), strict=True)))
    last = np.arange(len(found)) == len(found) - 1
    ends = pa.array([end for _, end in found], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([t["block"].combine_chunks(), pa.array([s for s, _ in found], pa.int32()), ends, pa.array(last)], names=["block", "state", "end", "last"])


def _planned(blocks: DataFrame, conv_kind: str) -> DataFrame:
    """The edits of each block: state and edit of each row, as bytes."""
    ways = grouped(blocks.select("conv_id", "block", "costs", "ranks"), ["conv_id"], ["block"], _ways, "block long, state int, end array<long>, last boolean")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 16):
            if not batch.num_rows:
                continue
            each = [np.frombuffer(b, np.uint8) for b in batch.column("codes").to_pylist()]
            high = np.cumsum(list(map(len, each)))
            low = np.concatenate([[0], high[:-1]])
            before, edit = solve(np.concatenate(each), low, high, batch.column("state").to_numpy().astype(np.int64), np.array(batch.column("end").to_pylist()))
            both = (before * 16 + edit).astype(np.uint8)
            cols = {n: batch.column(n) for n in batch.schema.names if n not in ("state", "end")}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([both[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary())], names=[*cols, "plan"])

    counts = ", ".join(f"{n} long" for n in _Stats.names)
    joined = blocks.join(ways, "block").select("conv_id", "block", "codes", *_Stats.names, "last", "state", "end")
    return joined.mapInArrow(plan, f"conv_id {conv_kind}, block long, codes binary, {counts}, last boolean, plan binary")


def _rest(rows: DataFrame, kind: type, conv_kind: str) -> DataFrame:
    """What ``kind`` makes of conversations in blocks."""
    plans = _planned(cut(_blocks(rows, conv_kind), "blocks"), conv_kind)
    texts = rows.select("conv_id", "block", "seq", "at_turn", "at_role", "at_text")
    both = texts.unionByName(plans.withColumn("seq", F.lit(-1)), allowMissingColumns=True)
    order = both.repartition(*kind.keys).sortWithinPartitions("conv_id", "block", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, now, n, cost, last = None, None, 0, 0, False
        stats = _Stats()
        for batch in small(batches):
            made: list[tuple] = []
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, seq in enumerate(cols["seq"]):
                if seq == -1:
                    unit = tuple(cols[k][i] for k in kind.keys)
                    if sink is None or unit != now:
                        sink, now, cost, stats = kind(cols["conv_id"][i], cols["block"][i]), unit, 0, _Stats()
                    stats.add(_Stats.of(tuple(cols[c][i] for c in _Stats.names)))
                    codes, plan, last = cols["codes"][i], cols["plan"][i], cols["last"][i]
                    n = len(codes)
                    continue
                more, state = _feed(sink, [(cols["at_turn"][i], cols["at_role"][i], cols["at_text"][i])], [codes[seq]], [plan[seq] >> 4], [plan[seq] & 15])
                cost += more
                if seq == n - 1 and last:
                    made += _finish(sink, state, stats, cost)
                else:
                    made += sink.ready()
            if made:
                out = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.column("conv_id").type, *kind.types), strict=True)], names=["conv_id", *kind.fields])

    return order.mapInArrow(run, f"conv_id {conv_kind}, {kind.schema}")


def _made(rows: DataFrame, kind: type, present: Column | None) -> DataFrame:
    conv_kind = dict(rows.select("conv_id").dtypes)["conv_id"]
    run, schema = _first_pass(kind, conv_kind)
    first = cut(sorted_rows(rows, present).mapInArrow(run, schema), "repaired")
    done = first.where("done").select("conv_id", *kind.fields)
    left = first.where("NOT done").select("conv_id", F.col("at_block").alias("block"), "seq", "at_turn", "at_role", "at_text", "hash", "present", "blank_row", "ended", "initial", "first")
    return done.unionByName(_rest(left, kind, conv_kind))


def repaired_turns(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """Every edit of conversations (conv_id, turn, role, text), in order of block and place within a conversation.

    edit is D for a row that goes, K for one that stays, R for one with another
    role, and I for an inserted turn; the repaired conversation is all but D.
    """
    return _made(rows, _Turns, present)


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """A row per conversation: its faults, the cost and initials of its edits, and the hash of what it becomes.

    Rows for which ``present`` does not hold have no part in it, but their
    conversations are returned.
    """
    return _made(rows, _Digest, present)
