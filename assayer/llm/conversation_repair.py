"""Repair of conversation structure: cheapest edits by dynamic programming, the least audit by prefix doubling.

A conversation is edited so that its roles read as an optional system turn and pairs of user and assistant.  A node is a
place between two rows and what may come next; an edit is an arc.  After the costs to the end are known, only arcs of
cheapest paths stay.  Every node gets a rank by its audit's first letter, then, with pointers doubled each time, by its first
2, 4, 8 ... letters; the least path follows the doubled pointers, and nodes of one final rank share their audit.

Rows are put in order by ranges of (conversation, turn, role, text), so a conversation with a third of all rows spans a third
of the ranges.  It is cut into pieces of bounded size: a piece's costs from any state to any other are a small matrix, the
matrices of a conversation are chained backwards, and then the pieces are solved side by side.  Only the chaining and the
hash of the repaired text, which has to be fed in order, go through a conversation's pieces one after the other, in a
stream.  Equal rows are counted before any of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col
from assayer.llm.common import small_batches, stored

# Edit costs, letters in ASCII order, fault and role rules.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LETTERS = "DIKR"
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = frozenset(("su", "ua", "au"))

#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
STATES = 4
START = 0
NEXT = np.array([2, 2, 3, 2])
_ROLE = {1: "user", 0: "assistant"}  # what an inserted or rerolled turn is, by whether it leads to state 2
_CLASS = {"s": 0, "u": 1, "a": 2}
#: State after keeping a row of class system, user, assistant, other; -1: not allowed.
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Cost from a state to the end when no row is left: the turns still to be inserted.
LAST = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40

PIECE_ROWS, PIECE_CHARS = 1024, 1 << 17
FLUSH_ROWS, FLUSH_CHARS = 20_000, 1 << 23


@dataclass
class Piece:
    """Consecutive rows of a conversation: rows that may stay one by one, rows that must go as counts before them."""

    conv: int | None
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)  # whether a row that may stay is truncated
    gone: list[int] = field(default_factory=list)  # rows that must go before each of them
    tail: int = 0  # and after the last
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    illegal: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, n: int, blank: bool, text: str | None) -> None:
        """``n`` equal rows; ``text`` where they are the first of their role and text, and not blank."""
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.illegal += n - 1
        self.last_initial = initial
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            self.blank += n
        elif text is None:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.roles.append(role)
            self.texts.append(text)
            self.cut.append(int(text.rstrip(SPACE)[-1] not in ENDS))
            self.gone.append(self.tail)
            self.chars += len(text)
            self.tail = n - 1
            return
        self.tail += n

    @property
    def deleted(self) -> int:
        return sum(self.gone) + self.tail


class Solved:
    """Costs and least audits of pieces, from any state at their start."""

    def __init__(self, pieces: Sequence[Piece], ends: Sequence[Sequence[int]]):
        """``ends``: for each piece the cost to the conversation's end from every state behind it."""
        size = np.array([len(p.roles) for p in pieces])
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # first layer of each piece
        layers = int(size.sum()) + len(pieces)
        kind, cut = np.full(layers, 3), np.zeros(layers, dtype=np.int64)
        inside = np.ones(layers, dtype=bool)
        last = self.first + size
        inside[last] = False
        kind[inside] = [_CLASS.get(r[:1], 3) for p in pieces for r in p.roles]
        cut[inside] = [c for p in pieces for c in p.cut]
        self.cost = np.full((layers, STATES), FAR, dtype=np.int64)
        self.cost[last] = ends
        order = np.argsort(-size, kind="stable")
        longest = np.sort(-size)
        for step in range(1, int(size.max(initial=0)) + 1):
            at = last[order[:np.searchsorted(longest, -step, side="right")]] - step
            self.cost[at] = self._step(self.cost[at + 1], kind[at], cut[at])
        self._arcs(kind, cut, inside)
        self._double()

    @staticmethod
    def _step(then: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Costs before rows from the costs behind them."""
        done = np.minimum(then + DELETE, Solved._kept(then, kind) + cut[:, None])
        done = np.minimum(done, then[:, NEXT] + (REROLE + cut)[:, None])
        return np.minimum(done, np.minimum(done[:, NEXT] + INSERT, done[:, NEXT[NEXT]] + 2 * INSERT))

    @staticmethod
    def _kept(then: np.ndarray, kind: np.ndarray) -> np.ndarray:
        to = _KEPT[kind]
        return np.where(to >= 0, np.take_along_axis(then, np.maximum(to, 0), axis=1), FAR)

    def _arcs(self, kind: np.ndarray, cut: np.ndarray, inside: np.ndarray) -> None:
        """Each node's optimal arc of the least letter: a letter leads from a node to one other node only."""
        layer = np.flatnonzero(inside)
        now, then = self.cost[layer], self.cost[layer + 1]
        spent = [then + DELETE, now[:, NEXT] + INSERT, self._kept(then, kind[layer]) + cut[layer, None], then[:, NEXT] + (REROLE + cut[layer])[:, None]]
        letter = np.argmax(np.stack(spent) == now, axis=0)
        behind = (layer + 1)[:, None] * STATES
        here = layer[:, None] * STATES
        states = np.arange(STATES)
        to = np.choose(letter, [behind + states, here + NEXT, behind + np.maximum(_KEPT[kind[layer]], 0), behind + NEXT])
        self.letter = np.zeros((len(inside), STATES), dtype=np.int64)  # 0: no row left
        self.letter[layer] = letter + 1
        self.to = np.arange(len(inside) * STATES).reshape(-1, STATES)
        self.to[layer] = to

    def _double(self) -> None:
        """Ranks by the first 1, 2, 4 ... letters of the audits until no pointer moves; ``jumps`` are the doubled pointers."""
        rank, to = self.letter.ravel(), self.to.ravel()
        length = (rank > 0).astype(np.int64)
        jumps = [to]
        while (length[to] > 0).any():
            _, rank = np.unique(rank * (rank.max() + 1) + rank[to], return_inverse=True)
            length, to = length + length[to], to[to]
            jumps.append(to)
        self.rank, self.jumps, self.length = rank, jumps, length

    def audits(self, piece: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audits of pieces from a state, and the states behind them; equal ranks are read once."""
        start = self.first[piece] * STATES + state
        _, one, which = np.unique(self.rank[start], return_index=True, return_inverse=True)
        begin = start[one]
        length = self.length[begin]
        node = np.repeat(begin, length)
        step = np.arange(len(node)) - np.repeat(np.cumsum(length) - length, length)
        for k, jump in enumerate(self.jumps):
            node = np.where(step >> k & 1, jump[node], node)
        letters = np.frombuffer(LETTERS.encode(), dtype=np.uint8)[self.letter.ravel()[node] - 1].tobytes().decode()
        stops = np.cumsum(length).tolist()
        own = [letters[a:b] for a, b in zip([0, *stops], stops)]
        return [own[w] for w in which.tolist()], self.jumps[-1][start] % STATES

    def matrix(self) -> np.ndarray:
        return self.cost[self.first]


def matrices(pieces: Sequence[Piece]) -> list[list[int]]:
    """For each piece the costs from every state (first index) to every state behind it, row after row."""
    columns = []
    for to in range(STATES):
        ends = [[0 if s == to else FAR for s in range(STATES)]] * len(pieces)
        columns.append(Solved(pieces, ends).matrix())
    return np.minimum(np.stack(columns, axis=2), FAR).reshape(len(pieces), -1).tolist()


def edited(piece: Piece, audit: str, state: int) -> tuple[str, list[str]]:
    """The audit with the rows that must go, and the turns that stay as ``role:text``."""
    full, turns, row = [], [], 0
    pending = True
    for letter in audit:
        if pending:
            full.append("D" * piece.gone[row])
            pending = False
        full.append(letter)
        if letter == "K":
            turns.append(f"{piece.roles[row]}:{piece.texts[row]}")
            state = int(_KEPT[_CLASS[piece.roles[row][:1]], state])
        elif letter != "D":
            role = _ROLE[int(NEXT[state] == 2)]
            turns.append(f"{role}:{piece.texts[row] if letter == 'R' else ''}")
            state = int(NEXT[state])
        if letter != "I":
            row, pending = row + 1, True
    return "".join(full) + "D" * piece.tail, turns


def closing(state: int) -> tuple[str, list[str]]:
    """What is inserted when no row is left."""
    turns = {1: ["user:", "assistant:"], 2: ["assistant:"]}.get(state, [])
    return "I" * len(turns), turns


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): ``n`` adjacent copies of every row after the damage, 0 for a dropped one; nulls in texts are a space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(as_col("conv_id").cast("string"), blank), F.coalesce(as_col("turn").cast("string"), blank))
    rows = table.select(as_col("conv_id").cast("long").alias("conv_id"), as_col("turn").cast("long").alias("turn"),
                        F.coalesce(as_col("role").cast("string"), blank).alias("role"), F.coalesce(as_col("text").cast("string"), blank).alias("text"),
                        (F.crc32(name) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("n"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, blank, text, part) in ranges: equal rows as a count, and the text once, at the first of its
    conversation, role and text."""
    blank = F.rtrim(F.col("text"), F.lit(SPACE)) == ""
    h = F.when(F.col("n") > 0, F.md5("text")).otherwise("")
    tally = (rows.select("conv_id", F.when(F.col("n") > 0, F.col("turn")).alias("turn"), F.when(F.col("n") > 0, F.col("role")).otherwise("").alias("role"),
                         h.alias("h"), (blank & (F.col("n") > 0)).alias("blank"), "n")
             .groupBy("conv_id", "turn", "role", "h", "blank").agg(F.sum("n").alias("n")))
    first = rows.where((F.col("n") > 0) & ~blank).groupBy("conv_id", "role", "text").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    first = first.select("conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", F.md5("text").alias("h"), "text")
    both = tally.withColumn("text", F.lit(None).cast("string")).unionByName(first, allowMissingColumns=True)
    order = ["conv_id", "turn", "role", "h"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").isNull()).withColumn("part", F.spark_partition_id())


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = ("part int, piece long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, tail long, "
          "roles array<string>, texts array<string>, cut array<int>, gone array<long>, costs array<long>")
_COUNTS = ("blank", "duplicate", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns", "tail", "roles", "texts", "cut", "gone")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], names=[n for n, _ in fields])


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _results(whole: list[Piece]) -> list[dict]:
    """The rows of conversations that are one piece each."""
    solved = Solved(whole, [LAST] * len(whole))
    audits, states = solved.audits(np.arange(len(whole)), np.zeros(len(whole), dtype=np.int64))
    out = []
    for p, audit, state, cost in zip(whole, audits, states.tolist(), solved.matrix()[:, START].tolist()):
        full, turns = edited(p, audit, START)
        more, added = closing(state)
        out.append({"conv_id": p.conv, "gaps": _gaps(p.first_turn, p.last_turn, p.turns), "blank": p.blank, "duplicate": p.duplicate,
                    "truncated": sum(p.cut), "illegal": p.illegal, "cost": cost + DELETE * p.deleted, "audit": full + more,
                    "repaired_sha256": hashlib.sha256("\n".join(turns + added).encode()).hexdigest()})
    return out


def _cut_up(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, Piece, bool]]:
    """(range, piece, whether it is a whole conversation) from the ordered rows of a range.

    The first and last conversation of a range may go on in another one.
    """
    now, closed, text, first = None, False, None, True
    for b in batches:
        for conv, turn, role, n, blank, own, part in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
            if own is not None:  # its count is the next row
                text = own
                continue
            if now is None:
                now, range_no = Piece(conv), part
            elif conv != now.conv:
                yield range_no, now, not (first or closed)
                now, closed, first = Piece(conv), False, False
            elif len(now.roles) >= most or now.chars >= PIECE_CHARS:
                yield range_no, now, False
                now, closed = Piece(conv), True
            if n:
                now.add(turn, role, n, blank, text)
            text = None
    if now is not None:
        yield range_no, now, False


def _pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie within a range and a piece, and pieces of the others."""
    schema = f"{_RESULT}, {_PIECE}"
    whole, parted, rows, chars, number = [], [], 0, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        out = _results(whole) if whole else []
        if parted:
            for (part, own, p), costs in zip(parted, matrices([p for *_, p in parted])):
                out.append({"conv_id": p.conv, "part": part, "piece": own, "costs": costs, **{c: getattr(p, c) for c in _COUNTS}})
        if out:
            yield _batch(out, schema)
        whole.clear(), parted.clear()

    for part, p, alone in _cut_up(batches, most):
        if alone:
            whole.append(p)
        else:
            parted.append((part, number, p))
        rows, chars, number = rows + len(p.roles) + 1, chars + p.chars, number + 1
        if rows >= FLUSH_ROWS or chars >= FLUSH_CHARS:
            yield from flush()
            rows = chars = 0
    yield from flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(b.num_rows):
            yield b.slice(at, 1).to_pylist()[0]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost to the end behind each piece; pieces come from the last to the first."""
    out = []
    for _, own in groupby(_rows(batches), lambda r: r["conv_id"]):
        end = np.array(LAST)
        for r in own:
            out.append({"part": r["part"], "piece": r["piece"], "ends": end.tolist()})
            end = np.minimum((np.array(r["costs"]).reshape(STATES, STATES) + end).min(axis=1), FAR)
            if len(out) == FLUSH_ROWS:
                yield _batch(out, "part int, piece long, ends array<long>")
                out = []
    if out:
        yield _batch(out, "part int, piece long, ends array<long>")


def _piece(row: dict) -> Piece:
    return Piece(row["conv_id"], **{c: row[c] for c in _COUNTS})


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their least audit from every state, the state it leads to, and the cost to the conversation's end."""
    for b in batches:
        rows = b.to_pylist()
        solved = Solved([_piece(r) for r in rows], [r["ends"] for r in rows])
        each, states = np.repeat(np.arange(len(rows)), STATES), np.tile(np.arange(STATES), len(rows))
        audits, to = solved.audits(each, states)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([audits[i:i + STATES] for i in range(0, len(audits), STATES)], pa.list_(pa.string())),
             pa.array(to.reshape(-1, STATES).tolist(), pa.list_(pa.int64())), pa.array(solved.matrix().tolist(), pa.list_(pa.int64()))],
            names=[*b.schema.names, "audits", "to", "whole"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; what is held is the audit and the state of the hash."""
    for conv, own in groupby(_rows(batches), lambda r: r["conv_id"]):
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        state, audit, sha, any_turn, turns = START, [], hashlib.sha256(), False, 0
        initial = first = last = None
        for k, row in enumerate(own):
            p = _piece(row)
            out["cost"] += DELETE * p.deleted + (row["whole"][state] if k == 0 else 0)
            out["blank"], out["duplicate"], out["truncated"] = out["blank"] + p.blank, out["duplicate"] + p.duplicate, out["truncated"] + sum(p.cut)
            out["illegal"] += p.illegal + (initial is not None and p.first_initial is not None and initial + p.first_initial not in LEGAL)
            initial = initial if p.last_initial is None else p.last_initial
            turns += p.turns - (p.first_turn is not None and p.first_turn == last)
            first = p.first_turn if first is None else first
            last = last if p.last_turn is None else p.last_turn
            full, kept = edited(p, row["audits"][state], state)
            state = row["to"][state]
            audit.append(full)
            for t in kept:
                sha.update((("\n" if any_turn else "") + t).encode())
                any_turn = True
        more, added = closing(state)
        for t in added:
            sha.update((("\n" if any_turn else "") + t).encode())
            any_turn = True
        yield _batch([{"conv_id": conv, "gaps": _gaps(first, last, turns), **out, "audit": "".join(audit) + more,
                       "repaired_sha256": sha.hexdigest()}], _RESULT)


def repaired(table: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after ``damaged``.

    Null roles and texts are a space, null turns come first, a null conv_id is a conversation of its own.  Rows of one turn are
    ordered by role, then by the MD5 of their text, so equal rows are adjacent; other columns are not read.  A conversation
    without rows after the damage has zeros, an empty audit and the hash of nothing; an empty table gives no rows.
    """
    small_batches(table.sparkSession)
    rows = ordered(damaged(table)).select("conv_id", "turn", "role", "n", "blank", "text", "part")
    solved = stored(rows.mapInArrow(partial(_pieces, most=piece_rows), f"{_RESULT}, {_PIECE}"), "conversations")
    names = [f.split(" ")[0] for f in _RESULT.split(", ")]
    done = solved.where("costs IS NULL").select(*names)
    pieces = solved.where("costs IS NOT NULL").drop("gaps", "truncated", "cost", "audit", "repaired_sha256")
    back = pieces.select("conv_id", "part", "piece", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))
    ends = back.mapInArrow(_chained, "part int, piece long, ends array<long>")
    held = pieces.join(ends, ["part", "piece"]).drop("costs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    audited = held.mapInArrow(_audited, f"{fields}, audits array<string>, `to` array<long>, whole array<long>")
    parted = audited.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_joined, _RESULT)
    return done.unionByName(parted)
