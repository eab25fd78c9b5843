"""Operator 13: repair of conversation structure, by Hirschberg's divide and conquer.

Method.  A conversation is repaired to the role initials ``(s?(ua)+)?`` by the
cheapest edits: keep a turn (0), give it the role user or assistant (2),
delete it (3; a must for blank and repeated turns), insert an empty turn (2);
a truncated turn that stays costs 1.  Four states tell what stands before a
place: nothing, the system turn, a user turn, an assistant turn.  A forward
vector holds the least cost to reach each state from the left together with
the order of the four least audits (the edits' initials), a backward vector
the least cost from each state to the end.  The two meet in the middle; of the
states whose sums are least, the one whose audit is least is crossed, and both
halves are solved alike, so only two vectors are held at a time.

Audits that end in the same number of turns never begin one another, so the
order of the left parts decides between crossings, and a forward step needs
only the order, never the audits.

The rows of all conversations are range-partitioned in order and cut into
blocks, each a 4 x 4 table of costs and orders, so a conversation of any
length is read by many tasks: its blocks' tables go through the same divide
and conquer, which fixes the states at the blocks' ends, and then each block
is solved on its own.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.frames import written
from tickflow.llm.text import tidy

#: Rows of one block (a byte each).
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: States: nothing before, a system turn, a user turn, an assistant turn; what may follow each, and the state after.
STATES = range(4)
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or re-roled turn gets in each state.
ROLES = ("user", "user", "assistant", "user")
#: Inserts that finish a conversation from each state.
TAIL = (0, 2, 1, 0)
WHITE = "\t\n\x0b\x0c\r "

Vector = tuple[tuple[int, ...], tuple[int, ...]]
Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


def symbol(initial: str, gone: bool, unfinished: bool) -> int:
    """A turn as one byte: its role's initial, whether it must go, whether it is truncated."""
    kind = "sua".find(initial) if initial else -1
    return (kind + 1) * 4 + 2 * gone + unfinished


@cache
def moves(code: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """For each state before and after a turn the least cost, and of the edits of that cost the least initials."""
    initial, gone, unfinished = " sua"[code // 4], code // 2 % 2, code % 2
    out = []
    for p in STATES:
        best = [(NEVER, "")] * 4
        q, inserted = p, 0
        while inserted < 3:  # two inserts lead back to where one could be
            cost, head = inserted * INSERT, "I" * inserted
            ways = [(cost + DELETE, head + "D", q)]
            if not gone:
                stay = cost + unfinished * UNFINISHED
                if initial in FOLLOWS[q]:
                    ways.append((stay + KEEP, head + "K", FOLLOWS[q][initial]))
                ways.append((stay + REROLE, head + "R", FOLLOWS[q][ROLES[q][0]]))
            for way, letters, to in ways:
                best[to] = min(best[to], (way, letters))
            q, inserted = FOLLOWS[q][ROLES[q][0]], inserted + 1
        out.append(tuple(best))
    return tuple(out)


@cache
def table_of(code: int) -> Table:
    """Costs, and for each state before the order of the states after by their least initials."""
    rows = moves(code)
    costs = tuple(tuple(cost for cost, _ in row) for row in rows)
    orders = tuple(tuple(sorted(letters for _, letters in row).index(letters) for _, letters in row) for row in rows)
    return costs, orders


def start_at(state: int) -> Vector:
    return tuple(0 if q == state else NEVER for q in STATES), (0, 0, 0, 0)


def advance(vector: Vector, table: Table) -> tuple[int, Vector]:
    """The forward vector after one more turn or block, less its least cost, which comes first."""
    (costs, ranks), (more, orders) = vector, table
    reached = []
    for q in STATES:
        cost, rank, p = min((min(costs[p] + more[p][q], NEVER), ranks[p], p) for p in STATES)
        reached.append((cost, (rank, orders[p][q]) if cost < NEVER else (9, q)))
    least = min(cost for cost, _ in reached)
    by_audit = sorted(key for _, key in reached)
    return least, (tuple(cost - least if cost < NEVER else NEVER for cost, _ in reached),
                   tuple(by_audit.index(key) for _, key in reached))


def retreat(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """The backward vector before one more turn or block, less its least cost."""
    out = [min(min(table[0][p][q] + costs[q], NEVER) for q in STATES) for p in STATES]
    least = min(out)
    return tuple(cost - least if cost < NEVER else NEVER for cost in out)


@lru_cache(maxsize=1 << 14)
def advance_turn(vector: Vector, code: int) -> tuple[int, Vector]:
    """:func:`advance` by a turn: few different vectors ever arise."""
    return advance(vector, table_of(code))


@lru_cache(maxsize=1 << 14)
def retreat_turn(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    return retreat(costs, table_of(code))


def crossings(items, first: int, last: int, forward: Callable = advance_turn, back: Callable = retreat_turn) -> list[int]:
    """The states at all borders of ``items`` on the cheapest way from ``first`` to ``last`` whose audit is least."""
    if len(items) == 1:
        return [first, last]
    middle = len(items) // 2
    vector, costs = start_at(first), start_at(last)[0]
    for item in items[:middle]:
        vector = forward(vector, item)[1]
    for item in reversed(items[middle:]):
        costs = back(costs, item)
    at = min(STATES, key=lambda q: (vector[0][q] + costs[q], vector[1][q]))
    return crossings(items[:middle], first, at, forward, back) + crossings(items[middle:], at, last, forward, back)[1:]


def end_state(vector: Vector) -> int:
    """Where the cheapest way ends, before the inserts that finish it."""
    return min(STATES, key=lambda q: (vector[0][q] + TAIL[q] * INSERT, vector[1][q]))


def summary(symbols: bytes) -> Table:
    """Costs and orders of a block of turns."""
    costs, orders = [], []
    for p in STATES:
        total, vector = 0, start_at(p)
        for code in symbols:
            least, vector = advance_turn(vector, code)
            total += least
        costs.append(tuple(cost + total if cost < NEVER else NEVER for cost in vector[0]))
        orders.append(vector[1])
    return tuple(costs), tuple(orders)


@lru_cache(maxsize=1 << 12)
def edits_of(symbols: bytes, first: int, last: int) -> tuple[str, ...]:
    """The initials of each turn's edits (inserts before it, then its own) between two states."""
    path = crossings(symbols, first, last)
    return tuple(moves(code)[p][q][1] for code, p, q in zip(symbols, path, path[1:]))


def _forget() -> None:
    for held in (advance_turn, retreat_turn, edits_of):
        held.cache_clear()


_FAULTS = ("blank", "duplicate", "truncated")
_BLOCK_FIELDS = [("seq", pa.int32()), ("symbols", pa.binary()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())),
                 ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                 ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("illegal", pa.int64()),
                 *((name, pa.int64()) for name in _FAULTS)]


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Block:
    """A block being filled with the rows of one conversation, in order."""

    def __init__(self, c, t, r, d, seq: int):
        self.key, self.seq = (c, t, r, d), seq
        self.symbols, self.initials = bytearray(), []
        self.faults = dict.fromkeys(_FAULTS, 0)
        self.times: list[int] = []  # the turns with a number, as they change
        self.first_turn = self.last_turn = None
        self.illegal = 0
        self.last = None

    def add(self, t, role: str, blank: bool, duplicate: bool, unfinished: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first, self.first_turn = initial, t
        elif not _legal(self.last, initial):
            self.illegal += 1
        if t is not None and (not self.times or self.times[-1] != t):
            self.times.append(t)
        self.last, self.last_turn = initial, t
        for name, has in zip(_FAULTS, (blank, duplicate, unfinished)):
            if has:
                self.faults[name] += 1
                break
        self.symbols.append(symbol(initial, blank or duplicate, unfinished))

    def values(self) -> list:
        costs, orders = summary(bytes(self.symbols))
        ends = (self.times[0], self.times[-1]) if self.times else (None, None)
        return [*self.key, self.seq, bytes(self.symbols), [x for row in costs for x in row], [x for row in orders for x in row],
                self.first, self.last, self.first_turn, self.last_turn, *ends, len(self.times), self.illegal,
                *self.faults.values()]


def _batch(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, (_, kind) in enumerate(fields)],
                                      names=[name for name, _ in fields])


def _cut(size: int):
    """Blocks of rows (c, t, r, d, copies, blank, unfinished, seen) that come in order; ``part`` tells the tasks apart."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fields, block, seq, done = None, None, 0, []
        for batch in batches:
            if fields is None:
                fields = [(k, batch.schema.field(k).type) for k in ("c", "t", "r", "d")] + _BLOCK_FIELDS + [("part", pa.int32())]
            for c, t, r, d, copies, blank, unfinished, seen in zip(*(x.to_pylist() for x in batch.columns)):
                for copy in range(copies):
                    if block is None or block.key[0] != c or len(block.symbols) == size:
                        if block is not None:
                            done.append([*block.values(), part])
                        block, seq = _Block(c, t, r, d, seq), seq + 1
                    block.add(t, r, blank, seen or copy > 0, unfinished)
                    if len(done) >= 512:
                        yield _batch(done, fields)
                        done = []
        if block is not None:
            yield _batch([*done, [*block.values(), part]], fields)
    return run


_TOTALS = [("gaps", pa.int64()), *((name, pa.int64()) for name in _FAULTS), ("illegal", pa.int64()), ("cost", pa.int64())]
_ENDS = [("part", pa.int32()), ("seq", pa.int32()), ("state_in", pa.int32()), ("state_out", pa.int32()), ("tail", pa.int32())]


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the ends of each block; a conversation's totals go with its first block."""
    fields, now, blocks = None, None, []

    def solved() -> list[list]:
        tables = [(tuple(tuple(b["costs"][4 * p:4 * p + 4]) for p in STATES),
                   tuple(tuple(b["orders"][4 * p:4 * p + 4]) for p in STATES)) for b in blocks]
        cost, vector = 0, start_at(0)
        for table in tables:
            least, vector = advance(vector, table)
            cost += least
        last = end_state(vector)
        cost += vector[0][last] + TAIL[last] * INSERT
        path = crossings(tables, 0, last, advance, retreat)
        pairs = list(zip(blocks, blocks[1:]))
        low = min((b["low"] for b in blocks if b["low"] is not None), default=None)
        high = max((b["high"] for b in blocks if b["high"] is not None), default=None)
        turns = sum(b["turns"] for b in blocks) - sum(
            a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
        illegal = sum(b["illegal"] for b in blocks) + sum(not _legal(a["last"], b["first"]) for a, b in pairs)
        totals = [0 if low is None else high - low + 1 - turns, *(sum(b[name] for b in blocks) for name in _FAULTS), illegal, cost]
        return [[b["c"], b["part"], b["seq"], p, q, TAIL[last] if i == len(blocks) - 1 else 0, *(totals if i == 0 else [None] * len(totals))]
                for i, (b, p, q) in enumerate(zip(blocks, path, path[1:]))]

    done: list[list] = []
    for batch in batches:
        if fields is None:
            fields = [("c", batch.schema.field("c").type), *_ENDS, *_TOTALS]
        for row in batch.to_pylist():
            if blocks and row["c"] != now:
                done += solved()
                blocks = []
                if len(done) >= 1024:
                    yield _batch(done, fields)
                    done = []
            now = row["c"]
            blocks.append(row)
    if blocks:
        yield _batch(done + solved(), fields)


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block's turns: initials, parted by a comma."""
    for batch in batches:
        codes, first, last = (batch.column(k).to_pylist() for k in ("symbols", "state_in", "state_out"))
        edits = [",".join(edits_of(*x)) for x in zip(codes, first, last)]
        keep = [batch.column(k) for k in ("c", "t", "r", "d", "part", "seq", "state_in", "tail")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(edits, pa.string())],
                                         names=["c", "t", "r", "d", "part", "seq", "state", "tail", "edits"])


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit, from blocks and their turns in order."""
    waiting: deque[str] = deque()
    now, started, state, tail, place = None, False, 0, 0, 0
    kind, out = None, []

    def edit(letter: str, role, text) -> list:
        nonlocal state, place
        if letter == "I":
            role, text = ROLES[state], ""
        elif letter == "R":
            role = ROLES[state]
        elif letter == "D":
            role = text = None
        if letter != "D":
            state = FOLLOWS[state][role[0]]
        place += 1
        return [now, place - 1, letter, role, text]

    for batch in batches:
        kind = batch.schema.field("c").type
        fields = [("c", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        for c, block, edits, more, role, text in zip(*(batch.column(k).to_pylist() for k in ("c", "block", "edits", "tail", "r", "x"))):
            if started and c != now:
                out += [edit("I", None, None) for _ in range(tail)]
            if not started or c != now:
                now, started, state, tail, place = c, True, 0, 0, 0
            if block:
                waiting.extend(edits.split(","))
                tail = more  # of the last block
            else:
                out += [edit(letter, role, text) for letter in waiting.popleft()]
        if out:
            yield _batch(out, fields)
            out = []
    if started:
        out += [edit("I", None, None) for _ in range(tail)]
        if out:
            yield _batch(out, fields)


@dataclass
class Repair:
    """``totals``: per conversation with turns its gaps, faults and the repair's cost; ``edits``: the repair, an edit a row.

    The rows of ``edits`` (conversation, place from 0, edit K, R, D or I, role
    and text as repaired, null for D) lie in order, a conversation within one
    partition, whose task reads them as a stream.
    """
    totals: DataFrame
    edits: DataFrame
    conversation: str


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK) -> Repair:
    """The cheapest repair of each conversation, ties by the least audit.

    Turns are in the order of ``turn`` (a whole number; nulls first), those
    of one number by role, then by a digest of the text.  A null role or text is one
    space; a null conversation is a conversation.  blank, duplicate and
    truncated count each turn's first fault: no character but white space;
    role and text of an earlier turn; a last character other than ``.!?``.
    illegal counts neighbours whose role initials are not su, ua or au; gaps
    the missing turn numbers.  A role counts by its first character.  Repeated rows are turns of their own
    (and duplicates).  Other columns are not read.  An empty table has no
    conversation.
    """
    c, t = F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t")
    rows = turns.select(c, t, F.coalesce(F.col(role), F.lit(" ")).alias("r"), F.coalesce(F.col(text), F.lit(" ")).alias("x"))
    rows = rows.withColumn("d", F.unhex(F.sha2("x", 256)))
    bare = F.rtrim(F.col("x"), F.lit(WHITE))
    # equal rows become one with their number, and texts are left behind: a hot row is one row from here on
    slim = rows.select("c", "t", "r", "d", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("unfinished"))
    slim = slim.groupBy("c", "t", "r", "d").agg(F.count("*").alias("copies"), F.min("blank").alias("blank"), F.min("unfinished").alias("unfinished"))
    slim = written(slim, "turns")
    said = slim.groupBy(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("d").alias("d2")).agg(F.min(F.struct("t")).alias("earliest"))
    same = F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("d") == F.col("d2"))
    flagged = slim.join(said, same).select("c", "t", "r", "d", "copies", "blank", "unfinished",
                                           (~F.col("t").eqNullSafe(F.col("earliest.t"))).alias("seen"))
    order = ["c", "t", "r", "d"]
    kind = turns.schema[conversation].dataType.simpleString()
    blocks = written(
        written(flagged, "flagged").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            tidy(_cut(block), _forget), f"c {kind}, t long, r string, d binary, seq int, symbols binary, costs array<long>, "
            "orders array<long>, first string, last string, first_turn long, last_turn long, low long, high long, turns long, "
            "illegal long, blank long, duplicate long, truncated long, part int"), "blocks")
    ends = written(
        blocks.drop("symbols", "t", "r", "d").repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(
            tidy(_join, _forget), f"c {kind}, part int, seq int, state_in int, state_out int, tail int, gaps long, blank long, "
            "duplicate long, truncated long, illegal long, cost long"), "ends")
    totals = ends.where("cost is not null").select(
        F.col("c").alias(conversation), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    solved = blocks.select("c", "t", "r", "d", "part", "seq", "symbols").join(ends.drop("c"), ["part", "seq"]).mapInArrow(
        tidy(_solve, _forget), f"c {kind}, t long, r string, d binary, part int, seq int, state int, tail int, edits string")
    # each block before the turns that it begins with; texts are shuffled once
    both = (solved.select(*order, F.lit(True).alias("block"), "part", "seq", "tail", "edits", F.lit(None).cast("string").alias("x"))
            .unionByName(rows.select(*order, F.lit(False).alias("block"), F.lit(None).cast("int").alias("part"),
                                     F.lit(None).cast("int").alias("seq"), F.lit(None).cast("int").alias("tail"),
                                     F.lit(None).cast("string").alias("edits"), "x")))
    edits = (both.repartition("c").sortWithinPartitions(*order, F.desc("block"), "part", "seq")
             .mapInArrow(_rebuild, f"c {kind}, place long, edit string, role string, text string"))
    return Repair(totals, edits.withColumnRenamed("c", conversation), conversation)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done, fields = None, None, [], None

    def finish() -> None:
        if state is not None:
            done.append([now, "".join(state[0]), state[1].hexdigest()])

    for batch in batches:
        fields = [("c", batch.schema.field(0).type), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        for c, _, letter, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if state is None or c != now:
                finish()
                now, state = c, [[], hashlib.sha256(), True]
            state[0].append(letter)
            if letter != "D":
                state[1].update(f"{'' if state[2] else chr(10)}{role}:{text}".encode())
                state[2] = False
        if len(done) >= 1024:
            yield _batch(done, fields)
            done = []
    finish()
    if done:
        yield _batch(done, fields)


def report(fixed: Repair) -> DataFrame:
    """Per conversation with turns: its audit (the edits' initials) and the SHA-256 of its repaired ``role:text`` lines."""
    kind = fixed.edits.schema[fixed.conversation].dataType.simpleString()
    out = fixed.edits.mapInArrow(tidy(_digest), f"c {kind}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("c", fixed.conversation)
