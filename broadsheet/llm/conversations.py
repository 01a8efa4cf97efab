"""Conversation structure repair by a survivor-coalescence Viterbi.

A conversation's rows are edited, at least cost, until their roles read ``(s?(ua)+)?``. After each row one survivor
remains for each of the four places in that pattern. Survivors are leaves of a tree of back pointers with reference
counts: what no survivor descends from is freed, and the stem that all of them share is final, so its
edits are emitted at once and only the unresolved rest is held.

Of equally cheap survivors the one whose edits are least in ASCII wins. Two unresolved suffixes first differ where they
left their last shared node, and neither begins the other, since each ends with the edit of the same row. So the
order of the survivors never changes before that point; it is kept with them, and a tie compares complete suffixes by it.

Rows are sorted over the whole cluster by conversation and turn, so a conversation with a third of all rows lies in many
tasks. Such a split conversation is solved by blocks: a block is run from each of the four places, which
gives the costs and the order of at most sixteen paths; the blocks' tables are chained, and each block is run
once more from the place where it begins to the place where it must end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from a place, the turn a place asks for, pairs that may stand side by side, costs.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: Turns missing at the end of a conversation, by place.
MISSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")
#: What it costs at most to go on from the first place as from the second: turns are inserted, a system turn deleted.
LIKE = {
    (START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): 3, (SYSTEM, START): 6, (SYSTEM, ASSISTANT): 6, (SYSTEM, USER): 3,
    (USER, START): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, START): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
BLANKS, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Characters of a piece of repaired text; rows of a batch; ways that a repeated text's rows are dealt out.
PIECE, BATCH, SALTS = 1 << 20, 2000, 16

State = dict[int, tuple[int, int]]
Way = tuple[int, int, str, int, int]


def ways(state: State, initial: str, fault: int) -> Iterator[Way]:
    """(cost, order, edits, place before, place) of all that a row's edit and the inserts before it can do. Inserts
    come right before a kept or relabelled row: before a deleted one they could as well stand behind it,
    for the same cost and less in ASCII."""
    for place, (cost, order) in state.items():
        yield cost + DELETE, order, "D", place, place
        if fault in (BLANK, DUPLICATE):
            continue
        cost += TRUNCATED if fault == CUT else 0
        at = place
        for inserts in ("", "I", "II"):
            if (at, initial) in STEPS:
                yield cost, order, inserts + "K", place, STEPS[at, initial]
            at = NEXT[at][1]
            cost += INSERT
            yield cost + RELABEL - INSERT, order, inserts + "R", place, at


def best(found: Iterator[Way]) -> dict[int, tuple[int, int, Way]]:
    """For each place the cheapest way, the least in ASCII among equals: (cost, new order, way). A place that another
    could stand in for at less cost, whatever follows, has no survivor: else the way that deletes all rows would
    live on beside the others, and they would never share more than the root."""
    kept: dict[int, Way] = {}
    for way in found:
        if way[4] not in kept or way[:3] < kept[way[4]][:3]:
            kept[way[4]] = way
    kept = {p: way for p, way in kept.items() if not any(kept[q][0] + LIKE[q, p] < way[0] for q in kept if q != p)}
    order = {p: k for k, p in enumerate(sorted(kept, key=lambda p: kept[p][1:3]))}
    return {p: (way[0], order[p], way) for p, way in kept.items()}


def after(state: State, initial: str, fault: int, copies: int) -> State:
    """Costs and orders after a row and its copies, which are deleted from the second on."""
    more = DELETE * (copies - 1)
    return {p: (cost + more, order) for p, (cost, order, _) in best(ways(state, initial, fault)).items()}


def end(state: State) -> int:
    """The place where the best survivor stands when the rows are over."""
    return min(state, key=lambda p: (state[p][0] + INSERT * MISSING[p], state[p][1]))


@dataclass(slots=True, eq=False)
class Node:
    """An edit of the tree: a row, its edits, and the place before them. ``refs``: nodes and survivors that stand on it."""

    parent: Node | None
    way: Way | None
    row: Any
    refs: int
    kids: set[Node] = field(default_factory=set)


class Survivors:
    """The tree over the rows so far. ``done`` is the stem that hasn't been taken; ``held`` counts the nodes."""

    def __init__(self, place: int = START):
        self.root = Node(None, None, None, 1)
        self.state: State = {place: (0, 0)}
        self.leaf, self.held, self.done = {place: self.root}, 1, []

    def add(self, row: Any, initial: str, fault: int, copies: int = 1) -> None:
        found = best(ways(self.state, initial, fault))
        self.state = {p: (cost + DELETE * (copies - 1), order) for p, (cost, order, _) in found.items()}
        old, self.leaf = self.leaf, {}
        for place, (_, _, way) in found.items():
            parent = old[way[3]]
            node = self.leaf[place] = Node(parent, way, row, 1)
            parent.kids.add(node)
            parent.refs += 1
        self.held += len(found)
        for leaf in old.values():
            self._release(leaf)
        while len(self.root.kids) == 1 and self.root.refs == 1:  # all survivors stand on the one node above
            self.root = self.root.kids.pop()
            self.root.parent = None
            self.held -= 1
            self.done.append(self.root)

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.kids.discard(node)
            self.held -= 1
            parent.refs -= 1
            node = parent

    def take(self) -> list[Node]:
        out, self.done = self.done, []
        return out

    def finish(self, place: int) -> list[Node]:
        """What wasn't taken of the path to the survivor of ``place``."""
        path, node = [], self.leaf[place]
        while node is not self.root:
            path.append(node)
            node = node.parent
        return self.take() + path[::-1]


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with their first fault. Whether a text was there before is told by
    the least turn of its equals; a text at a third of all turns is dealt out by turn, so no task meets all of it."""
    keyed = rows.withColumns({"_d": F.sha2("text", 256), "_salt": F.pmod(F.xxhash64("turn"), F.lit(SALTS))})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = keyed.groupBy("conv_id", "role", "_d").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_d").alias("_t"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    met = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_d") == F.col("_t")) & (F.col("_salt") == F.col("_s").cast("long")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("_first").isNotNull() & ~place.eqNullSafe(F.col("_first")), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(*STOPS), CUT).otherwise(SOUND)
    return met.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether the row begins a conversation, row); equal null ids are one conversation."""
    last: Any = _conversations
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0] != last, row
            last = row[0]


def _blocks(sorted_rows: DataFrame) -> dict[tuple[int, int | None], tuple[int, int, bool]]:
    """{(task, conversation): (place at the block's start, at its end, whether it is the last)} of the conversations that
    lie in several tasks. Each task tells the costs and orders of its first and its last conversation, so
    the driver gets two short rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for at, to in zip(starts, [*starts[1:], len(ids)], strict=True):
                if now is None or at or ids[0] != now[0]:
                    first = first or now
                    now = (ids[at], [{p: (0, 0)} for p in range(4)])
                if first and to < len(ids):
                    continue  # neither the task's first conversation nor, perhaps, its last
                for role, copies, fault in zip(*(batch.column(i)[at:to].to_pylist() for i in (2, 4, 5)), strict=True):
                    now[1][:] = [after(s, role[:1], fault, copies) for s in now[1]]
        rows = [x for x in (first, now) if x is not None]
        flat = [[v for s in x[1] for p in range(4) for v in s.get(p, (-1, -1))] for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["part", "conv_id", "t"])

    ends: dict[int | None, list[tuple[int, list[State]]]] = {}
    for r in sorted_rows.mapInArrow(run, "part int, conv_id long, t array<long>").collect():
        tables = [{p: (r.t[8 * e + 2 * p], r.t[8 * e + 2 * p + 1]) for p in range(4) if r.t[8 * e + 2 * p] >= 0} for e in range(4)]
        ends.setdefault(r.conv_id, []).append((r.part, tables))
    out = {}
    for conv, blocks in ends.items():
        if len(blocks) == 1:
            continue
        blocks.sort(key=lambda b: b[0])
        state, came = {START: (0, 0)}, []
        for _, tables in blocks:
            # The order within a block takes the place of the edits.
            found = best((cost + c, order, o, e, p) for e, (cost, order) in state.items() for p, (c, o) in tables[e].items())
            came.append({p: way[3] for p, (_, _, way) in found.items()})
            state = {p: (cost, order) for p, (cost, order, _) in found.items()}
        place = end(state)
        for k in reversed(range(len(blocks))):
            out[blocks[k][0], conv] = (came[k][place], place, k == len(blocks) - 1)
            place = came[k][place]
    return out


TURNS = "conv_id long, turn long, was string, fault int, times long, edit string, role string, text string"


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, was, fault, times, edit, role, text): the cheapest edits of all conversations, in order within
    a task, and tasks in order. ``edit``: K keeps, R relabels, D deletes and I inserts; ``was`` is the role before and
    null for an insert; ``role`` and ``text`` are what stands there now, null if deleted. ``times``: equal deletions in a row.

    ``rows``: conv_id, turn, role, text and, if wanted, ``copies`` of a row. Null roles and texts count as one
    space. Turns go up, nulls first; of equal turns the role and then the text decide. Equal rows are copies. A null
    conv_id is a conversation of its own. Other columns are ignored; an empty table gives no rows. The sorted rows
    are checkpointed, so the blocks stay the same if executors are lost."""
    n = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), n.alias("copies"))
    distinct = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    dealt = faults(distinct).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = durable(dealt.sortWithinPartitions("conv_id", "turn", "role", "text"))
    blocks = ordered.sparkSession.sparkContext.broadcast(_blocks(ordered))  # two for each task at most
    names = [x.split()[0] for x in TURNS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, conv, tree, block = TaskContext.get().partitionId(), [], 0, None, None, None

        def emit(nodes: list[Node]) -> None:
            nonlocal size
            for node in nodes:
                _, turn, was, text, copies, fault = node.row
                _, _, edits, place, _ = node.way
                for _ in edits[:-1]:
                    role, place = NEXT[place]
                    out.append((conv, None, None, SOUND, 1, "I", role, ""))
                kept = {"K": (was, text), "R": (NEXT[place][0], text), "D": (None, None)}[edits[-1]]
                out.append((conv, turn, was, fault, 1, edits[-1], *kept))
                if copies > 1:
                    out.append((conv, turn, was, BLANK if fault == BLANK else DUPLICATE, copies - 1, "D", None, None))
                size += len(text)

        def close() -> None:
            place = block[1] if block else end(tree.state)
            emit(tree.finish(place))
            if not block or block[2]:
                for _ in range(MISSING[place]):
                    role, place = NEXT[place]
                    out.append((conv, None, None, SOUND, 1, "I", role, ""))

        for begins, row in _conversations(batches):
            if begins:
                if tree:
                    close()
                conv = row[0]
                block = blocks.value.get((part, conv))
                tree = Survivors(block[0] if block else START)
            tree.add(row, row[2][:1], row[5], row[4])
            emit(tree.take())
            if len(out) >= BATCH or size >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
                size = 0
        if tree:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return ordered.mapInArrow(run, TURNS)


@dataclass
class Report:
    """What a stretch of a conversation adds up to; stretches are added in order."""

    least: int | None = None
    most: int | None = None
    turns: int = 0
    begins: str | None = None
    ends: str | None = None
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    cost: int = 0

    def add(self, other: Report) -> None:
        if other.least is not None:
            self.turns += other.turns - (self.most == other.least)
            self.least = other.least if self.least is None else self.least
            self.most = other.most
        if other.begins is not None:
            self.illegal += self.ends is not None and self.ends + other.begins not in LEGAL
            self.begins = other.begins if self.begins is None else self.begins
            self.ends = other.ends
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.illegal += other.illegal
        self.cost += other.cost

    def row(self, turn: int | None, was: str | None, fault: int, times: int, edit: str) -> None:
        initial = None if was is None else was[:1]
        one = Report(turn, turn, int(turn is not None), initial, initial, illegal=times - 1 if was is not None else 0)
        one.counts[fault] = times
        one.cost = {"K": 0, "R": RELABEL, "D": DELETE * times, "I": INSERT}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
        self.add(one)


STRETCH = "conv_id long, part int, seq long, whole boolean, least long, most long, turns long, begins string, ends string, counts array<long>, illegal long, cost long, audit string, body binary"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``repair``'s rows. Conversations
    within a task are told there. The first and the last of a task may go on in others: their stretches, in
    pieces of a bounded size, meet by conversation and are hashed in order, one piece at a time. A digest
    of a conversation can't be split further; only its text passes that task."""
    names = [x.split()[0] for x in STRETCH.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, first, conv, seq, size, held = TaskContext.get().partitionId(), [], True, None, 0, 0, 0
        report, audit, body = None, [], []

        def close(whole: bool) -> None:
            nonlocal seq, size, held, report, audit, body
            r, text = report, b"".join(body)
            out.append((conv, part, seq, whole, r.least, r.most, r.turns, r.begins, r.ends, r.counts, r.illegal, r.cost, "".join(audit), hashlib.sha256(text[1:]).digest() if whole else text))
            report, audit, body, size, seq, held = Report(), [], [], 0, seq + 1, held + (0 if whole else len(text))

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        for begins, row in _conversations(batches):
            if begins:
                if report:
                    close(not first and not seq)
                    first = False
                conv, report, seq = row[0], Report(), 0
            _, turn, was, fault, times, edit, role, text = row
            report.row(turn, was, fault, times, edit)
            audit.append(edit * times)
            if role is not None:
                body.append(f"\n{role}:{text}".encode())
                size += len(text)
            if size >= PIECE:
                close(False)
            if len(out) >= BATCH or held >= PIECE:
                yield flush()
        if report:
            close(False)
            yield flush()

    made = durable(turns.mapInArrow(stretches, STRETCH))
    gaps = F.when(F.col("least").isNull(), 0).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns")).cast("long")
    told = lambda df, digest: df.select("conv_id", gaps.alias("gaps"), *(F.col("counts")[i].alias(c) for i, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))), "illegal", "cost", "audit", digest.alias("repaired_sha256"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, audit, digest, empty = None, None, [], None, True

        def close() -> pa.RecordBatch:
            row = (conv, 0, 0, True, total.least, total.most, total.turns, total.begins, total.ends, total.counts, total.illegal, total.cost, "".join(audit), digest.digest())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for begins, row in _conversations(batches):
            if begins:
                if total:
                    yield close()
                conv, total, audit, digest, empty = row[0], Report(), [], hashlib.sha256(), True
            total.add(Report(*row[4:9], row[9], *row[10:12]))
            audit.append(row[12])
            digest.update(row[13][1:] if empty else row[13])
            empty = empty and not row[13]
        if total:
            yield close()

    pieces = made.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(chained, STRETCH)
    return told(made.where("whole").union(pieces), F.lower(F.hex("body")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with known faults, dealt by a checksum of conversation and turn: of
    twenty, one drops the row, one empties its text, one takes its stops, one repeats it, one makes it a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_kind", kind).where("_kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def every(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The reports with one for each conversation of ``ids``; one without rows has zeros and nothing repaired."""
    wanted = ids.select(F.col("conv_id").cast("long").alias("_c")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = wanted.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return joined.select(F.col("_c").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), digest)
