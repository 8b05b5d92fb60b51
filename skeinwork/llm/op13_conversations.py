"""Conversation structure repair by a dynamic program with square-root checkpoints.

Every row is kept, reroled or deleted, and rows are inserted, so that the role initials read ``(s?(ua)+)?`` at least cost.
The backward vectors (cost to the end from each of four states) are stored at checkpoints only: at block ends over a long
conversation, and at every square-root-th row inside a block. Walking forward, a block's vectors are computed again from
its checkpoint and the edit is emitted whose cost is tight and whose letter comes first.

Rows are range-partitioned in their order, so a conversation that holds a third of all rows lies in many partitions. Most
conversations are solved where they are; one that may reach over a partition's border or is longer than a block gives a
4 x 4 cost matrix per block, in parallel. Blocks are folded backwards into checkpoints, and its rows pass once more in
order for the walk and the digest, which has to see all repaired text in order: a task streams them and holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import null_safe_key, stage
from skeinwork.llm.copies import first_of_copies, seats

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 60

# States: nothing yet, after s, after u, after a. The role that may be inserted or given in a state, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
GIVEN = ("user", "user", "assistant", "user")
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NOWHERE = (None,) * 4

# A row's code: its initial's transitions, whether it must go, its price if it stays.
Code = tuple[tuple, bool, int]


def code(role: str, bad: bool, truncated: bool) -> Code:
    return KEEP.get(role[:1], NOWHERE), bad, TRUNCATED if truncated else 0


def _with_inserts(v: list[int]) -> list[int]:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


END = _with_inserts([0, FAR, FAR, 0])


def before(row: Code, after: list[int]) -> list[int]:
    """Cost to the end from each state in front of a row, given those behind it."""
    keep, bad, price = row
    out = [DELETE + x for x in after]
    if not bad:
        for state in range(4):
            out[state] = min(out[state], REROLE + price + after[NEXT[state]])
            if keep[state] is not None:
                out[state] = min(out[state], price + after[keep[state]])
    return _with_inserts(out)


def matrix(codes: list[Code]) -> list[int]:
    """Least cost through the rows from each state to each state (row by row)."""
    columns = []
    for state in range(4):
        v = [FAR] * 4
        v[state] = 0
        v = _with_inserts(v)
        for row in reversed(codes):
            v = before(row, v)
        columns.append(v)
    return [columns[q][p] for p in range(4) for q in range(4)]


def through(costs: list[int], after: list[int]) -> list[int]:
    return [min(costs[4 * p + q] + after[q] for q in range(4)) for p in range(4)]


def walk(codes: list[Code], after: list[int], state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, row, state behind) of the cheapest edits of the rows whose letters come first in ASCII; an insertion has the
    number of the row it stands in front of. Vectors are held for two times the square root of the rows."""
    n, step = len(codes), max(1, isqrt(len(codes)))
    marks, v = {n: after}, after
    for k in range(n - 1, -1, -1):
        v = before(codes[k], v)
        if k % step == 0:
            marks[k] = v
    for low in range(0, n, step):
        high = min(n, low + step)
        block = [marks[high]]
        for k in range(high - 1, low - 1, -1):
            block.append(before(codes[k], block[-1]))
        for k in range(low, high):
            here, there = block[high - k], block[high - k - 1]
            keep, bad, price = codes[k]
            while here[state] != DELETE + there[state] and here[state] == INSERT + here[NEXT[state]]:
                state = NEXT[state]
                yield "I", k, state
            if here[state] == DELETE + there[state]:
                yield "D", k, state
            elif keep[state] is not None and here[state] == price + there[keep[state]]:
                state = keep[state]
                yield "K", k, state
            else:
                state = NEXT[state]
                yield "R", k, state


def tail(state: int) -> Iterator[tuple[str, int]]:
    """Insertions behind the last row."""
    while END[state]:
        state = NEXT[state]
        yield "I", state


class Conversation:
    """What is known of a conversation while its blocks pass in order."""

    def __init__(self, turns: bool):
        self.state, self.cost, self.audit, self.sha, self.any = START, 0, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.initial = None
        self.turns, self.n, self.out = turns, 0, []

    def _emit(self, letter: str, role: str | None, text: str | None) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True
            if self.turns:
                self.out.append((self.n, letter, role, text))
                self.n += 1

    def block(self, rows: list[tuple], after: list[int]) -> None:
        """Rows (turn, role, text, fault) in order; fault is blank, duplicate, truncated or none."""
        codes = []
        for turn, role, _, fault in rows:
            if turn is not None:
                self.distinct += turn != self.most
                self.least, self.most = turn if self.least is None else self.least, turn
            self.blank += fault == "blank"
            self.duplicate += fault == "duplicate"
            self.truncated += fault == "truncated"
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
            codes.append(code(role, fault in ("blank", "duplicate"), fault == "truncated"))
        for letter, k, self.state in walk(codes, after, self.state):
            if letter == "I":
                self._emit("I", "user" if self.state == USER else "assistant", "")
                self.cost += INSERT
            elif letter == "D":
                self._emit("D", None, None)
                self.cost += DELETE
            else:
                role = rows[k][1] if letter == "K" else "user" if self.state == USER else "assistant"
                self._emit(letter, role, rows[k][2])
                self.cost += codes[k][2] + (REROLE if letter == "R" else 0)

    def result(self) -> tuple:
        for letter, state in tail(self.state):
            self._emit(letter, "user" if state == USER else "assistant", "")
            self.cost += INSERT
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "n long, edit string, new_role string, new_text string"
ROWS = "part long, block long, pos long, turn long, role string, text string, fault string, steps array<long>"


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batches(rows: Iterator[tuple[dict, int]], columns: str, part_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Dictionaries (and their size) as record batches; a column that one doesn't have is null."""
    fields, held, size = [c.split() for c in columns.split(", ")], [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], ARROW[t]) for n, t in fields], [n for n, _ in fields])

    for row, bytes_ in rows:
        held.append(row)
        size += bytes_ + 200
        if size > part_bytes:
            yield made()
            held, size = [], 0
    yield made()


def _streamed(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _finished(conv: str | None, talk: Conversation, turns: bool) -> Iterator[tuple[dict, int]]:
    report = talk.result()
    if turns:
        yield from _turns(conv, talk)
    else:
        yield {"conv": conv, **dict(zip(_names(REPORT), report))}, len(report[6])


def _turns(conv: str | None, talk: Conversation) -> Iterator[tuple[dict, int]]:
    for row in talk.out:
        yield {"conv": conv, **dict(zip(_names(TURNS), row))}, len(row[3])
    talk.out = []


def _lay(turns: bool, block_rows: int, block_bytes: int):
    """Rows of a partition in order -> reports of conversations that end inside it, blocks of rows of the others."""

    def laid(batches) -> Iterator[tuple[dict, int]]:
        part, first = TaskContext.get().partitionId(), True
        stream = _streamed(batches, ["conv", "present", "turn", "role", "text", "fault"])
        runs = groupby(stream, key=lambda r: r[0])
        conv, run = next(runs, (None, None))
        while run is not None:
            held, size, blocks = [], 0, 0
            for _, present, *row in run:
                if not present:
                    continue
                if held and (len(held) >= block_rows or size >= block_bytes):
                    yield from blocked(conv, part, blocks, held)
                    held, size, blocks = [], 0, blocks + 1
                held.append(row)
                size += len(row[2])
            follower, run = next(runs, (None, None))
            if first or run is None or blocks:
                yield from blocked(conv, part, blocks, held)
            else:
                talk = Conversation(turns)
                talk.block(held, END)
                yield from _finished(conv, talk, turns)
            conv, first = follower, False

    def blocked(conv, part, block, held) -> Iterator[tuple[dict, int]]:
        # The row at -1 is the block itself; so a conversation without rows has one, too.
        yield {"conv": conv, "part": part, "block": block, "pos": -1, "steps": matrix([code(r[1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in held])}, 200
        for pos, (turn, role, text, fault) in enumerate(held):
            yield {"conv": conv, "part": part, "block": block, "pos": pos, "turn": turn, "role": role, "text": text, "fault": fault}, len(text)

    columns = f"conv string, {TURNS if turns else REPORT}, {ROWS}"
    return lambda batches: _batches(laid(batches), columns), columns


def _checkpoints(batches):
    """Blocks from the last to the first -> the vector behind each."""

    def folded():
        for conv, blocks in groupby(_streamed(batches, ["conv", "part", "block", "steps"]), key=lambda r: r[0]):
            after = END
            for _, part, block, steps in blocks:
                yield {"conv": conv, "part": part, "block": block, "pos": -1, "steps": after}, 100
                after = through(steps, after)

    return _batches(folded(), f"conv string, {ROWS}")


def _replay(turns: bool):
    def replayed(batches) -> Iterator[tuple[dict, int]]:
        for conv, run in groupby(_streamed(batches, ["conv", *_names(ROWS)]), key=lambda r: r[0]):
            talk, after, held = Conversation(turns), None, []
            for _, _, _, pos, turn, role, text, fault, steps in run:
                if pos == -1:
                    if after is not None:
                        talk.block(held, after)
                        yield from _turns(conv, talk)
                    after, held = steps, []
                else:
                    held.append((turn, role, text, fault))
            talk.block(held, after)
            yield from _finished(conv, talk, turns)

    columns = f"conv string, {TURNS if turns else REPORT}"
    return lambda batches: _batches(replayed(batches), columns), columns


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with planted faults by crc32(``conv_id:turn``) modulo 20 (a null reads as one blank): 0 drops
    the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A dropped row stays with
    ``present`` false, so that its conversation is known."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text, kind = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("__kind")
    out = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("__kind"))
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("__copy")).drop("__copy")


def _faults(rows: DataFrame, present: Column) -> DataFrame:
    """Staged rows with their fault; equal rows of a conversation are told by digest, wherever they are."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = F.unhex(F.sha1(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    narrow = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    narrow = narrow.select("*", null_safe_key("conv").alias("ckey"), told.alias("told"), F.monotonically_increasing_id().alias("row"), trimmed.alias("__trimmed"))
    ends = F.when(F.length("__trimmed") == 0, "blank").when(~F.substring("__trimmed", -1, 1).isin(".", "!", "?"), "truncated")
    staged = stage(narrow.withColumn("ends", ends).drop("__trimmed"), "conversations")
    staged = staged.withColumn("seat", F.pmod(F.xxhash64("row"), F.lit(seats(rows))))
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.col("row").alias("c"))
    first = first_of_copies(staged.where("present AND NOT ends <=> 'blank'"), ["ckey", "told"], "seat", order)
    again = F.col("first").isNotNull() & (F.col("first.c") != F.col("row")) & F.col("present")
    fault = F.when(F.col("ends") == "blank", "blank").when(again, "duplicate").otherwise(F.col("ends"))
    return staged.join(first, ["ckey", "told", "seat"], "left").select("ckey", "conv", "turn", "role", "told", "row", "text", "present", fault.alias("fault"))


def repair(rows: DataFrame, turns: bool = False, present: str | None = None, block_rows: int = 4096, block_bytes: int = 1 << 23) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): its faults, the least cost, the edits' letters and the
    digest of the repaired ``role:text`` lines. With ``turns`` the repaired rows instead: ``n`` from 0, the ``edit`` that made
    each, ``new_role`` and ``new_text``.

    Rows are in the order of turn (nulls first); rows of one turn by role, then by a digest of role and text. Nulls in role
    and text read as one blank; a null conv_id is a conversation like any other. A role that begins with none of s, u, a
    can't be kept. ``present`` names a boolean column: false rows only make their conversation known. A conversation without
    rows gives zeros, no edits and the digest of nothing. Equal rows: all but the first are duplicates. An empty table gives
    no row. Further columns are not looked at.
    """
    id_type = rows.schema["conv_id"].dataType
    told = _faults(rows, F.col(f"`{present}`") if present else F.lit(True))
    order = ["ckey", F.col("turn").asc_nulls_first(), "role", "told", "row"]
    laid, columns = _lay(turns, block_rows, block_bytes)
    sorted_ = told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "present", "turn", "role", "text", "fault")
    staged = stage(sorted_.mapInArrow(laid, columns), "conversation-blocks")
    names = ["conv", *_names(TURNS if turns else REPORT)]
    closed, open_ = staged.where("part IS NULL").select(names), staged.where("part IS NOT NULL").select("conv", *_names(ROWS))
    blocks = open_.where("pos = -1").select("conv", "part", "block", "steps").repartition("conv")
    marks = blocks.sortWithinPartitions("conv", F.desc("part"), F.desc("block")).mapInArrow(_checkpoints, f"conv string, {ROWS}")
    replay, columns = _replay(turns)
    again = open_.where("pos >= 0").unionByName(marks).repartition("conv").sortWithinPartitions("conv", "part", "block", "pos").mapInArrow(replay, columns)
    return closed.unionByName(again).select(F.col("conv").cast(id_type).alias("conv_id"), *names[1:])
