"""Conversation repair against all edit sequences, and against a plain pass over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skeinwork.llm import op13_conversations as op
from skeinwork.llm import queries

MIDDLE = "/root/testdata/sf0.01"


def brute_audit(rows):
    """Cheapest edits over (initial, bad, truncated) by Dijkstra on (cost, letters): first to reach the end is the answer."""
    import heapq

    n, seen, heap = len(rows), set(), [(0, "", 0, "")]
    while heap:
        cost, letters, k, roles = heapq.heappop(heap)
        if k == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        tail = roles[:1] + str(len(roles) % 2) + roles[-1:]
        if (k, tail) in seen:
            continue
        seen.add((k, tail))
        legal = [r for r in "sua" if re.fullmatch("s?(ua)*u?", roles + r)]
        for r in legal:
            if r != "s":
                heapq.heappush(heap, (cost + 5, letters + "I", k, roles + r))
        if k < n:
            initial, bad, truncated = rows[k]
            heapq.heappush(heap, (cost + 2, letters + "D", k + 1, roles))
            if not bad:
                for r in legal:
                    if r == initial:
                        heapq.heappush(heap, (cost + 5 * truncated, letters + "K", k + 1, roles + r))
                    if r != "s":
                        heapq.heappush(heap, (cost + 1 + 5 * truncated, letters + "R", k + 1, roles + r))


def letters_of(codes, cuts=()):
    bounds = [0, *cuts, len(codes)]
    blocks = [codes[a:b] for a, b in itertools.pairwise(bounds)]
    after = [op.END]
    for block in reversed(blocks):
        after.append(op.through(op.matrix(block), after[-1]))
    state, out = op.START, ""
    for block, behind in zip(blocks, reversed(after[:-1])):
        for letter, _, state in op.walk(block, behind, state):
            out += letter
    return after[-1][op.START], out + "".join(letter for letter, _ in op.tail(state))


def test_walk_is_cheapest_and_first():
    rng = random.Random(5)
    for n in range(9):
        for _ in range(250):
            rows = [(rng.choice("suuaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            codes = [op.code(*r) for r in rows]
            cuts = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(3)))
            assert letters_of(codes) == letters_of(codes, cuts) == brute_audit(rows), rows


def plain_report(rows):
    """Rows (turn, role, text) of a conversation after damage -> what the query returns but for the digest and audit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha1(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = letters_of([op.code(r[1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
    lines, state, left = [], "", list(rows)
    for letter in audit:
        nxt = "assistant" if state == "u" else "user"
        if letter == "D":
            left.pop(0)
            continue
        row = (None, nxt, "") if letter == "I" else left.pop(0)
        role = nxt if letter in "IR" else row[1]
        state = role[0]
        lines.append(f"{role}:{row[2]}")
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha), lines


def damaged(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(df, given, **kwargs):
    want = {}
    for conv, turn, role, text in given:
        want.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op.repair(op.damage(df), present="present", **kwargs).collect()}
    assert got == {c: plain_report(rows)[0] for c, rows in want.items()}


def test_query_over_the_whole_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv, turn, role, text in given:
        want.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    got = queries.QUERIES["op13_checkpointed_repair"](spark, MIDDLE)
    assert got.columns == ["conv_id", *COLUMNS]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: plain_report(rows)[0] for c, rows in want.items()}


@pytest.mark.parametrize("rows,part", [(4096, 1 << 23), (3, 1 << 23), (50, 40)])
def test_odd_rows_and_a_hot_conversation(spark, rows, part):
    rng = random.Random(8)
    given = [(None, None, None, None), (None, 2, "user", "Hi."), (7, None, "system", "Be brief."), (7, None, "user", "x"), (7, 9, "tool", "A tool."),
             (8, 1, "", "no role."), (8, 2, "user", "\t\n"), (8, 3, "assistant", "Same."), (8, 3, "assistant", "Same."), (9, 5, "user", "é" * 3000 + "?")]
    given += [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"Text {t}!"])) for t in range(600)]
    given += [(1, 3, "user", "Yes.")] * 200
    given += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(20, 60) for t in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in given], "conv_id long, turn long, role string, text string, n long").repartition(5)
    check(df, given, block_rows=rows, block_bytes=part)


def test_repaired_turns(spark):
    given = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", ""), (2, 0, "system", "S."), (3, 0, "user", "Q?"), (3, 1, "assistant", "A.")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in op.repair(df, turns=True).collect())
    want = []
    for conv in (1, 2, 3):
        _, lines = plain_report([r[1:] for r in given if r[0] == conv])
        want += [(conv, k, *line.split(":", 1)) for k, line in enumerate(lines)]
    assert [(c, n, role, text) for c, n, _, role, text in got] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert op.repair(op.damage(df), present="present").collect() == []
