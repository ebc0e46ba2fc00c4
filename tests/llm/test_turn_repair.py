"""Repairs against a search over all edit strings, and the query against the contract written out plainly."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from gondola.llm import turn_queries
from gondola.llm import turn_repair as T

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines): uniform-cost search in the order of cost, then audit; rows (role, text, fault)."""
    accepts = lambda s: re.fullmatch(r"(s?(ua)+)?", s) is not None
    viable = lambda s: re.fullmatch(r"s?(ua)*u?", s) is not None
    short = lambda s: {"": "", "s": "s"}.get(s) if s in ("", "s") else "u" if s[-1] == "u" else "ua"
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        key = (i, roles)
        if i == len(rows) and accepts(roles):
            return cost, audit, lines
        if key in seen:
            continue
        seen.add(key)
        step = lambda c, e, j, r, more: heapq.heappush(heap, (cost + c, audit + e, j, short(roles + r), lines + more))  # noqa: E731, B023
        for r, name in (("u", "user"), ("a", "assistant")):
            if viable(roles + r):
                step(5, "I", i, r, (f"{name}:",))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        step(2, "D", i + 1, "", ())
        if fault in ("blank", "duplicate"):
            continue
        late = 5 if fault == "truncated" else 0
        if viable(roles + role[:1]):
            step(late, "K", i + 1, role[:1], (f"{role}:{text}",))
        for r, name in (("u", "user"), ("a", "assistant")):
            if viable(roles + r):
                step(1 + late, "R", i + 1, r, (f"{name}:{text}",))
    raise AssertionError


def solved(symbols):
    cost, order = T._forward(symbols, 0)
    closing = T._closing_costs()
    end = min(range(4), key=lambda s: (cost[s] + closing[s], order[s]))
    steps = T.solve(symbols, 0, end)
    return cost[end] + closing[end], "".join(s.audit for s in steps) + "I" * len(T.CLOSING[end])


def as_rows(symbols):
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "e": "", "x": "user"}
    return [(names[x.lower()], str(i), "blank" if x == "x" else "truncated" if x.isupper() else "") for i, x in enumerate(symbols)]


def test_all_short_and_many_longer_conversations():
    rng = random.Random(4)
    every = ["".join(p) for n in range(4) for p in itertools.product("suaoeSUAx", repeat=n)]
    every += ["".join(rng.choices("suaoUAx", [1, 6, 6, 1, 1, 1, 2], k=rng.randint(4, 24))) for _ in range(400)]
    for symbols in every:
        assert solved(symbols) == cheapest(as_rows(symbols))[:2], symbols


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_blocks_meet_as_rows_do(size):
    rng = random.Random(size)
    for _ in range(150):
        symbols = "".join(rng.choices("suaoUAx", k=rng.randint(1, 20)))
        parts = [symbols[i : i + size] for i in range(0, len(symbols), size)]
        made = [[T._forward(p, b) for b in range(4)] for p in parts]
        states = T.crossings([T.Block([c for c, _ in m], [o for _, o in m]) for m in made])
        audit = "".join(s.audit for p, b, e in zip(parts, states, states[1:], strict=False) for s in T.solve(p, b, e))
        assert audit + "I" * len(T.CLOSING[states[-1]]) == solved(symbols)[1]


def expected(rows):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        made = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            case = zlib.crc32(key.encode()) % 20
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            made += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in made:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[0] for r in made if r[0] is not None}
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(made, made[1:], strict=False)]
        cost, audit, lines = cheapest(faulty)
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("block", [T.BLOCK, 3])
def test_query_on_hard_rows(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = random.Random(8)
    texts = ["ok.", "ok", "Yes!", None, "", " \t\x0b", "a. b ", "é?\n", "x" * 50_000 + "."]
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5, 6, 7, -8]), rng.choice([None, *range(14)]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts))
        for _ in range(130)
    ]
    rows += [(50, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(60)]
    rows += rows[:7] + [(100 + i, 0, "user", "hm") for i in range(80)]
    schema = "conv_id long, turn long, role string, text string, c int, place int"
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in turn_queries.op12_turn_repair(spark, str(tmp_path)).collect()}
    want = expected(rows)
    assert any(zlib.crc32(f"{100 + i}:0".encode()) % 20 == 0 for i in range(80))
    assert got == want
    made = T.repair(df.limit(0))
    assert made.conversations.count() == 0 and made.turns.count() == 0
