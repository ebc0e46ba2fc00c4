"""Conversation structure repair by Hirschberg's divide and conquer.

Rows of a conversation are kept, given another role, deleted, or joined by inserted
empty turns, at the least cost, so that the initials of the roles read ``(s?(ua)+)?``.
Four states accept that language: nothing yet, after s, after u, after a. What a row
needs is one of a few symbols: its role's initial, whether it is cut off, or that it has
to go.

* A forward vector holds, for each state, the least cost of the rows so far and the
  order of the four least edit strings; a backward vector the least cost of the rows
  to come. They meet in the middle of a conversation; among the crossings of least
  total cost the one whose edit string is ASCII-least is taken, and both halves are
  solved alike. No table of all rows and states is kept.
* The order is well defined: a string that ends with the edit of row ``i`` is no prefix
  of another one that does, and state and edit determine the next state.
* Rows lie in blocks of at most ``BLOCK`` within range partitions by conversation and
  turn, so a conversation may hold any share of the rows. Each block yields its
  4 x 4 costs and orders; the same meeting over blocks gives the states at their
  borders; then all blocks are solved side by side.

Faults, the first that holds: blank (text without a character beyond ASCII white
space), duplicate (role and text seen earlier in the conversation), truncated (the
last such character is not one of ``.!?``).

Defined results: null role and text are one space; a null conversation id is one
conversation; null turns come first, equal turns follow role, then text; repeated rows
are rows of their own (and duplicates); a role with another initial can only be
deleted or given a role, an empty role adds no initial; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.staging import staged

#: Rows solved together in one task.
BLOCK = 4_096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60

_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_STATES = range(4)


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """States that inserts reach, with the initials inserted; more of them only repeat a state."""
    yield state, ""
    made = ""
    while len(made) < 2:
        initial = "a" if state == 2 else "u"
        state, made = _NEXT[state, initial], made + initial
        yield state, made


class Step(NamedTuple):
    """Edits of one row: inserts before it, its own letter, the initial it has then."""

    cost: int
    audit: str
    inserts: str
    initial: str


def _steps(symbol: str) -> dict[tuple[int, int], Step]:
    """The cheapest, ASCII-least edits of a row from state to state."""
    best: dict[tuple[int, int], Step] = {}
    late = TRUNCATED if symbol.isupper() else 0
    own = symbol.lower()
    for begin in _STATES:
        for state, inserts in _inserted(begin):
            choices = [(state, DELETE, "D", "")]
            if own != "x":
                kept = state if own == "e" else _NEXT.get((state, own))
                if kept is not None:
                    choices.append((kept, KEEP + late, "K", own))
                choices += [(_NEXT[state, i], REROLE + late, "R", i) for i in "ua" if (state, i) in _NEXT]
            for end, cost, letter, initial in choices:
                made = Step(cost + INSERT * len(inserts), "I" * len(inserts) + letter, inserts, initial)
                best[begin, end] = min(best.get((begin, end), made), made, key=lambda s: s[:2])
    return best


#: Symbols: s, u, a, o (another initial) and e (an empty role, which has none), upper case if truncated; x has to go.
STEPS = {symbol: _steps(symbol) for symbol in "suaoeSUAOEx"}
#: (begin, end, cost, edit string) of each symbol.
_MOVES = {k: [(b, e, x.cost, x.audit) for (b, e), x in v.items()] for k, v in STEPS.items()}
#: Inserts that end a conversation, by state.
CLOSING = {0: "", 1: "ua", 2: "a", 3: ""}


def _forward(symbols: str, begin: int) -> tuple[list[int], list[int]]:
    """Least costs from ``begin`` by end state, and the order of their edit strings."""
    cost, order = [NEVER] * 4, [0] * 4
    cost[begin] = 0
    for symbol in symbols:
        made: list[tuple[int, int, str] | None] = [None] * 4
        for b, e, c, audit in _MOVES[symbol]:
            if cost[b] < NEVER:
                key = (cost[b] + c, order[b], audit)
                if made[e] is None or key < made[e]:
                    made[e] = key
        cost = [m[0] if m else NEVER for m in made]
        ranked = sorted((m[1:], e) for e, m in enumerate(made) if m)
        for rank, (_, e) in enumerate(ranked):
            order[e] = rank
    return cost, order


def _backward(symbols: str, end: int) -> list[int]:
    """Least costs from each state to ``end``."""
    cost = [NEVER] * 4
    cost[end] = 0
    for symbol in reversed(symbols):
        before = [NEVER] * 4
        for b, e, c, _ in _MOVES[symbol]:
            before[b] = min(before[b], c + cost[e])
        cost = before
    return cost


def solve(symbols: str, begin: int, end: int) -> list[Step]:
    """The ASCII-least of the cheapest edits of ``symbols`` between two states."""
    made: list[Step] = []
    waiting = [(0, len(symbols), begin, end)]
    while waiting:
        low, high, begin, end = waiting.pop()
        if high - low == 1:
            made.append(STEPS[symbols[low]][begin, end])
        elif high > low:
            middle = (low + high) // 2
            cost, order = _forward(symbols[low:middle], begin)
            rest = _backward(symbols[middle:high], end)
            crossing = min(_STATES, key=lambda s: (cost[s] + rest[s], order[s]))
            waiting += [(middle, high, crossing, end), (low, middle, begin, crossing)]
    return made


def _closing_costs() -> list[int]:
    return [INSERT * len(CLOSING[s]) for s in _STATES]


class Block(NamedTuple):
    """Costs and orders of a block by begin and end state."""

    cost: list[list[int]]
    order: list[list[int]]


def crossings(blocks: list[Block]) -> list[int]:
    """The state before each block and after the last one, found by halves like the rows of a block."""

    def forward(part: list[Block], begin: int) -> tuple[list[int], list[int]]:
        cost, order = [NEVER] * 4, [0] * 4
        cost[begin] = 0
        for block in part:
            made = [
                min((cost[b] + block.cost[b][e], order[b], block.order[b][e]) for b in _STATES) for e in _STATES
            ]
            cost = [m[0] for m in made]
            strings = sorted(m[1:] for m in made)
            order = [strings.index(m[1:]) for m in made]
        return cost, order

    def backward(part: list[Block], end: int) -> list[int]:
        cost = [NEVER] * 4
        cost[end] = 0
        for block in reversed(part):
            cost = [min(block.cost[b][e] + cost[e] for e in _STATES) for b in _STATES]
        return cost

    cost, order = forward(blocks, 0)
    closing = _closing_costs()
    last = min(_STATES, key=lambda s: (cost[s] + closing[s], order[s]))
    states = [0] * len(blocks) + [last]
    waiting = [(0, len(blocks), 0, last)]
    while waiting:
        low, high, begin, end = waiting.pop()
        if high - low > 1:
            middle = (low + high) // 2
            cost, order = forward(blocks[low:middle], begin)
            rest = backward(blocks[middle:high], end)
            states[middle] = min(_STATES, key=lambda s: (cost[s] + rest[s], order[s]))
            waiting += [(low, middle, begin, states[middle]), (middle, high, states[middle], end)]
    return states


def _transfer_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its costs and orders from every begin state, flattened."""
    for batch in batches:
        costs, orders = [], []
        for symbols in batch.column("symbols").to_pylist():
            made = [_forward(symbols, b) for b in _STATES]
            costs.append([c for cost, _ in made for c in cost])
            orders.append([o for _, order in made for o in order])
        yield pa.RecordBatch.from_arrays(
            [batch.column("c"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())), pa.array(orders, pa.list_(pa.int64()))],
            ["c", "block", "cost", "order"],
        )


def _crossing_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the begin and end state of each block."""
    for batch in batches:
        states = []
        for blocks in batch.column("blocks").to_pylist():
            square = lambda x: [x[4 * b : 4 * b + 4] for b in _STATES]
            found = crossings([Block(square(x["cost"]), square(x["order"])) for x in blocks])
            states.append([
                {"block": x["block"], "begin": b, "end": e, "last": i == len(blocks) - 1}
                for i, (x, b, e) in enumerate(zip(blocks, found, found[1:], strict=False))
            ])
        kind = pa.struct([("block", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(states, pa.list_(kind))], ["c", "states"])


_EDIT = pa.struct([("audit", pa.string()), ("inserts", pa.string()), ("initial", pa.string())])


def _solve_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its cost and the edits of its rows; the inserts that end a conversation follow its last block."""
    for batch in batches:
        edits, costs, tails = [], [], []
        for symbols, begin, end, last in zip(
            *[batch.column(c).to_pylist() for c in ("symbols", "begin", "end", "last")], strict=True
        ):
            steps = solve(symbols, begin, end)
            tail = CLOSING[end] if last else ""
            edits.append([{"audit": s.audit, "inserts": s.inserts, "initial": s.initial} for s in steps])
            costs.append(sum(s.cost for s in steps) + INSERT * len(tail))
            tails.append(tail)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("c"),
                batch.column("block"),
                pa.array(costs, pa.int64()),
                pa.array(tails, pa.string()),
                pa.array(edits, pa.list_(_EDIT)),
            ],
            ["c", "block", "cost", "tail", "edits"],
        )


def _faults(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in order, in blocks: (c, at, block, turn, role, text, fault, initial)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = named.groupBy("c", "said").agg(F.min(place).alias("first"))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = (
        F.when(bare == "", "blank")
        .when(place != F.col("first"), "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    initial = F.substring("role", 1, 1)
    marked = named.join(first, ["c", "said"]).select(
        "c", "turn", "role", "text", "row", fault.alias("fault"),
        F.when(initial.isin(*INITIALS), initial).when(initial == "", "e").otherwise(F.lit("o")).alias("initial"),
    )
    keys = ["c", "turn", "role", "text", "row"]
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(ranged.withColumn("at", F.monotonically_increasing_id()), "turns").withColumn(
        "block", F.floor(F.col("at") / BLOCK)
    )


class Repair(NamedTuple):
    """``conversations``: (c, gaps, blank, duplicate, truncated, illegal, cost, audit); ``turns``: (c, place, role, text, edit).

    ``c`` is the conversation id as text, empty for a null id. Turns are in the order of
    ``place`` (row, then position in its edits); edit is K, R or I.
    """

    conversations: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair all conversations of ``rows`` (conv_id, turn, role, text)."""
    turns = _faults(rows)
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    letters = lambda c: F.array_join(F.transform("sorted", lambda x: x[c]), "")
    blocks = staged(
        turns.groupBy("c", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", symbol.alias("symbol"), "initial"))).alias("sorted"))
        .select("c", "block", letters("symbol").alias("symbols"), letters("initial").alias("initials"), F.transform("sorted", lambda x: x["at"]).alias("ats")),
        "turn-blocks",
    )
    small = "c string, block long, cost array<long>, `order` array<long>"
    transfers = blocks.select("c", "block", "symbols").mapInArrow(_transfer_kernel, small)
    per_conversation = transfers.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "cost", "order"))).alias("blocks"))
    states = per_conversation.mapInArrow(
        _crossing_kernel, "c string, states array<struct<block:long,begin:int,end:int,last:boolean>>"
    ).select("c", F.inline("states"))
    solved = staged(
        blocks.join(states, ["c", "block"])
        .select("c", "block", "symbols", "begin", "end", "last")
        .mapInArrow(
            _solve_kernel,
            "c string, block long, cost long, tail string, edits array<struct<audit:string,inserts:string,initial:string>>",
        ),
        "turn-edits",
    )
    return Repair(_conversations(turns, blocks, solved), _turns(turns, blocks, solved))


def _conversations(turns: DataFrame, blocks: DataFrame, solved: DataFrame) -> DataFrame:
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    faults = turns.groupBy("c").agg(count("blank"), count("duplicate"), count("truncated"))
    range_ = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.select("c", "turn").distinct().groupBy("c").agg(F.coalesce(range_, F.lit(0)).alias("gaps"))
    # Per block: pairs inside it, and its ends; pairs across blocks follow from the ends.
    pairs = F.expr("transform(sequence(1, length(initials)), i -> substring(initials, i, 2))")
    illegal = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL)))
    ends = blocks.select("c", "block", illegal.alias("inside"), F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("end"))
    audits = solved.select(
        "c", "block", "cost",
        F.concat(F.array_join(F.transform("edits", lambda e: e["audit"]), ""), F.repeat(F.lit("I"), F.length("tail"))).alias("audit"),
    )
    parts = ends.join(audits, ["c", "block"]).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("block", "inside", "head", "end", "audit"))).alias("p"), F.sum("cost").alias("cost")
    )
    across = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda x, y: F.concat(x["end"], y["head"]))
    inside = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["inside"])
    summed = parts.select(
        "c",
        (inside + F.size(F.filter(across, lambda x: ~x.isin(*LEGAL)))).alias("illegal"),
        "cost",
        F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"),
    )
    made = faults.join(gaps, "c").join(summed, "c")
    return made.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _turns(turns: DataFrame, blocks: DataFrame, solved: DataFrame) -> DataFrame:
    role = lambda i: F.when(i == "u", ROLES["u"]).otherwise(ROLES["a"])
    struct = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), edit.alias("edit"))
    new = lambda letters: F.transform(
        F.filter(F.split(letters, ""), lambda i: i != ""), lambda i: struct(role(i), F.lit(""), F.lit("I"))
    )
    placed = blocks.select("c", "block", "ats").join(solved.select("c", "block", "edits", "tail"), ["c", "block"])
    edits = placed.select("c", "tail", F.posexplode(F.arrays_zip("ats", "edits")).alias("i", "x"), F.size("ats").alias("n")).select(
        F.col("x.ats").alias("at"),
        F.col("x.edits.inserts").alias("inserts"),
        F.col("x.edits.initial").alias("given"),
        F.right("x.edits.audit", F.lit(1)).alias("edit"),
        F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise(F.lit("")).alias("tail"),
    )
    own = F.when(
        F.col("edit") != "D",
        F.array(struct(F.when(F.col("edit") == "K", F.col("role")).otherwise(role(F.col("given"))), F.col("text"), F.col("edit"))),
    ).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    every = F.concat(new(F.col("inserts")), own, new(F.col("tail")))
    joined = turns.select("c", "at", "role", "text").join(edits, "at")
    return joined.select("c", "at", F.posexplode(every).alias("i", "x")).select("c", F.struct("at", "i").alias("place"), "x.*")


def by_conversation(conv_id: Column) -> Column:
    """The key ``c`` of a conversation id."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))
