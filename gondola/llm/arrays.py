"""Running values and cuts over long arrays, as Column expressions.

An aggregation that appends to its result copies that result at every element.
Here an array is cut into blocks of ``BLOCK`` elements: each block runs by itself,
what the blocks end with runs once more, and both are combined, so that the work
grows with the elements times a constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.bind import let

BLOCK = 256


def _blocks(values: Column) -> Column:
    """``values`` as an array of arrays; the last one may be empty."""
    numbers = F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int"))
    return F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _run(values: Column, kind: str, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """(at, all): the last running value and all of them."""

    def step(acc: Column, x: Column) -> Column:
        at = combine(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

    begin = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    return F.aggregate(values, begin, step)


def running(
    values: Column, kind: str, combine: Callable[[Column, Column], Column], zero: Column
) -> Column:
    """``values`` of SQL type ``kind`` combined with all before them; ``combine`` is associative.

    Null for a null array, empty for an empty one.
    """

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: b["at"])
        before = F.concat(F.array(zero.cast(kind)), _run(ends, kind, combine, zero)["all"])
        own = F.zip_with(
            blocks,
            F.slice(before, F.lit(1), F.size(blocks)),
            lambda b, at: F.transform(b["all"], lambda x: combine(at, x)),
        )
        return F.flatten(own)

    return let(
        values,
        lambda v: let(F.transform(_blocks(v), lambda b: _run(b, kind, combine, zero)), joined),
    )


def sums(values: Column) -> Column:
    """Running sums of an array of int."""
    return running(values, "int", lambda a, b: a + b, F.lit(0))


def maxima(values: Column) -> Column:
    """Running maxima of an array of int, 0 at least."""
    return running(values, "int", lambda a, b: F.greatest(a, b), F.lit(0))


def cuts(text: Column, spans: Column) -> Column:
    """The parts of ``text`` at ``spans``: (start, end) in code points, ascending, not overlapping.

    A text is searched from its beginning for every part, so the stretch of a
    block of spans is cut out first.
    """

    def block(whole: Column, own: Column) -> Column:
        first = F.get(own, F.lit(0))["start"]
        last = F.element_at(own, -1)["end"]
        stretch = F.struct(first.alias("at"), F.substring(whole, first + 1, last - first).alias("text"))
        return let(
            stretch,
            lambda s: F.transform(
                own, lambda x: F.substring(s["text"], x["start"] - s["at"] + 1, x["end"] - x["start"])
            ),
        )

    def parts(both: Column) -> Column:
        blocks = F.filter(_blocks(both["spans"]), lambda b: F.size(b) > 0)
        return F.flatten(F.transform(blocks, lambda b: block(both["text"], b)))

    return let(F.struct(text.alias("text"), spans.alias("spans")), parts)
