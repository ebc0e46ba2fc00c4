"""Spans of pattern matches in whole texts, as Column expressions.

A span is a struct (start, rank, end, kind) in code points, end exclusive, so
sorting an array of spans orders it by start and then by kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.llm import arrays as A

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with what surrounds them.

    array of (start, end, hit, before, after); before and after are the texts between
    neighbouring matches. The text is searched by one split and one extraction, and
    positions are the running sums of the lengths of the parts.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(parts: Column) -> Column:
        hits, n = parts["hits"], F.size(parts["hits"])
        before, after = F.slice(parts["gaps"], F.lit(1), n), F.slice(parts["gaps"], F.lit(2), n)
        ends = A.sums(F.zip_with(before, hits, lambda g, h: F.length(g) + F.length(h)))
        kind = "array<struct<hit:string,end:int,before:string,after:string>>"
        return F.transform(
            F.arrays_zip(hits, ends, before, after).cast(kind),
            lambda x: F.struct(
                (x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("hit"),
                x["before"].alias("before"), x["after"].alias("after"),
            ),
        )

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)


def find(
    text: Column, pattern: str, kind: str, rank: int, guard: Column, keep: Callable[[Column], Column] | None = None
) -> Column:
    """Spans of ``pattern`` that pass ``keep``; the search runs only where the cheap ``guard`` holds."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["hit"]))
    made = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )
    return F.when(guard, made).otherwise(empty_spans())


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, comma-joined."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def lowest_rank(base: Column, others: Column, ranks: int) -> Column:
    """array of (x, rank): each of ``others`` with the lowest rank of the ``base`` spans that it overlaps, or null.

    Both are sorted together; the greatest end so far per rank, where one of
    ``others`` ends, says whether a span of that rank reaches into it.
    """
    kind = "struct<" + ",".join(f"r{k}:int" for k in range(ranks)) + ">"
    starts = F.transform(
        base,
        lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), s["rank"].alias("rank"), s["end"].alias("end")),
    )
    ends = F.transform(
        others,
        lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("rank"), i.alias("end")),
    )

    def ranked(events: Column) -> Column:
        own = F.transform(
            events,
            lambda e: F.struct(*[F.when(e["rank"] == k, e["end"]).otherwise(0).alias(f"r{k}") for k in range(ranks)]),
        )
        greatest = lambda a, b: F.struct(*[F.greatest(a[f"r{k}"], b[f"r{k}"]).alias(f"r{k}") for k in range(ranks)])
        reach = A.running(own, kind, greatest, F.struct(*[F.lit(0).alias(f"r{k}") for k in range(ranks)]))
        asked = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda z: z["e"]["turn"] == 0)

        def found(z: Column) -> Column:
            x = F.get(others, z["e"]["end"])
            rank = F.coalesce(*[F.when(z["r"][f"r{k}"] > x["start"], k) for k in range(ranks)])
            return F.struct(x.alias("x"), rank.alias("rank"))

        return F.transform(asked, found)

    return let(F.array_sort(F.concat(starts, ends)), ranked)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans share one mark."""

    def marked(found: Column) -> Column:
        reach = A.maxima(F.transform(found, lambda s: s["end"]))
        before = F.concat(F.array(F.lit(0)), reach)
        seen = F.zip_with(
            found,
            F.slice(before, F.lit(1), F.size(found)),
            lambda s, at: F.struct(at.alias("start"), s["start"].alias("end"), s["kind"].alias("kind")),
        )
        first = F.filter(seen, lambda s: s["end"] >= s["start"])
        mark = lambda part, s: F.concat(part, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = let(first, lambda f: F.array_join(F.zip_with(A.cuts(text, f), f, mark), ""))
        return F.concat(parts, F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), marked)).otherwise(text)
