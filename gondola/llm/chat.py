"""Chat formatting: conversations as one marked string each, with the spans that training learns from.

A block is a run of turns with one role: ``<|turn|>role<|text|>first<|next|>second<|end|>``.
Inside roles and texts ``\\`` is doubled and ``<|`` becomes ``<\\|``, so a mark can
only come from the template, whatever a text says, and reading is exact.

Defined results: null role or text is empty; a null conversation id is one
conversation; turns with equal numbers follow role, then text; repeated rows are
turns of their own; an empty table gives an empty result. Other columns are ignored.
A conversation is one row, so it must fit into one string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm import arrays as A

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"


def escape(value: Column) -> Column:
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def _split(value: Column, mark: str) -> Column:
    return F.split(value, mark.replace("|", r"\|"), -1)


def _follows(turns: Column, i: Column) -> Column:
    """Does turn ``i`` continue the block of the turn before it?"""
    return (i > 0) & (F.get(turns, i - 1)["role"] == F.get(turns, i)["role"])


def format_conversations(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): loss holds the (start, end) of each text of role ``learn``.

    Offsets are code points of ``formatted``, end exclusive.
    """
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        opening = F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))
        lead = (
            F.when(_follows(F.col("turns"), i), F.lit(NEXT))
            .when(i > 0, F.concat(F.lit(END), opening))
            .otherwise(opening)
        )
        return F.struct(lead.alias("lead"), escape(x["text"]).alias("body"), (x["role"] == learn).alias("learn"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def spans(found: Column) -> Column:
        ends = A.sums(F.transform(found, lambda x: F.length(x["lead"]) + F.length(x["body"])))
        span = lambda x, end: F.when(x["learn"], F.struct((end - F.length(x["body"])).alias("start"), end.alias("end")))
        return F.array_compact(F.zip_with(found, ends, span))

    whole = F.transform("pieces", lambda x: F.concat(x["lead"], x["body"]))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(whole, ""), F.lit(END)).alias("formatted"),
        spans(F.col("pieces")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def block(value: Column) -> Column:
        parts = _split(value, TEXT)
        body = F.regexp_replace(F.get(parts, F.lit(1)), r"<\|end\|>$", "")
        role = unescape(F.get(parts, F.lit(0)))
        return F.transform(
            _split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    blocks = _split(formatted, TURN)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text below the loss mask, unescaped."""
    return F.array_join(F.transform(A.cuts(formatted, loss), unescape), "")
