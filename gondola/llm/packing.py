"""Mixture-controlled packing: deficit round-robin over source queues.

In every round each source's deficit grows by its quantum (its share of a window's
tokens); it then sends pieces from its queue while the deficit covers them and
carries the rest into the next round. A queue that is never empty sends the piece
that ends at token ``c`` of its queue in round ``ceil(c / quantum)``, so rounds
follow from running sums per source and need no loop: the deficits carry over
windows and partitions by themselves. The pieces of round 0, 1, ... are laid end to
end and cut into sequences, so only the very last one can hold padding.

Running sums are taken in two or three levels (hash buckets of a queue, rounds in
groups of 1024), so one source may hold any share of the rows.

Defined results: null text is empty and its document holds the end id only; null
source is the queue of the empty string; repeated rows are documents of their own;
a source without a target weight gets the mean of the given ones; an empty table
gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.staging import staged, text_or_empty
from gondola.llm.tokens import encode_batches

SEQUENCE = 1024
#: Sequences a round of the queues fills: the window whose mixture is controlled.
WINDOW_SEQUENCES = 32
#: Hash buckets of a queue, each summed on its own.
BUCKETS = 4096

_TOKENS = "row long, doc_id long, source string, n long, packed binary"


def _pack_ids(raw: bytes, level: zstandard.ZstdCompressor) -> bytes:
    """Ids as compressed byte planes, about a third of their size in shuffles."""
    return level.compress(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_ids(packed: bytes, tool: zstandard.ZstdDecompressor) -> bytes:
    return np.ascontiguousarray(np.frombuffer(tool.decompress(packed), np.uint8).reshape(4, -1).T).tobytes()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, source, n, packed): each document's ids with ``end_id``, written once."""
    end = np.array([end_id], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, encoded in encode_batches(batch.column("text").to_pylist(), tokenizer):
                ids = [raw + end for raw in encoded]
                part = batch.slice(at, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("source"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([_pack_ids(x, tool) for x in ids], pa.binary()),
                    ],
                    ["row", "doc_id", "source", "n", "packed"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        text_or_empty().alias("text"),
    )
    return staged(rows.mapInArrow(kernel, _TOKENS), "tokens")


def _quanta(tokens: DataFrame, targets: DataFrame | None, flatten: float, window: int) -> DataFrame:
    """(source, quantum): tokens a source may send per round, by its target or by its size to the power ``flatten``."""
    size = F.sum("n").cast("double")
    sizes = tokens.groupBy("source").agg(F.pow(size, F.lit(float(flatten))).alias("_weight"))
    if targets is not None:
        given = targets.groupBy("source").agg(F.sum("weight").alias("_given"))
        mean = given.agg(F.avg("_given")).first()[0] or 1.0
        sizes = sizes.join(given, "source", "left").select(
            "source", F.coalesce("_given", F.lit(float(mean))).alias("_weight")
        )
    total = sizes.agg(F.sum("_weight")).first()[0] or 1
    return sizes.select("source", (F.col("_weight") * F.lit(float(window)) / F.lit(float(total))).alias("_quantum"))


def _round_starts(segments: DataFrame) -> DataFrame:
    """(round, base): tokens of all earlier rounds, summed over groups of 1024 and of 1024 of these."""
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = segments.groupBy("round").agg(F.sum("length").alias("_n")).select(
        "round", "_n", F.shiftright("round", 10).alias("_mid"), F.shiftright("round", 20).alias("_top")
    )
    mids = sums.groupBy("_top", "_mid").agg(F.sum("_n").alias("_n"))
    tops = mids.groupBy("_top").agg(F.sum("_n").alias("_n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    top_base = tops.select(
        "_top",
        zero(F.sum("_n").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1))).alias("_a"),
    )
    mid_base = mids.select("_top", "_mid", zero(F.sum("_n").over(earlier("_top", "_mid"))).alias("_b"))
    bases = mid_base.join(top_base, "_top").select("_mid", (F.col("_a") + F.col("_b")).alias("_ab"))
    inner = sums.select("round", "_mid", zero(F.sum("_n").over(earlier("_mid", "round"))).alias("_c"))
    return inner.join(bases, "_mid").select("round", (F.col("_ab") + F.col("_c")).alias("base"))


def layout(
    tokens: DataFrame,
    targets: DataFrame | None = None,
    flatten: float = 1.0,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(row, start, length, sequence_id, offset, window_id): where each piece of a document lies.

    ``tokens`` needs row (unique), source and n. ``targets`` (source, weight) sets the mixture.
    Without targets a source weighs its number of tokens to the power ``flatten``: 1 is its own
    share, 0 the same for all, and between them small sources come more often than they are.
    """
    quanta = _quanta(tokens, targets, flatten, sequence * window_sequences)
    queued = tokens.select("row", "source", "n", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("_bucket"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        queued.groupBy("source", "_bucket")
        .agg(F.sum("n").alias("_n"))
        .select("source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
        .join(quanta, "source")
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = queued.join(bases, ["source", "_bucket"]).withColumn(
        "_before", F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    cut = placed.withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {sequence}")))
    )
    start = F.col("_k") * sequence
    length = F.least(F.lit(sequence), F.col("n") - start)
    end = F.col("_before") + start + length
    segments = cut.select(
        "row",
        "source",
        start.alias("start"),
        length.alias("length"),
        F.ceil(end / F.col("_quantum")).cast("long").alias("round"),
        end.alias("_end"),
    )
    in_round = Window.partitionBy("round").orderBy("source", "_end").rowsBetween(Window.unboundedPreceding, -1)
    laid = segments.join(_round_starts(segments), "round").withColumn(
        "_at", F.col("base") + F.coalesce(F.sum("length").over(in_round), F.lit(0))
    )
    pieces = laid.withColumn(
        "_s",
        F.explode(
            F.sequence(F.expr(f"_at div {sequence}"), F.expr(f"(_at + length - 1) div {sequence}"))
        ),
    )
    begin = F.greatest(F.col("_at"), F.col("_s") * sequence)
    stop = F.least(F.col("_at") + F.col("length"), (F.col("_s") + 1) * sequence)
    return pieces.select(
        "row",
        (F.col("start") + begin - F.col("_at")).alias("start"),
        (stop - begin).alias("length"),
        F.col("_s").alias("sequence_id"),
        (begin - F.col("_s") * sequence).alias("offset"),
        F.col("round").alias("window_id"),
    )


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "source", "doc_tokens", "ids")}
        places: dict[str, list] = {k: [] for k in ("start", "length", "sequence_id", "offset", "window_id")}
        size = 0
        for row in batch.to_pylist():
            raw = _unpack_ids(row["packed"], tool)
            for p in row["pieces"]:
                out["doc_id"].append(row["doc_id"])
                out["source"].append(row["source"])
                out["doc_tokens"].append(row["n"])
                out["ids"].append(raw[4 * p["start"] : 4 * (p["start"] + p["length"])])
                for k, v in places.items():
                    v.append(p[k])
            size += len(raw)
            if size > 16_000_000:
                yield _piece_batch(out, places)
                size = 0
        if out["ids"]:
            yield _piece_batch(out, places)


def _piece_batch(out: dict[str, list], places: dict[str, list]) -> pa.RecordBatch:
    arrays = [
        pa.array(out["doc_id"], pa.int64()),
        pa.array(out["source"], pa.string()),
        pa.array(out["doc_tokens"], pa.int64()),
        pa.array(out["ids"], pa.binary()),
        *[pa.array(v, pa.int64()) for v in places.values()],
    ]
    names = [*out, *places]
    for v in [*out.values(), *places.values()]:
        v.clear()
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, targets: DataFrame | None = None, **shape) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit).

    (doc_id, source, doc_tokens, ids, start, length, sequence_id, offset, window_id).
    """
    tokens = tokenized(docs, tokenizer, end_id)
    places = layout(tokens, targets, **shape)
    per_row = places.groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset", "window_id")).alias("pieces")
    )
    joined = tokens.join(per_row, "row").select("doc_id", "source", "n", "packed", "pieces")
    return joined.mapInArrow(
        _cut_kernel,
        "doc_id long, source string, doc_tokens long, ids binary, start long, length long, "
        "sequence_id long, offset long, window_id long",
    )


def padded_length(length: Column, sequence: int = SEQUENCE) -> Column:
    """``sequence`` for a full one, the next power of two for a shorter one."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(length.cast("double")))).cast("long")
    return F.when(length >= sequence, F.lit(sequence).cast("long")).otherwise(power)


def sequences(pieces: DataFrame, pad_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences with their padding, at most ``sequence`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    pad = pad_id.to_bytes(4, "little").hex()
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
    missing = (padded_length(F.col("length"), sequence) - F.col("length")).cast("int")
    return grouped.select(
        "sequence_id",
        "length",
        F.concat("ids", F.unhex(F.repeat(F.lit(pad), missing))).alias("ids"),
    )


def mixture(pieces: DataFrame) -> DataFrame:
    """(window_id, source, tokens, share): the mixture each window got."""
    sums = pieces.groupBy("window_id", "source").agg(F.sum("length").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy("window_id"))
    return sums.withColumn("share", F.col("tokens") / whole)
