"""Registered query on the structure of conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import turn_repair
from gondola.llm.registry import query, table


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` dropped, emptied, cut off, repeated or given role user by the hash of id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("case"))
        .where("case <> 0")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _digest_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which follow one another; only its state is held."""
    current, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[str, str]] = []
        for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if c != current:
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8", "surrogatepass"))
        yield _digests(done)
    if current is not None:
        yield _digests([(current, digest.hexdigest())])


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["c", "digest"]
    )


def digests(turns: DataFrame) -> DataFrame:
    """(c, digest) of the newline-joined ``role:text`` of each conversation's turns."""
    lines = turns.select("c", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_lines = lines.repartition("c").sortWithinPartitions("c", "place")
    return sorted_lines.select("c", "line").mapInArrow(_digest_kernel, "c string, digest string")


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    made = turn_repair.repair(damaged(rows))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty: Column = F.sha2(F.lit("").cast("binary"), 256)
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return (
        ids.withColumn("c", turn_repair.by_conversation(F.col("conv_id")))
        .join(made.conversations, "c", "left")
        .join(digests(made.turns), "c", "left")
        .select(
            "conv_id",
            *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("digest", empty).alias("repaired_sha256"),
        )
    )
