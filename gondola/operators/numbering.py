"""Consecutive numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.session import cut_lineage

# monotonically_increasing_id() keeps the partition above bit 33.
_LOCAL_BITS = 33


def number_rows(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name`` = start, start+1, ... in the order of ``order_by``.

    Rows are range partitioned, sorted inside each partition and numbered
    there; one count per partition gives the offsets. The offsets table has one
    row per partition, which is what makes its broadcast bounded.
    """
    return number_in_place(df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by), name, start)


def number_in_place(df: DataFrame, name: str, start: int = 0, rows: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... in the order of the partitions of ``df``, which is written once, in row groups of ``rows``."""
    marked = df.withColumn("_mono", F.monotonically_increasing_id())
    kept = cut_lineage(marked, rows=rows) if rows else cut_lineage(marked)
    return _placed(kept, "_mono", name, start).drop("_mono")


def _placed(kept: DataFrame, mono: str, name: str, start: int = 0) -> DataFrame:
    """Add consecutive numbers to a cut whose column ``mono`` is ``monotonically_increasing_id()``."""
    kept = kept.withColumn("_part", F.shiftright(mono, _LOCAL_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.col(mono) - F.shiftleft(F.col("_part"), _LOCAL_BITS)
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.lit(start) + F.col("_offset") + local).cast("long"))
        .drop("_part", "_offset")
    )


def assign_ids(new_rows: DataFrame, existing: DataFrame, id_col: str, order_by: list[str]) -> DataFrame:
    """Number ``new_rows`` above the largest id already in ``existing``.

    That id is the only value that reaches the driver.
    """
    return number_rows(new_rows, order_by, id_col, start=_next_id(existing, id_col))


def assign_group_ids(rows: DataFrame, existing: DataFrame, id_col: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per key with its aggregates, numbered in the order of the keys above the largest id in ``existing``.

    Rows are range partitioned by the keys once, which serves both the groups and their numbers.
    """
    groups = rows.repartitionByRange(*[F.col(k) for k in keys]).groupBy(*keys).agg(*aggregates)
    return number_in_place(groups.sortWithinPartitions(*keys), id_col, _next_id(existing, id_col))


def _next_id(existing: DataFrame, id_col: str) -> int:
    return existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0] + 1
