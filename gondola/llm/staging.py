"""Tables written to the shared folder, and small helpers the operators have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.session import cut_lineage, shared_path  # noqa: F401


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; later steps read only the columns they need."""
    return cut_lineage(df, name)


#: Rows of a batch that a task turns into Python values at once.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time; memory no longer used goes back in between."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_columns(names: list[str]) -> Column:
    """The columns ``names`` as one struct, so that no name can clash with those an operator makes."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in names])
