"""Blocked vector comparisons.

Vectors are packed into tiles of bounded size; tiles that can hold a match are
paired by an equi-join on small descriptions (group, centre, radius), and each
surviving pair of tiles is compared by one matrix product inside a task. Tiles travel by
rack, a bounded run of neighbouring tiles: a task holds one rack and one more tile
at a time, however large a group is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.operators.numbering import number_in_place
from gondola.session import cut_lineage

TILE_ROWS = 256
# Tiles per side of a pairing task before the pairing is spread out.
_SPREAD_TILES = 4096
# Bytes of vectors of one rack, and racks a side is divided into at least if it has as many tiles.
_RACK_BYTES, _RACKS = 32 << 20, 16
# Tiles that a reader takes into memory at once.
_READ_TILES = 128


def pack(
    df: DataFrame,
    group: list[str],
    id_col: str,
    vec_col: str,
    order: list[str],
    extra: list[str] | None = None,
    rows: int = TILE_ROWS,
) -> DataFrame:
    """Tiles (group.., tile_id, ids, extra.., vectors, n, centre, radius), numbered from 0.

    Range partitioning on (group, order) spreads a large group over many tasks
    and keeps neighbours together, so that tiles are tight.
    """
    extra = extra or []
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType(
        [T.StructField(g, kinds[g]) for g in group]
        + [T.StructField("ids", T.ArrayType(T.LongType()))]
        + [T.StructField(e, T.ArrayType(kinds[e])) for e in extra]
        + [
            T.StructField("vectors", T.BinaryType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("centre", T.ArrayType(T.DoubleType())),
            T.StructField("radius", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()

    def tile(part: pd.DataFrame) -> dict:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in part[vec_col]])
        centre = matrix.mean(axis=0)
        first = part.iloc[0]
        return {
            **{g: first[g] for g in group},
            "ids": part[id_col].tolist(),
            **{e: part[e].tolist() for e in extra},
            "vectors": matrix.tobytes(),
            "n": len(part),
            "centre": centre.tolist(),
            "radius": float(np.sqrt(((matrix - centre) ** 2).sum(axis=1).max())),
        }

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows = None
        for batch in batches:
            if batch.empty:
                continue
            rest = batch if open_rows is None else pd.concat([open_rows, batch], ignore_index=True)
            if group:
                run = (rest[group] != rest[group].shift()).any(axis=1).cumsum().to_numpy()
            else:
                run = np.zeros(len(rest), dtype=int)
            starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
            out, open_rows = [], None
            for at, end in zip(starts, [*starts[1:], len(rest)]):
                while end - at >= rows:
                    out.append(tile(rest.iloc[at : at + rows]))
                    at += rows
                if at == end:
                    continue
                if end == len(rest):
                    open_rows = rest.iloc[at:end]
                else:
                    out.append(tile(rest.iloc[at:end]))
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_rows is not None:
            yield pd.DataFrame([tile(open_rows)], columns=names)

    keys = [*group, *order]
    needed = df.select(*dict.fromkeys([*group, id_col, vec_col, *order, *extra]))
    sorted_rows = needed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return number_in_place(sorted_rows.mapInPandas(build, schema), "tile_id", rows=_READ_TILES)


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def describe(tiles: DataFrame, *columns: str) -> DataFrame:
    """The small part of a tile that pairing needs."""
    return tiles.select(*columns, "tile_id", "centre", "radius")


def _stripes(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame | None:
    """(group.., _stripes) of the groups whose pairs are spread over more than one task; None without any."""
    both = left.select(*group, F.lit(1).alias("_a")).unionByName(right.select(*group, F.lit(0).alias("_a")))
    sizes = both.groupBy(*group).agg(F.greatest(F.sum("_a"), F.count(F.lit(1)) - F.sum("_a")).alias("_n")).where(F.col("_n") > _SPREAD_TILES)
    large = cut_lineage(sizes.select(*group, F.ceil(F.sqrt(F.col("_n") / _SPREAD_TILES)).cast("int").alias("_stripes")))
    return None if large.isEmpty() else large


def _with_stripes(side: DataFrame, stripes: DataFrame, group: list[str]) -> DataFrame:
    sized = side.join(stripes, group, "left") if group else side.crossJoin(stripes)
    return sized.withColumn("_stripes", F.coalesce("_stripes", F.lit(1)))


def pair(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    reach: float | None,
    condition: Column | None = None,
    measured: bool = False,
) -> DataFrame:
    """(left_tile, right_tile) with equal group that may hold points within ``reach``.

    ``measured`` adds ``near``, the distance of the centres, and ``gap``, the least one of any points.

    The tiles of one group meet on a grid of (row stripe, column stripe) keys, so
    the pairs of a single large group are spread over many tasks. The grid follows
    the size of the group, so tiles of small groups stand in one cell only.
    """
    stripes = _stripes(left, right, group)

    def striped(side: DataFrame, own: str, every: str) -> DataFrame:
        sized = side.withColumn("_stripes", F.lit(1)) if stripes is None else _with_stripes(side, stripes, group)
        placed = sized.withColumn(own, F.pmod(F.hash("tile_id"), F.col("_stripes")))
        return placed.withColumn(every, F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1))).drop("_stripes")

    a, b = striped(left, "_row", "_col").alias("a"), striped(right, "_col", "_row").alias("b")
    on = (F.col("a._row") == F.col("b._row")) & (F.col("a._col") == F.col("b._col"))
    for g in group:
        on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    if condition is not None:
        on = on & condition
    near = distance(F.col("a.centre"), F.col("b.centre"))
    gap = near - F.col("a.radius") - F.col("b.radius")
    if reach is not None:
        on = on & (gap <= reach + 1e-9)
    measures = [near.alias("near"), gap.alias("gap")] if measured else []
    return a.join(b.hint("merge"), on).select(F.col("a.tile_id").alias("left_tile"), F.col("b.tile_id").alias("right_tile"), *measures)


def _rack_tiles(tiles: DataFrame) -> int:
    """Tiles of a rack; only their number and the largest size reach the driver."""
    count, values = tiles.agg(F.count(F.lit(1)), F.max(F.col("n") * F.size("centre"))).first()
    return max(1, min(_RACK_BYTES // (8 * max(1, values or 1)), math.ceil(count / _RACKS)))


def compare(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[dict, dict], pd.DataFrame | None] | Callable[[dict, list[dict]], pd.DataFrame | None],
    schema: str,
    extra: list[str] | None = None,
    together: bool = False,
) -> DataFrame:
    """Run ``kernel`` on the two tiles of every pair and keep what it returns.

    With ``together`` it gets a left tile and the list of all right tiles it meets in a
    rack, so that what it returns need not grow with the pairs.

    A kernel gets dictionaries with ``tile``, ``ids``, ``x`` (the matrix) and the
    extra columns. Pairs meet in cells of a left and a right rack: a tile is sent once
    per cell it has a pair in, not once per pair. A task reads the right tiles of a cell,
    then one left tile after the other with the numbers of those it meets. The result is
    written to the checkpoint folder at once, with small Arrow batches, because one row
    carries a whole tile.
    """
    spark = pairs.sparkSession
    fields = ["ids", "vectors", "n", *(extra or [])]
    cell = ["_row", "_column"]
    per_left = _rack_tiles(left)
    per_right = per_left if right is left else _rack_tiles(right)
    placed = pairs.select(
        F.floor(F.col("left_tile") / per_left).alias("_row"), F.floor(F.col("right_tile") / per_right).alias("_column"),
        "left_tile", "right_tile",
    )
    met = placed.groupBy(*cell, F.col("left_tile").alias("tile_id")).agg(F.collect_list("right_tile").alias("_others"))
    wanted = placed.select(*cell, F.col("right_tile").alias("tile_id")).distinct()
    wanted = wanted.withColumn("_others", F.lit(None).cast("array<long>"))

    def side(asked: DataFrame, tiles: DataFrame) -> DataFrame:
        return asked.join(tiles.select("tile_id", *fields).hint("merge"), "tile_id").select(*cell, "_others", "tile_id", *fields)

    def unpack(row) -> dict:
        out = {
            "tile": row.tile_id,
            "ids": np.asarray(row.ids, dtype=np.int64),
            "x": np.frombuffer(row.vectors, dtype=np.float64).reshape(row.n, -1),
        }
        for c in extra or []:
            out[c] = np.asarray(getattr(row, c))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, rack = None, {}
        for batch in batches:
            others, at = batch["_others"].tolist(), list(zip(batch["_row"], batch["_column"]))
            for place, asked, row in zip(at, others, batch.drop(columns=["_others", *cell]).itertuples(index=False)):
                if place != here:
                    here, rack = place, {}
                tile = unpack(row)
                if asked is None:
                    rack[tile["tile"]] = tile
                    continue
                met = [rack[other] for other in asked]
                for found in [kernel(tile, met)] if together else (kernel(tile, other) for other in met):
                    if found is not None and len(found):
                        yield found

    # Rows without a list, the right tiles, come first in their cell.
    both = side(wanted, right).unionByName(side(met, left))
    dealt = both.repartition(*cell).sortWithinPartitions(*cell, F.col("_others").isNotNull())
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "32")
    try:
        return cut_lineage(dealt.mapInPandas(run, schema))
    finally:
        spark.conf.set(setting, before)
