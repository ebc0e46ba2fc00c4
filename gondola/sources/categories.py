"""Category tree: paths of the leaves, and which of them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.text import leaf_path
from gondola.session import cut_lineage


def flatten_category_tree(edges: DataFrame) -> DataFrame:
    """(id, path) of every leaf, path as ``/a/b/leaf/``, from edges (id, parent_id).

    Walks down level by level: one join of the current level with the edges per
    level of the tree, whatever its size. An edge back to a category that is
    already on its own path is not followed, so a cycle ends.
    """
    edges = edges.select("id", "parent_id")
    inner = edges.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    level = cut_lineage(edges.where("parent_id is null").select("id", leaf_path(F.lit(""), F.col("id")).alias("path")))
    leaves = None
    while not level.isEmpty():
        done = level.join(inner, "id", "left_anti").select("id", F.concat("path", F.lit("/")).alias("path"))
        leaves = done if leaves is None else leaves.unionByName(done)
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        step = leaf_path(F.lit(""), F.col("id"))
        again = F.contains(F.concat("_above", F.lit("/")), F.concat(step, F.lit("/")))
        below = edges.join(above, "parent_id").where(~again)
        level = cut_lineage(below.select("id", leaf_path(F.col("_above"), F.col("id")).alias("path")))
    return level.limit(0) if leaves is None else leaves


def allowed_categories(paths: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct paths that are not excluded; excluding a parent leaves its children."""
    return paths.select("path").subtract(excluded.select("path"))
