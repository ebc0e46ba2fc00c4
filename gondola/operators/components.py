"""Connected components by repeated hooking, shortcutting and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.session import cut_lineage, forget


def _shortcut(parents: DataFrame) -> DataFrame:
    """Point every vertex at the end of its chain; chains halve each round. Takes and gives a cut (v, p)."""
    while True:
        up = parents.select(F.col("v").alias("_at"), F.col("p").alias("_up"))
        jumped = cut_lineage(
            parents.join(up, F.col("p") == F.col("_at"), "left").select(
                "v", F.coalesce("_up", "p").alias("p"), (F.coalesce("_up", "p") != F.col("p")).alias("moved")
            )
        )
        forget(parents)
        parents = jumped
        if jumped.where("moved").isEmpty():
            return parents


def components(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, root): root is the smallest id reachable over ``edges`` (src, dst).

    Each round every vertex hooks to its smallest neighbour, chains collapse to
    their root, and the edges are rewritten between roots until none is left.
    All steps are minimum-aggregations and joins, so a vertex with very many
    neighbours is combined on the map side and is never gathered in one task.
    """

    def tidy(e: DataFrame) -> DataFrame:
        ordered = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return cut_lineage(ordered.where("src <> dst").distinct())

    edges = tidy(edges)
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooked = both.groupBy("src").agg(F.min("dst").alias("m"))
        parents = _shortcut(cut_lineage(hooked.select(F.col("src").alias("v"), F.least("src", "m").alias("p"))))
        before = labels
        if before is None:
            labels = cut_lineage(parents.select("v", "p"))
        else:
            step = parents.select(F.col("v").alias("_at"), F.col("p").alias("_up"))
            labels = cut_lineage(
                before.join(step, F.col("p") == F.col("_at"), "left").select("v", F.coalesce("_up", "p").alias("p"))
            )
        source = parents.select(F.col("v").alias("src"), F.col("p").alias("a"))
        target = parents.select(F.col("v").alias("dst"), F.col("p").alias("b"))
        merged = edges.join(source, "src").join(target, "dst")
        left = tidy(merged.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        forget(edges, parents, before)
        edges = left
    all_ids = vertices.select(id_col)
    if labels is None:
        return all_ids.withColumn("root", F.col(id_col))
    named = labels.select(F.col("v").alias(id_col), F.col("p").alias("root"))
    return all_ids.join(named, id_col, "left").withColumn("root", F.coalesce("root", id_col))
