"""Gold layer: families of listings with their variations and sellers.

Kept as three flat tables so that no family, however large, has to fit in one
row; ``nest_gold`` and ``flatten_gold`` convert to and from the nested form.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.vectors import clean_names, embed_texts, vector_key
from gondola.operators.clusters import cluster_names, cluster_number
from gondola.operators.lists import nest
from gondola.operators.numbering import number_rows
from gondola.operators.silver import drop_unpriced
from gondola.session import cut_lineage

FAMILY = ["store_id", "brand", "cluster"]
VARIATION = [*FAMILY, "weight", "measure"]
SELLER = ["price", "old_price", "link", "cart_link", "ref_id"]


class Gold(NamedTuple):
    families: DataFrame  # FAMILY, name, embedded_name
    variations: DataFrame  # VARIATION, name, image_url
    sellers: DataFrame  # VARIATION, row_id, SELLER


def group_families(listings: DataFrame) -> DataFrame:
    """Listings that have a family: brand and cluster are known."""
    return listings.where("brand is not null and cluster is not null")


def representative(members: DataFrame, *columns: str) -> DataFrame:
    """First row of every family: its name and the other given columns."""
    first = members.groupBy(*FAMILY).agg(F.min_by(F.struct("name", *columns), "row_id").alias("_first"))
    return first.select(*FAMILY, "_first.*")


def group_variations(members: DataFrame) -> DataFrame:
    """First known name and image per (family, weight, measure)."""
    sized = members.where("weight is not null and measure is not null")

    def first_known(column: str):
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("row_id"))).alias(column)

    return sized.groupBy(*VARIATION).agg(first_known("name"), first_known("image_url"))


def sellers(members: DataFrame) -> DataFrame:
    sized = members.where("weight is not null and measure is not null")
    return sized.select(*VARIATION, "row_id", *SELLER)


def with_row_ids(silver: DataFrame) -> DataFrame:
    """Number the rows by (store_id, ref_id) and the remaining columns.

    The order decides every later "first"; it must not depend on file order.
    """
    rest = ["name", "brand", "measure", "weight", "price", "old_price", "link", "cart_link", "image_url"]
    return number_rows(silver, ["store_id", "ref_id", *[c for c in rest if c in silver.columns]], "row_id")


def build_gold(silver: DataFrame, eps: float = 0.01, model=None, stopwords=None) -> Gold:
    """Cluster the names of each store and group listings by (brand, cluster).

    A name's vector depends on its cleaned text alone. Each distinct name is cleaned once
    and each distinct text embedded once; listings carry neither text nor vector, and equal
    texts of a store are one point of the clustering, which gets the keys of their vectors.
    Vectors of hashed words are mostly zeros, so their files are many times smaller than
    their rows: merge joins are asked for, as a broadcast chosen by the size of the files
    fills the driver.
    """
    priced = drop_unpriced(silver)
    listings = cut_lineage(priced if "row_id" in silver.columns else with_row_ids(priced))
    names = listings.select("name").where("name is not null").distinct()
    texts = cut_lineage(names.withColumn("_text", clean_names(F.col("name"), stopwords)))
    embedded = embed_texts(texts.select("_text").distinct(), "_text", "embedded_name", model)
    vectors = cut_lineage(embedded.withColumns(vector_key(F.col("embedded_name"))))
    by_name = listings.groupBy("store_id", "name").agg(F.min("row_id").alias("id"))
    named = cut_lineage(by_name.join(texts.hint("merge"), "name"))
    points = named.groupBy("store_id", "_text").agg(F.min("id").alias("id"))
    placed = cut_lineage(points.join(vectors.select("_text", "_v1", "_v2").hint("merge"), "_text"))
    roots = cluster_names(placed, "id", "embedded_name", eps, ["store_id"], vectors=vectors)
    numbers = cluster_number(roots, ["store_id"]).select("id", "cluster")
    by_text = placed.select("store_id", "_text", "id").join(numbers.hint("merge"), "id").drop("id")
    clustered = named.drop("id").join(by_text.hint("merge"), ["store_id", "_text"])
    members = cut_lineage(group_families(listings.join(clustered.hint("merge"), ["store_id", "name"])))
    families = representative(members, "_text").join(vectors.drop("_v1", "_v2").hint("merge"), "_text").drop("_text")
    return Gold(families, group_variations(members), sellers(members))


def nest_gold(gold: Gold) -> DataFrame:
    """One row per family."""
    seller = F.struct("row_id", "store_id", *SELLER)
    lists = nest(gold.sellers, VARIATION, seller, "sellers")
    filled = gold.variations.join(lists, VARIATION)
    element = F.struct("weight", "measure", "name", "image_url", "sellers")
    grouped = nest(filled, FAMILY, element, "variations")
    return gold.families.join(grouped, FAMILY)


def flatten_gold(nested: DataFrame) -> Gold:
    """The flat tables of nested families."""
    variations = nested.select(*FAMILY, F.posexplode("variations").alias("_pos", "v")).select(
        *FAMILY, "_pos", "v.weight", "v.measure", "v.name", "v.image_url", "v.sellers"
    )
    offers = variations.select(*VARIATION, "_pos", F.explode("sellers").alias("s")).select(*VARIATION, "s.row_id", *[f"s.{c}" for c in SELLER])
    named = variations.groupBy(*VARIATION).agg(
        F.min_by("name", "_pos").alias("name"), F.min_by("image_url", "_pos").alias("image_url")
    )
    return Gold(nested.select(*FAMILY, "name", "embedded_name").dropDuplicates(FAMILY), named, offers)
