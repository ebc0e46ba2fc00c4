"""Search documents: a family with its variations, prices and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.routes import null_if_zero
from gondola.operators.lists import nest


def catalogue_join(
    store_products: DataFrame, products: DataFrame, families: DataFrame, brands: DataFrame, stores: DataFrame
) -> DataFrame:
    """Every store offer with its product, family, brand and store.

    Of the two name columns the product's is kept.
    """
    offers = store_products.drop("name")
    return (
        offers.join(stores.select("store_id", F.col("slug").alias("store_slug")), "store_id")
        .join(products.select("product_id", "family_id", "name", "weight", "measure"), "product_id")
        .join(families.select("family_id", "brand_id", F.col("name").alias("family_name")), "family_id")
        .join(brands.select("brand_id", F.col("slug").alias("brand")), "brand_id")
    )


def price_range(store_products: DataFrame) -> DataFrame:
    """Lowest and highest non-zero price per product, and its first image.

    Runs on the offers alone, before any join, so a product sold everywhere is
    one row by the time it is shuffled to its family.
    """
    price = null_if_zero(F.col("price")).cast("double")
    return store_products.groupBy("product_id").agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.min_by("image_url", "store_product_id").alias("image_url"),
    )


def store_set(store_products: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct (product, store slug)."""
    return store_products.join(stores.select("store_id", "slug"), "store_id").select("product_id", "slug").distinct()


def document_variations(
    store_products: DataFrame, products: DataFrame, families: DataFrame, brands: DataFrame, stores: DataFrame
) -> DataFrame:
    """One row per product that some known store offers."""
    offered = store_products.join(stores.select("store_id"), "store_id", "left_semi")
    return (
        price_range(offered)
        .join(products.select("product_id", "family_id", "name", "weight", "measure"), "product_id")
        .join(families.select("family_id", "brand_id", F.col("name").alias("family_name")), "family_id")
        .join(brands.select("brand_id", F.col("slug").alias("brand")), "brand_id")
        .withColumn("weight", null_if_zero(F.col("weight")))
        .drop("brand_id")
    )


def build_documents(
    store_products: DataFrame,
    products: DataFrame,
    families: DataFrame,
    brands: DataFrame,
    stores: DataFrame,
) -> DataFrame:
    """Nested documents, one per family, variations by weight (none counts as 0) then id.

    The store list of a variation is a set over the stores table, which is the
    configuration of the shop chains.
    """
    slugs = store_set(store_products, stores).groupBy("product_id").agg(
        F.array_sort(F.collect_set("slug")).alias("stores")
    )
    flat = document_variations(store_products, products, families, brands, stores).join(slugs, "product_id")
    element = F.struct(
        F.coalesce("weight", F.lit(0)).alias("_sort"),
        "product_id",
        *[c for c in ("name", "weight", "measure", "image_url", "stores", "min_price", "max_price")],
    )
    nested = nest(flat, ["family_id", "family_name", "brand"], element, "variations")
    return nested.select(
        F.col("family_id").alias("id"),
        F.col("family_name").alias("name"),
        "brand",
        F.transform("variations", lambda v: v.dropFields("_sort")).alias("variations"),
    )


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents replace old ones of the same id; the others stay."""
    kept = old.join(new.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(new)


def document_headers(variations: DataFrame) -> DataFrame:
    """(id, name, brand): what the search reads, one row per family of ``document_variations``."""
    return variations.select(F.col("family_id").alias("id"), F.col("family_name").alias("name"), "brand").distinct()


def bulk_lines(docs: DataFrame) -> DataFrame:
    """Action line and document line per document, next to each other."""
    action = F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("_id")).alias("index")))
    body = F.to_json(F.struct("id", "name", "brand", "variations"), {"ignoreNullFields": "false"})
    return docs.select(F.explode(F.array(action, body)).alias("value"))


def write_bulk_index(docs: DataFrame, path: str) -> None:
    bulk_lines(docs).write.mode("overwrite").text(path)
