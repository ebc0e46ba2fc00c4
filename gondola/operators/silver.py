"""Bronze listings to silver: one select over the listings of all stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.measure import parse_measure
from gondola.functions.text import brand_slug, normalize_name, remove_word_original, strip_private_label
from gondola.session import cut_lineage
from gondola.sources.stores import STORES, Store

SILVER = {
    "name": "string", "brand": "string", "ref_id": "string", "measure": "string", "weight": "int",
    "link": "string", "cart_link": "string", "price": "double", "old_price": "double", "image_url": "string",
}


def rename_source_columns(df: DataFrame, store: Store) -> DataFrame:
    return df.withColumnsRenamed(store.columns)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that are not kept; absent ones are no error."""
    return df.drop(*(names or ("clusterHighlights", "searchableClusters")))


def extract_offer(items: Column) -> Column:
    """Struct of the first item's first seller and first image; missing is null."""
    item = F.get(items, F.lit(0))
    seller = F.get(item["sellers"], F.lit(0))
    offer = seller["commertialOffer"]
    return F.struct(
        F.get(item["images"], F.lit(0))["imageUrl"].alias("image_url"),
        seller["addToCartLink"].alias("cart_link"),
        offer["Price"].alias("price"),
        offer["ListPrice"].alias("old_price"),
    )


def project_silver(df: DataFrame) -> DataFrame:
    """The fixed silver columns; absent ones become null."""
    kept = [c for c in ("store_id", "inserted_at") if c in df.columns]
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SILVER.items()], *kept
    )


def with_audit_columns(df: DataFrame, store_id: int | Column) -> DataFrame:
    sid = store_id if isinstance(store_id, Column) else F.lit(store_id)
    return df.withColumns({"store_id": sid.cast("int"), "inserted_at": F.current_timestamp()})


def all_stores(pages: dict[str, DataFrame], only: str | None = None) -> DataFrame:
    """Bronze listings of every store under common column names."""
    parts = []
    for store in STORES:
        if store.slug in pages and only in (None, store.slug):
            renamed = rename_source_columns(drop_columns(pages[store.slug]), store)
            parts.append(renamed.withColumn("store_id", F.lit(store.store_id)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_silver(
    listings: DataFrame, stores: DataFrame, drops_original: list[int] | None = None, strict_units: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(silver, rejected) from bronze listings with store_id, name, brand, weight,
    measure and either ``items`` or the offer columns.

    ``stores`` (store_id, slug) says which brand is a store's own. Listings
    without a name or brand cannot be normalised and are returned as rejected.
    """
    dropping = [s.store_id for s in STORES if s.drops_original] if drops_original is None else drops_original
    if "items" in listings.columns:
        listings = listings.withColumn("_offer", extract_offer(F.col("items"))).select(
            *[c for c in listings.columns if c != "items"], "_offer.*"
        )
    usable = F.col("name").isNotNull() & F.col("brand").isNotNull()
    rejected = listings.where(~usable)
    # Sellers share names: each different text is cleaned once, and a listing fetches the result.
    raw = ["name", "brand", "weight", "measure", "_drops"]
    named = listings.where(usable).withColumn("_drops", F.coalesce(F.col("store_id").isin(dropping), F.lit(False)))
    texts = named.select(*raw).distinct().select(
        *[F.col(c).alias(f"_raw{i}") for i, c in enumerate(raw)],
        F.when(F.col("_drops"), remove_word_original(F.col("name"), F.col("brand"))).otherwise(F.col("name")).alias("name"),
        "brand", "weight", "measure",
    )
    known = cut_lineage(
        texts.select(
            *[f"_raw{i}" for i in range(len(raw))],
            parse_measure(F.col("weight"), F.col("measure"), F.col("name"), strict_units).alias("_m"),
            normalize_name(F.col("name")).alias("_name"),
            brand_slug(F.col("brand")).alias("_brand"),
        )
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_raw{i}")) for i, c in enumerate(raw)])
    cleaned = named.join(known.hint("merge"), same).select(
        *[c for c in named.columns if c not in raw], "_m", F.col("_name").alias("name"), F.col("_brand").alias("brand")
    )
    own = cleaned.join(stores.select("store_id", F.col("slug").alias("_slug")), "store_id", "left").withColumn(
        "_n", strip_private_label(F.col("name"), F.col("brand"), F.coalesce("_slug", F.lit("\u0000")))
    )
    flat = own.withColumns(
        {"name": F.col("_n.name"), "brand": F.col("_n.brand"), "measure": F.col("_m.measure"), "weight": F.col("_m.weight")}
    )
    return project_silver(with_audit_columns(flat, F.col("store_id"))), rejected


def drop_unpriced(df: DataFrame) -> DataFrame:
    """Drop rows priced 0 and 0; a missing price keeps the row."""
    return df.where(~F.coalesce((F.col("price") == 0) & (F.col("old_price") == 0), F.lit(False)))
