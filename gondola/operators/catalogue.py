"""Catalogue seeding and merging as functions (old snapshot, batch) -> new snapshot.

Tables
  brands          brand_id, slug, name
  families        family_id, brand_id, name, embedded_name
  products        product_id, family_id, name, weight, measure
  store_products  store_product_id, store_id, product_id, ref_id, name, price,
                  old_price, link, cart_link, image_url

"First" and "last" within a batch follow ORDER. A whole batch is matched against
the old snapshot; rows of one batch do not see each other's inserts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.vectors import vector_literal
from gondola.operators.gold import FAMILY, VARIATION, Gold
from gondola.operators.match import (
    existing_listings,
    match_brand,
    match_family,
    match_variation,
    number_families,
    vector_key,
)
from gondola.operators.numbering import assign_group_ids, assign_ids
from gondola.session import cut_lineage, joins_by_buckets

ORDER = [*VARIATION, "row_id"]
UPDATED = ["price", "old_price", "name", "link", "cart_link", "image_url"]
OFFER = ["ref_id", *UPDATED]


class Catalogue(NamedTuple):
    brands: DataFrame
    families: DataFrame
    products: DataFrame
    store_products: DataFrame


class Merge(NamedTuple):
    catalogue: Catalogue
    metrics: DataFrame
    ignored: DataFrame


def _equal(left: str, right: str, *columns: str) -> Column:
    """Null-safe equality of several columns."""
    out = F.col(f"{left}.{columns[0]}").eqNullSafe(F.col(f"{right}.{columns[0]}"))
    for c in columns[1:]:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def batch_offers(gold: Gold, *more: str) -> DataFrame:
    """Sellers with the name, the image and ``more`` columns of their variation; ref_id as a number.

    Few files may hold many variations: no broadcast by the size of files.
    """
    named = gold.sellers.join(gold.variations.select(*VARIATION, "name", "image_url", *more).hint("merge"), VARIATION)
    return named.withColumn("ref_id", F.col("ref_id").try_cast("int"))


def unreadable_refs(gold: Gold) -> DataFrame:
    """Sellers whose ref_id is no number; such rows match no listing."""
    return gold.sellers.where(F.col("ref_id").isNotNull() & F.col("ref_id").try_cast("int").isNull())


# --- seeding -----------------------------------------------------------------


def distinct_brands(families: DataFrame) -> DataFrame:
    return families.select("brand").distinct()


def insert_brands(families: DataFrame, brands: DataFrame) -> DataFrame:
    slugs = distinct_brands(families).where("brand is not null").select(F.col("brand").alias("slug"))
    new = slugs.join(brands, "slug", "left_anti").withColumn("name", F.col("slug"))
    return brands.unionByName(assign_ids(new, brands, "brand_id", ["slug"]).select(*brands.columns))


def lookup_brand_id(df: DataFrame, brands: DataFrame) -> DataFrame:
    """Add brand_id by exact slug; null where there is none."""
    return df.join(brands.select("brand_id", F.col("slug").alias("brand")), "brand", "left")


def dedupe_families(families: DataFrame) -> DataFrame:
    """First family of every name, whatever its brand."""
    rest = [c for c in families.columns if c != "name"]
    first = families.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct(*FAMILY)).alias("_first"))
    return first.select("name", "_first.*")


def insert_families(
    gold: DataFrame, brands: DataFrame, families: DataFrame, mirror: bool = False
) -> DataFrame:
    """Append families; names already there under the same brand are left out.

    ``mirror`` appends without that check, as the source application does, so
    that a second run repeats every family. Families are chosen and numbered without
    their vectors, which are fetched for the new ones alone.
    """
    key = [*FAMILY, "name"]
    first = lookup_brand_id(dedupe_families(gold.select(*key)), brands)
    if not mirror:
        n, f = first.alias("n"), families.alias("f")
        first = n.join(f, _equal("n", "f", "brand_id", "name"), "left_anti").select("n.*")
    n, g = assign_ids(first, families, "family_id", ["name"]).alias("n"), gold.select(*key, "embedded_name").alias("g")
    vector = vector_literal(F.col("g.embedded_name")).alias("embedded_name")
    made = n.join(g, _equal("n", "g", *key)).select("n.family_id", "n.brand_id", "n.name", vector)
    return families.unionByName(made.dropDuplicates(["family_id"]).select(*families.columns))


def last_wins_map(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One id per key: the highest, which was inserted last."""
    return df.groupBy(*keys).agg(F.max(id_col).alias(id_col))


def lookup_family(
    variations: DataFrame, gold: DataFrame, families: DataFrame, brands: DataFrame | None = None
) -> DataFrame:
    """Variations with the family_id of their gold row's name, or null.

    With ``brands`` a family must have the gold row's brand too, so equal names of
    two brands stay apart; the source application looks at the name alone.
    """
    if brands is not None:
        last = last_wins_map(families, ["brand_id", "name"], "family_id").alias("f")
        known = lookup_brand_id(gold.select(*FAMILY, "name"), brands).alias("g")
        named = known.join(last, _equal("g", "f", "brand_id", "name"), "left").select(
            *[f"g.{c}" for c in FAMILY], F.col("g.name").alias("family_name"), "f.family_id"
        )
        return variations.join(named, FAMILY)
    by_name = last_wins_map(families, ["name"], "family_id").withColumnRenamed("name", "family_name")
    named = gold.select(*FAMILY, F.col("name").alias("family_name")).join(by_name, "family_name", "left")
    return variations.join(named, FAMILY)


def insert_products(gold: Gold, families: DataFrame, products: DataFrame) -> DataFrame:
    """Append the variations of known families, one product per distinct variation."""
    key = ["family_id", "name", "weight", "measure"]
    wanted = lookup_family(gold.variations, gold.families, families).where("family_id is not null")
    n, p = wanted.select(*key).distinct().alias("n"), products.alias("p")
    new = n.join(p, _equal("n", "p", *key), "left_anti").select("n.*")
    return products.unionByName(assign_ids(new, products, "product_id", key).select(*products.columns))


def lookup_product(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Offers with the product_id of (name, weight, measure), or null."""
    key = ["name", "weight", "measure"]
    o, p = offers.alias("o"), last_wins_map(products, key, "product_id").alias("p")
    return o.join(p, _equal("o", "p", *key), "left").select("o.*", "p.product_id")


def insert_store_products(gold: Gold, products: DataFrame, store_products: DataFrame) -> DataFrame:
    """Append offers; an existing or earlier (store, product) is kept as it is.

    Products are looked up per variation, before its sellers join. Gold tables in equal
    buckets of their family are joined where they lie.
    """
    known = lookup_product(gold.variations, products).where("product_id is not null")
    key = ["store_id", "product_id"]
    offers = batch_offers(gold._replace(variations=known), "product_id").join(store_products, key, "left_anti")
    first = F.min_by(F.struct(*OFFER), F.struct(*ORDER)).alias("_first")
    with joins_by_buckets(offers.sparkSession):
        numbered = assign_group_ids(offers, store_products, "store_product_id", key, first)
    return _with_offers(store_products, numbered.select("store_product_id", *key, "_first.*"))


def _append_offers(store_products: DataFrame, new: DataFrame) -> DataFrame:
    return _with_offers(store_products, assign_ids(new, store_products, "store_product_id", ["store_id", "product_id"]))


def _with_offers(store_products: DataFrame, numbered: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in store_products.schema}
    return store_products.unionByName(numbered.select(*[F.col(c).cast(kinds[c]) for c in store_products.columns]))


def unmatched_audit(gold: Gold, families: DataFrame, products: DataFrame) -> DataFrame:
    """Variations without a family and offers without a product, with the reason."""
    no_family = lookup_family(gold.variations, gold.families, families).where("family_id is null")
    no_product = lookup_product(batch_offers(gold), products).where("product_id is null")
    columns = [*VARIATION, "name"]
    return no_family.select(*columns, F.lit("no family").alias("reason")).unionByName(
        no_product.select(*columns, F.lit("no product").alias("reason"))
    )


def seed_catalogue(gold: Gold, old: Catalogue, store_id: int | None = None, mirror: bool = False) -> Catalogue:
    """First load: brands, families, products and offers, of one store if given.

    Each gold table is read where it is needed and not written again, so it should be stored or cheap to derive.
    """
    if store_id is not None:
        gold = Gold(*[part.where(F.col("store_id") == store_id) for part in gold])
    brands = cut_lineage(insert_brands(gold.families, old.brands))
    families = cut_lineage(insert_families(gold.families, brands, old.families, mirror))
    products = cut_lineage(insert_products(gold, families, old.products))
    return Catalogue(brands, families, products, insert_store_products(gold, products, old.store_products))


# --- merging -----------------------------------------------------------------


def update_existing(offers: DataFrame, store_products: DataFrame) -> DataFrame:
    """Overwrite six columns of listings matched by (store_id, ref_id); last row wins."""
    last = offers.groupBy("store_id", "ref_id").agg(F.max_by(F.struct(*UPDATED), F.struct(*ORDER)).alias("u"))
    joined = store_products.join(last, ["store_id", "ref_id"], "left")
    kinds = {f.name: f.dataType for f in store_products.schema}
    return joined.select(
        *[
            (F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).cast(kinds[c]).alias(c))
            if c in UPDATED
            else F.col(c)
            for c in store_products.columns
        ]
    )


def skip_matched_families(families: DataFrame, matched: DataFrame) -> DataFrame:
    """Families none of whose sellers is listed already."""
    return families.join(matched.select(*FAMILY).distinct(), FAMILY, "left_anti")


def insert_variations(variations: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products with the new ones, family_id x weight x measure -> product_id).

    ``variations`` has family_id and product_id (null where it is new). One
    product is made per new (family, weight, measure), named by its first row.
    """
    key = ["family_id", "weight", "measure"]
    first = F.min_by("name", F.struct(*VARIATION)).alias("name")
    new = variations.where("product_id is null").groupBy(*key).agg(first)
    kinds = {f.name: f.dataType for f in products.schema}
    made = cut_lineage(assign_ids(new, products, "product_id", key))
    made = made.select(*[F.col(c).cast(kinds[c]) for c in products.columns])
    found = variations.where("product_id is not null").select(*key, "product_id").distinct()
    return products.unionByName(made), found.unionByName(made.select(*key, "product_id"))


def upsert_store_products(offers: DataFrame, store_products: DataFrame) -> DataFrame:
    """Insert offers; where (store, product) exists only the price is replaced.

    Several offers of one batch for the same pair: the first one's attributes
    with the last one's price. Offers are dealt by that pair as they are: most pairs
    come once, and what aggregations would send is an offer with its order twice.
    """
    needed = dict.fromkeys(["store_id", "product_id", *OFFER, *ORDER])
    batch = offers.select(*needed).repartition("store_id", "product_id").groupBy("store_id", "product_id").agg(
        F.min_by(F.struct(*OFFER), F.struct(*ORDER)).alias("_first"),
        F.max_by(F.struct("price"), F.struct(*ORDER)).alias("last"),
    )
    batch = cut_lineage(
        batch.select("store_id", "product_id", *[f"_first.{c}" for c in OFFER if c != "price"], F.col("last.price").alias("price"))
    )
    kind = store_products.schema["price"].dataType
    prices = batch.select("store_id", "product_id", F.struct(F.col("price").cast(kind).alias("price")).alias("_new"))
    repriced = store_products.join(prices, ["store_id", "product_id"], "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new.price")).otherwise(F.col(c)).alias(c) if c == "price" else F.col(c)
            for c in store_products.columns
        ]
    )
    new = batch.join(store_products, ["store_id", "product_id"], "left_anti")
    return _append_offers(repriced, new)


def match_gold(gold: Gold, old: Catalogue, threshold: float = 50.0, similarity: float = 0.9):
    """(offers of listed rows, families to insert with family_id, ignored families).

    Families are written once with their vectors; from there on they travel without them.
    Sellers and variations are read in place; in equal buckets of their family they are joined where they lie.
    """
    gold = gold._replace(families=cut_lineage(gold.families))
    slugs = gold.families.select(F.col("brand").alias("slug"))
    brand = cut_lineage(match_brand(slugs, old.brands, threshold).select(F.col("slug").alias("brand"), "brand_id"))
    keyed = gold.families.withColumns(vector_key(F.col("embedded_name")))
    branded = cut_lineage(keyed.drop("embedded_name").join(brand, "brand"))
    with joins_by_buckets(branded.sparkSession):
        offers = batch_offers(gold).join(branded.select(*FAMILY), FAMILY, "left_semi")
        listed = cut_lineage(existing_listings(offers, old.store_products))
    open_families = number_families(skip_matched_families(branded, listed))
    near = cut_lineage(match_family(open_families, old.families, similarity, vectors=keyed))
    placed = open_families.join(near.select("gold_id", "family_id"), "gold_id")
    no_brand = gold.families.join(brand, "brand", "left_anti").select(*FAMILY, F.lit("no brand").alias("reason"))
    no_family = open_families.join(near, "gold_id", "left_anti").select(*FAMILY, F.lit("no family").alias("reason"))
    return listed, placed, no_brand.unionByName(no_family)


def merge_listings(gold: Gold, old: Catalogue, threshold: float = 50.0, similarity: float = 0.9) -> Merge:
    """Match a gold batch to the catalogue, update what is listed, add what is new.

    Brands and families are never created here; rows without one are ignored. Variations
    and sellers are read where they are needed and not written again, so they should be
    stored or cheap to derive.
    """
    listed, placed, ignored = match_gold(gold, old, threshold, similarity)
    updated = cut_lineage(update_existing(listed, old.store_products))
    family_ids = cut_lineage(placed.select(*FAMILY, "family_id"))
    with joins_by_buckets(family_ids.sparkSession):
        variations = cut_lineage(match_variation(gold.variations.join(family_ids, FAMILY), old.products))
    products, product_ids = insert_variations(variations, old.products)
    key = ["family_id", "weight", "measure"]
    o, p = batch_offers(gold).join(family_ids, FAMILY).alias("o"), product_ids.alias("p")
    offers = o.join(p, _equal("o", "p", *key)).select("o.*", "p.product_id")
    with joins_by_buckets(family_ids.sparkSession):
        store_products = upsert_store_products(offers, updated)
    ignored = cut_lineage(ignored)
    return Merge(
        Catalogue(old.brands, old.families, products, store_products),
        upsert_metrics(variations, listed, ignored),
        ignored,
    )


def upsert_metrics(variations: DataFrame, listed: DataFrame, ignored: DataFrame) -> DataFrame:
    """One row: variations found, products made, listed sellers, ignored families."""
    made = variations.where("product_id is null").select("family_id", "weight", "measure").distinct()
    tagged = (
        variations.where("product_id is not null").select(F.lit("found").alias("kind"))
        .union(made.select(F.lit("made")))
        .union(listed.select(F.lit("listed")))
        .union(ignored.select(F.lit("ignored")))
    )
    return tagged.agg(
        F.count_if(F.col("kind") == "found").alias("new_store_products"),
        F.count_if(F.col("kind") == "made").alias("new_variations"),
        F.count_if(F.col("kind") == "listed").alias("existent_products"),
        F.count_if(F.col("kind") == "ignored").alias("ignored_products"),
    )


# --- integrity ---------------------------------------------------------------


def delete_cascade(catalogue: Catalogue, families: DataFrame | None = None, products: DataFrame | None = None) -> Catalogue:
    """Remove families (family_id) and products (product_id) with what depends on them."""
    kept_families, kept_products = catalogue.families, catalogue.products
    if families is not None:
        kept_families = kept_families.join(families, "family_id", "left_anti")
        kept_products = kept_products.join(families, "family_id", "left_anti")
    if products is not None:
        kept_products = kept_products.join(products, "product_id", "left_anti")
    gone = catalogue.products.join(kept_products.select("product_id"), "product_id", "left_anti")
    return Catalogue(
        catalogue.brands,
        kept_families,
        kept_products,
        catalogue.store_products.join(gone.select("product_id"), "product_id", "left_anti"),
    )


def unique_audit(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fk_audit(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def length_audit(df: DataFrame, *columns: str, longest: int = 255) -> DataFrame:
    """Rows with a text that is too long, one per text."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns]))
    return df.select("*", texts.alias("t")).where(F.length("t.text") > longest).select(*df.columns, "t.column")


def audit_catalogue(c: Catalogue, stores: DataFrame) -> DataFrame:
    """All key, reference and length rules: one row per broken one (empty is good)."""
    checks = {
        "unique brand slug": unique_audit(c.brands, "slug"),
        "unique store slug": unique_audit(stores, "slug"),
        "unique store product": unique_audit(c.store_products, "store_id", "product_id"),
        "family brand": fk_audit(c.families, c.brands, "brand_id"),
        "product family": fk_audit(c.products, c.families, "family_id"),
        "offer product": fk_audit(c.store_products, c.products, "product_id"),
        "offer store": fk_audit(c.store_products, stores, "store_id"),
        "brand length": length_audit(c.brands, "slug", "name"),
        "store length": length_audit(stores, "slug", "name"),
        "family length": length_audit(c.families, "name"),
        "product length": length_audit(c.products, "name"),
        "offer length": length_audit(c.store_products, "name"),
    }
    out = None
    for rule, broken in checks.items():
        count = broken.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        out = count if out is None else out.unionByName(count)
    return out.where("n > 0").select("rule", "n")
