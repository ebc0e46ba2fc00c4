"""Small shared operators: numbering, first rows, zipped lists, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.operators import catalogue as C
from gondola.operators import lists as L
from gondola.operators import numbering as N
from gondola.operators import silver as S
from gondola.plans.registry import Inputs, query
from gondola.plans.source_queries import _scratch
from gondola.sources import layers as Y


@query(
    "w1_keep_first",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rn FROM lineitem) x
       WHERE rn = 1""",
)
def w1(t: Inputs):
    lines = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return L.keep_first(lines, ["l_partkey"], ["l_extendedprice", "l_orderkey", "l_linenumber"])


@query(
    "w5_assign_ids",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber)
         + (SELECT max(o_orderkey) FROM orders) AS row_number FROM lineitem""",
)
def w5(t: Inputs):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    known = t.orders.select(F.col("o_orderkey").alias("row_number"))
    return N.assign_ids(lines, known, "row_number", ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"])


@query(
    "j15_zip_lists",
    """SELECT o_orderkey, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS word,
         CASE k WHEN 0 THEN o_custkey END AS number FROM orders, range(2) g(k)""",
)
def j15(t: Inputs):
    lists = t.orders.select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("word"), F.array("o_custkey").alias("number"))
    return lists.select("o_orderkey", F.posexplode(L.zip_lists("word", "number")).alias("pos", "z")).select(
        "o_orderkey", "pos", "z.word", "z.number"
    )


@query(
    "s9_with_audit_columns",
    "SELECT o_orderkey, CAST(7 AS INT) AS store_id, TRUE AS stamped FROM orders",
)
def s9(t: Inputs):
    stamped = S.with_audit_columns(t.orders.select("o_orderkey"), 7)
    return stamped.select("o_orderkey", "store_id", F.col("inserted_at").isNotNull().alias("stamped"))


@query(
    "s12_write_catalogue",
    "SELECT store_product_id, store_id, product_id, price FROM old_offers",
    ("old_offers",),
)
def s12(t: Inputs):
    root = _scratch(t)
    snapshot = C.Catalogue(t.brands.withColumn("name", F.col("slug")), t.family_vectors, t.products, t.old_offers)
    Y.write_catalogue(snapshot, root, "v1")
    return Y.read_catalogue(t.spark, root, "v1").store_products.select("store_product_id", "store_id", "product_id", "price")


@query(
    "s12_published_catalogue",
    """SELECT o.store_product_id, o.store_id, o.price, p.name AS product, p.weight, f.name AS family, b.slug
       FROM old_offers o JOIN products p USING (product_id) JOIN families f USING (family_id) JOIN brands b ON b.brand_id = f.brand_id
       WHERE f.name NOT LIKE 'small%'""",
    ("old_offers", "products", "families", "brands"),
)
def s12_published(t: Inputs):
    """All four tables of the version published last, joined; a second version has replaced the first."""
    root = _scratch(t)
    first = C.Catalogue(t.brands.withColumn("name", F.col("slug")), t.family_vectors, t.products, t.old_offers)
    Y.write_catalogue(first, root, "v1")
    small = t.families.where("name like 'small%'").select("family_id")
    Y.write_catalogue(C.delete_cascade(Y.read_catalogue(t.spark, root), small), root, "v2")
    brands, families, products, offers = Y.read_catalogue(t.spark, root)
    named = products.select("product_id", "family_id", F.col("name").alias("product"), "weight")
    return (
        offers.select("store_product_id", "store_id", "product_id", "price")
        .join(named, "product_id")
        .join(families.select("family_id", "brand_id", F.col("name").alias("family")), "family_id")
        .join(brands.select("brand_id", "slug"), "brand_id")
        .select("store_product_id", "store_id", "price", "product", "weight", "family", "slug")
    )
