"""Sources, sinks, category tree and cart event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gondola.operators import silver as S
from gondola.plans.registry import Inputs, query
from gondola.plans.text_queries import LISTINGS, bronze
from gondola.session import shared_dir
from gondola.sources import categories as T
from gondola.sources import layers as L
from gondola.sources.stores import STORES, seed_stores
from gondola.streaming import carts as R


def _scratch(t: Inputs) -> str:
    """A new folder next to the checkpoints, reachable by every executor."""
    return f"{shared_dir(t.spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query(
    "s2_read_layer",
    "SELECT store_id, ref_id, name, brand, price, old_price FROM raw_listings",
    LISTINGS,
)
def s2(t: Inputs):
    root = _scratch(t)
    L.write_layer(t.raw_listings, root, "silver", "listings", partition_by=["store_id"])
    schema = "store_id int, ref_id int, name string, brand string, price decimal(18,2), old_price decimal(18,2)"
    return L.read_layer(t.spark, root, "silver", "listings", schema)


@query(
    "s3_read_whole_layer",
    """SELECT ref_id, name, NULL AS brand, price FROM raw_listings
       UNION ALL SELECT ref_id, name, brand, NULL FROM raw_listings""",
    LISTINGS,
)
def s3(t: Inputs):
    root = _scratch(t)
    L.write_layer(t.raw_listings.select("ref_id", "name", "price"), root, "silver", "a")
    L.write_layer(t.raw_listings.select("ref_id", "name", "brand"), root, "silver", "b")
    return L.read_layer(t.spark, root, "silver")


@query("s8_skip_if_empty", "SELECT ref_id, name, FALSE AS written FROM raw_listings", LISTINGS)
def s8(t: Inputs):
    """A run without rows leaves the table of the last run in place and says so."""
    root = _scratch(t)
    L.write_layer(t.raw_listings.select("ref_id", "name"), root, "silver", "listings")
    written = L.write_layer(t.raw_listings.select("ref_id", "name").where("ref_id < 0"), root, "silver", "listings")
    return L.read_layer(t.spark, root, "silver", "listings").withColumn("written", F.lit(written))


@query(
    "s4_read_listing_pages",
    """SELECT name, brand, CAST(ref_id AS VARCHAR) AS ref_id, CASE WHEN ref_id % 13 = 0 OR ref_id % 17 = 0 THEN NULL
         ELSE CAST(price AS DOUBLE) END AS price
       FROM raw_listings JOIN (SELECT * FROM range(2) r(k)) copies ON copies.k = 0 OR ref_id % 10 = 0""",
    LISTINGS,
)
def s4(t: Inputs):
    path = f"{_scratch(t)}/pages"
    listing = F.struct(*[F.col(c) for c in bronze(t).columns if c != "store_id"])
    page = F.when(F.col("productId").cast("int") % 10 == 0, F.array(listing, listing)).otherwise(F.array(listing))
    bronze(t).select(F.to_json(page).alias("value")).write.text(path, compression="gzip")
    listings, _ = L.read_listing_pages(t.spark, path, STORES[0])
    offer = S.extract_offer(F.col("items"))
    ref = F.col("productId")
    return listings.select(F.col("productName").alias("name"), "brand", ref.alias("ref_id"), offer["price"].alias("price"))


@query(
    "s5_flatten_category_tree",
    """SELECT c_custkey AS id, '/' || CAST(n_regionkey + 1000000000000 AS VARCHAR) || '/' || CAST(n_nationkey + 2000000000000 AS VARCHAR)
         || '/' || CAST(c_custkey AS VARCHAR) || '/' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey
       UNION ALL SELECT n_nationkey + 2000000000000, '/' || CAST(n_regionkey + 1000000000000 AS VARCHAR) || '/'
         || CAST(n_nationkey + 2000000000000 AS VARCHAR) || '/' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
       UNION ALL SELECT r_regionkey + 1000000000000, '/' || CAST(r_regionkey + 1000000000000 AS VARCHAR) || '/'
       FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
)
def s5(t: Inputs):
    return T.flatten_category_tree(t.category_edges)


@query(
    "x1_allowed_categories",
    """SELECT DISTINCT '/' || p_brand || '/' || p_type || '/' AS path FROM part
       EXCEPT SELECT '/' || p_brand || '/' || p_type || '/' FROM part WHERE p_size = 1
       EXCEPT SELECT '/' || p_brand || '/' FROM part""",
)
def x1(t: Inputs):
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/")).alias("path")
    parents = t.part.select(F.concat(F.lit("/"), "p_brand", F.lit("/")).alias("path"))
    return T.allowed_categories(t.part.select(path), t.part.where("p_size = 1").select(path).union(parents))


@query(
    "s6_listing_union",
    "SELECT l_orderkey, CAST(l_partkey AS BIGINT) AS listing FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem",
)
def s6(t: Inputs):
    pages = t.lineitem.select("l_orderkey", F.array("l_partkey", "l_suppkey").alias("listings"))
    return L.listing_union(pages)


@query(
    "x2_union_all",
    """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def x2(t: Inputs):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return L.union_all([customers, suppliers, suppliers])


@query(
    "s10_all_stores",
    """SELECT CAST(store_id % 3 + 1 AS INT) AS store_id, CAST(ref_id AS VARCHAR) AS ref_id, name, brand,
         CASE CAST(store_id % 3 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS weight FROM raw_listings""",
    LISTINGS,
)
def s10(t: Inputs):
    pages = {
        store.slug: bronze(t).where(F.col("store_id") % 3 == i).drop("store_id").withColumn(store.weight_column, F.lit("abc"[i]))
        for i, store in enumerate(STORES)
    }
    return S.all_stores(pages).select("store_id", "ref_id", "name", "brand", "weight")


@query(
    "s13_offers_of_seeded_stores",
    """SELECT o.store_id, o.product_id, o.price, CASE o.store_id WHEN 1 THEN 'angeloni' WHEN 2 THEN 'bistek' ELSE 'giassi' END AS slug
       FROM store_products o WHERE o.store_id IN (1, 2, 3)""",
    ("store_products",),
)
def s13(t: Inputs):
    return t.store_products.join(seed_stores(t.spark).select("store_id", "slug"), "store_id")


@query("s11_read_lookup", "SELECT brand_id, slug FROM brands", ("brands",))
def s11(t: Inputs):
    root = _scratch(t)
    L.write_layer(t.brands.withColumn("name", F.col("slug")), root, "catalogue", "brands")
    return L.read_lookup(t.spark, root, "brands", "brand_id", "slug")


CART_STATE = """
live AS (SELECT * FROM (SELECT *, max(CASE WHEN action = 'clear' THEN seq END) OVER (PARTITION BY cart_id) AS cleared FROM cart_events) a
  WHERE action <> 'clear' AND (cleared IS NULL OR seq > cleared)),
kept AS (SELECT * FROM (SELECT *, max(CASE WHEN action = 'remove' THEN seq END) OVER (PARTITION BY cart_id, item_key) AS removed FROM live) b
  WHERE action <> 'remove' AND (removed IS NULL OR seq > removed)),
present AS (SELECT * FROM (SELECT *, min(CASE WHEN action = 'add' THEN seq END) OVER (PARTITION BY cart_id, item_key) AS first_add FROM kept) c
  WHERE seq >= first_add),
counted AS (SELECT *, max(CASE WHEN action = 'update' THEN seq END) OVER (PARTITION BY cart_id, item_key) AS last_set FROM present),
state AS (SELECT cart_id, item_key, CAST(coalesce(max(CASE WHEN seq = last_set THEN quantity END), 0)
    + count(*) FILTER (action = 'add' AND (last_set IS NULL OR seq > last_set)) AS INT) AS quantity, min(first_add) AS added_seq
  FROM counted GROUP BY cart_id, item_key)"""


@query("r1_cart_state", f"+ {CART_STATE} SELECT * FROM state", ("cart_events",))
def r1(t: Inputs):
    return R.cart_state(t.cart_events)


@query("r2_cart_state_stream", f"+ {CART_STATE} SELECT * FROM state", ("cart_events",))
def r2(t: Inputs):
    """Three runs of events in order, then events of the first run again, which come too late.

    A run lands as many files as it has partitions, and the stream is resumed once per run.
    """
    root = _scratch(t)
    events = t.cart_events.select("seq", "ts", "cart_id", "action", "item_key", "quantity")
    third = events.agg(F.max("seq")).first()[0] // 3 + 1
    last = None
    for run in (0, 1, 2, 0):
        own = events.where(F.floor(F.col("seq") / third) == run)
        own.write.mode("append").parquet(f"{root}/landed")
        landed = t.spark.readStream.schema(R.EVENT_SCHEMA).parquet(f"{root}/landed")
        stream = R.start_cart_state(landed, f"{root}/state", f"{root}/offsets")
        stream.awaitTermination()
        if stream.exception() is not None:
            raise stream.exception()
        last = max([p["batchId"] for p in stream.recentProgress if p["numInputRows"]], default=last)
    return R.read_state(t.spark, f"{root}/state", last)


@query("a21_cart_item_count", f"+ {CART_STATE} SELECT cart_id, CAST(sum(quantity) AS BIGINT) AS n_items FROM state GROUP BY cart_id", ("cart_events",))
def a21(t: Inputs):
    return R.cart_item_count(R.cart_state(t.cart_events))


@query(
    "x3_distinct_cart_stores",
    """SELECT DISTINCT l_orderkey AS cart_id, s AS store FROM (
         SELECT l_orderkey, unnest([l_suppkey, l_partkey % 10]) AS s FROM lineitem) x""",
)
def x3(t: Inputs):
    items = t.lineitem.select(
        F.col("l_orderkey").alias("cart_id"), F.array("l_suppkey", F.col("l_partkey") % 10).alias("stores")
    )
    return R.distinct_cart_stores(items)


@query("p8_non_blank_query", "SELECT doc_id, text FROM documents WHERE trim(text, ' ') <> ''")
def p8(t: Inputs):
    from gondola.operators.search import non_blank_query

    return non_blank_query(t.documents.select("doc_id", "text"))


@query(
    "f25_leaf_path",
    "SELECT n_nationkey, '/' || r_name || '/' || CAST(c_custkey AS VARCHAR) AS path, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def f25(t: Inputs):
    from gondola.functions.text import leaf_path

    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("n_nationkey", "c_custkey", leaf_path(F.concat(F.lit("/"), "r_name"), F.col("c_custkey")).alias("path"))


@query(
    "p7_prefix_filter",
    """SELECT DISTINCT a.p_name AS name, b.p_name AS listing FROM part a JOIN part b
       ON starts_with(a.p_name, regexp_extract(b.p_name, '^[a-z]+')) WHERE a.p_brand = b.p_brand""",
)
def p7(t: Inputs):
    from gondola.operators.match import prefix_pairs

    asked, numbered, intervals = _part_names(t)
    return prefix_pairs(numbered, intervals, ["p_brand"]).join(asked, ["p_brand", "word"]).select("name", "listing").distinct()


def _part_names(t: Inputs):
    """Part names with their first words, the same numbered, and the interval of every word."""
    from gondola.functions.text import get_words
    from gondola.operators.match import number_names, prefix_intervals

    names = t.part.select("p_brand", F.col("p_name").alias("name")).distinct()
    asked = names.select("p_brand", F.col("name").alias("listing"), F.get(get_words(F.col("name")), F.lit(0)).alias("word"))
    numbered = number_names(names, ["p_brand"])
    return asked, numbered, prefix_intervals(numbered, asked, ["p_brand"])


@query(
    "p7_prefix_intervals",
    """WITH names AS (SELECT p_brand, p_name, row_number() OVER (ORDER BY p_brand, p_name) - 1 AS number
         FROM (SELECT DISTINCT p_brand, p_name FROM part) p),
       words AS (SELECT DISTINCT p_brand, regexp_extract(p_name, '^[a-z]+') AS word FROM names)
       SELECT w.p_brand, w.word, min(number) AS first_name, max(number) AS last_name, count(*) AS n_names
       FROM words w JOIN names n ON n.p_brand = w.p_brand AND starts_with(n.p_name, w.word) GROUP BY ALL""",
)
def p7_intervals(t: Inputs):
    _, _, intervals = _part_names(t)
    return intervals.select(
        "p_brand", "word", F.col("first").alias("first_name"), F.col("last").alias("last_name"),
        (F.col("last") - F.col("first") + 1).alias("n_names"),
    )


@query(
    "x4_token_sets",
    r"""SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ' ') AS common,
          array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS every FROM (
          SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a,
            regexp_extract_all(lower(p_type || ' ' || p_name || ' ' || p_brand), '[a-z0-9]+') AS b FROM part) x""",
)
def x4(t: Inputs):
    from gondola.functions.text import get_words

    a, b = get_words(F.lower("p_name")), get_words(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")))
    return t.part.select(
        "p_partkey",
        F.array_join(F.array_sort(F.array_intersect(a, b)), " ").alias("common"),
        F.array_join(F.array_sort(F.array_union(a, b)), " ").alias("every"),
    )
