"""Retail views over the driver tables, one SQL text each.

The same text feeds Spark (as a DataFrame) and the comparison SQL (as a CTE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
# Parts of views that Spark reads by name, so that they can be written once and shared.
PARTS: dict[str, str] = {}
USES: dict[str, tuple[str, ...]] = {}


def _view(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    VIEWS[name] = sql.strip()
    USES[name] = uses


_view(
    "stores",
    """
SELECT CAST(s_suppkey AS INT) AS store_id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name,
       concat('Rua ', CAST(s_nationkey AS VARCHAR(10)), ', ', CAST(s_suppkey AS VARCHAR(10))) AS address
FROM supplier""",
)
_view(
    "brands",
    """
SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) + 1 AS brand_id, lower(replace(p_brand, '#', '-')) AS slug
FROM part""",
)
_view(
    "offers_raw",
    """
SELECT CAST(l_suppkey AS INT) AS store_id, CAST(l_partkey AS INT) AS product_id,
       CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS price,
       CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS old_price
FROM lineitem GROUP BY l_suppkey, l_partkey""",
)
_view(
    "store_products",
    """
SELECT CAST(l_suppkey AS INT) AS store_id, CAST(l_partkey AS INT) AS product_id,
       CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS price
FROM lineitem GROUP BY l_suppkey, l_partkey""",
)
_view(
    "carts",
    """
SELECT l_orderkey AS cart_id, CAST(l_partkey AS INT) AS product_id,
       CAST(sum(l_quantity) AS INT) AS quantity
FROM lineitem GROUP BY l_orderkey, l_partkey""",
)
_view(
    "cart_lines",
    """
SELECT l_orderkey AS cart_id, CAST(l_partkey AS INT) AS product_id, CAST(l_quantity AS INT) AS quantity,
       CAST(l_linenumber AS BIGINT) * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS pos
FROM lineitem""",
)
_view(
    "routes",
    """
SELECT CAST(s_suppkey AS INT) AS store_id,
       concat('{"routes":[{"legs":[{"distanceMeters":', CAST((s_suppkey * 7919) % 50000 AS VARCHAR(10)),
              ',"duration":"', CAST((s_suppkey * 31) % 5400 AS VARCHAR(10)), 's"},',
              '{"distanceMeters":1,"duration":"1s"}]}]}') AS payload
FROM supplier""",
)
_view(
    "distances",
    """
SELECT CAST(s_suppkey AS INT) AS store_id,
       CAST(round(CAST((s_suppkey * 7919) % 50000 AS DECIMAL(18,3)) * 0.001, 2) AS DECIMAL(10,2)) AS distance_km,
       {half_even} AS duration_min
FROM supplier WHERE s_acctbal > 0""",
)
_view(
    "raw_listings",
    """
SELECT o.store_id, o.product_id AS ref_id,
       concat(p.p_name, ' ', CASE CAST(o.product_id % 10 AS INT)
         WHEN 0 THEN concat(CAST(p.p_size AS VARCHAR(10)), 'kg')
         WHEN 1 THEN concat(CAST(p.p_size AS VARCHAR(10)), ' g')
         WHEN 2 THEN concat(CAST(p.p_size AS VARCHAR(10)), 'ml lata')
         WHEN 3 THEN concat('1,', CAST(p.p_size % 10 AS VARCHAR(10)), 'L')
         WHEN 4 THEN concat('c/', CAST(p.p_size AS VARCHAR(10)), ' unidades')
         WHEN 5 THEN concat(CAST(p.p_size AS VARCHAR(10)), ' un')
         WHEN 6 THEN concat('p/ cozinha ', CAST(p.p_size AS VARCHAR(10)), 'lt')
         WHEN 7 THEN 'refrig. z.'
         WHEN 8 THEN concat('kit ', CAST(p.p_size AS VARCHAR(10)), ' garrafas')
         ELSE 'Presunto' END) AS name,
       lower(replace(p.p_brand, '#', '-')) AS brand, o.price, o.old_price
FROM offers_raw o JOIN part p ON p.p_partkey = o.product_id""",
    uses=("offers_raw",),
)
_view(
    "noisy_brands",
    """
SELECT brand_id AS listing_brand_id,
       CASE brand_id % 5 WHEN 0 THEN slug WHEN 1 THEN concat(slug, '-sa')
         WHEN 2 THEN replace(slug, 'brand', 'brnd')
         WHEN 3 THEN concat('zq', substr(slug, 6)) ELSE '' END AS slug
FROM brands""",
    uses=("brands",),
)
# Region -> nation -> customer, ids of the three levels kept apart.
_view(
    "category_edges",
    """
SELECT CAST(r_regionkey + 1000000000000 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id FROM region
UNION ALL
SELECT CAST(n_nationkey + 2000000000000 AS BIGINT), CAST(n_regionkey + 1000000000000 AS BIGINT) FROM nation
UNION ALL
SELECT CAST(c_custkey AS BIGINT), CAST(c_nationkey + 2000000000000 AS BIGINT) FROM customer""",
)
_view(
    "cart_events",
    """
SELECT event_id AS seq, ts, user_id AS cart_id,
       CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add'
         WHEN 'signup' THEN 'update' WHEN 'error' THEN 'remove' ELSE 'clear' END AS action,
       CAST(event_id % 5 AS VARCHAR(10)) AS item_key,
       CAST(event_id % 10 + 1 AS INT) AS quantity
FROM events""",
)
# A relational catalogue: a family is a (brand, name), a product is a part.
_view(
    "families",
    """
SELECT CAST(min(p_partkey) + 1 AS INT) AS family_id, CAST(substr(p_brand, 7) AS INT) + 1 AS brand_id, p_name AS name
FROM part GROUP BY p_brand, p_name""",
)
_view(
    "products",
    """
SELECT CAST(p.p_partkey AS INT) AS product_id, f.family_id,
       concat(p.p_name, ' ', lower(p.p_type)) AS name,
       CAST(CASE WHEN p.p_size % 7 = 0 THEN 0 ELSE p.p_size * 10 END AS INT) AS weight,
       CASE CAST(p.p_partkey % 3 AS INT) WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'un' END AS measure
FROM part p JOIN families f ON f.brand_id = CAST(substr(p.p_brand, 7) AS INT) + 1 AND f.name = p.p_name""",
    uses=("families",),
)
_view(
    "catalogue_offers",
    """
SELECT CAST(product_id AS BIGINT) * 10000000 + store_id AS store_product_id, store_id, product_id,
       concat('listing ', CAST(product_id AS VARCHAR(10))) AS name,
       CAST(CASE WHEN (product_id + store_id) % 11 = 0 THEN 0 ELSE price END AS DECIMAL(18,2)) AS price,
       old_price, concat('http://img/', CAST(product_id AS VARCHAR(10)), '/', CAST(store_id AS VARCHAR(10))) AS image_url
FROM offers_raw""",
    uses=("offers_raw",),
)
# Catalogue before a merge: the offers seen up to a date, families with vectors.
_view(
    "old_offers",
    """
SELECT CAST(l_partkey AS BIGINT) * 10000000 + l_suppkey AS store_product_id, CAST(l_suppkey AS INT) AS store_id,
       CAST(l_partkey AS INT) AS product_id, CAST(l_partkey AS INT) AS ref_id, concat('old ', CAST(l_partkey AS VARCHAR(12))) AS name,
       CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS price, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS old_price,
       'old link' AS link, 'old cart' AS cart_link, 'old image' AS image_url
FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_partkey, l_suppkey""",
)
_view(
    "family_vectors",
    """
SELECT f.family_id, f.brand_id, f.name, {doubles} AS embedded_name
FROM families f CROSS JOIN (SELECT count(*) AS vectors FROM embeddings) n
  JOIN embeddings e ON e.vec_id = f.family_id % n.vectors""",
    uses=("families",),
)
_view(
    "gold_members",
    """
SELECT o.store_id, CASE f.brand_id % 5 WHEN 0 THEN concat('brand-', CAST(f.brand_id - 1 AS VARCHAR(12)))
         WHEN 1 THEN concat('brand-', CAST(f.brand_id - 1 AS VARCHAR(12)), '-sa')
         WHEN 2 THEN concat('brnd-', CAST(f.brand_id - 1 AS VARCHAR(12)))
         WHEN 3 THEN concat('brand ', CAST(f.brand_id - 1 AS VARCHAR(12)))
         ELSE concat('zq-', CAST(f.brand_id - 1 AS VARCHAR(12))) END AS brand,
       CAST(f.family_id AS BIGINT) AS cluster, f.family_id, f.brand_id, f.name AS family_name,
       CASE WHEN o.product_id % 4 = 0 THEN p.weight + 1 ELSE p.weight END AS weight, p.measure,
       CAST(o.store_id AS BIGINT) * 1000000000 + o.product_id AS row_id, p.name, o.product_id, o.price, o.old_price
FROM offers_raw o JOIN products p ON p.product_id = o.product_id JOIN families f ON f.family_id = p.family_id""",
    uses=("offers_raw", "families", "products"),
)
_view(
    "gold_families",
    """
SELECT g.store_id, g.brand, g.cluster,
       CASE WHEN g.family_id % 6 = 5 THEN concat('zzz ', g.family_name) ELSE concat(g.family_name, ' extra') END AS name,
       {perturbed} AS embedded_name
FROM {family_keys} g
  CROSS JOIN (SELECT count(*) AS vectors FROM embeddings) n
  JOIN embeddings e ON e.vec_id = (CASE WHEN g.family_id % 7 = 0 THEN g.family_id + 1 ELSE g.family_id END) % n.vectors""",
    uses=("gold_members",),
)
_view(
    "gold_variations",
    """
SELECT store_id, brand, cluster, weight, measure, min(name) AS name, concat('img ', min(name)) AS image_url
FROM gold_members GROUP BY store_id, brand, cluster, weight, measure""",
    uses=("gold_members",),
)
_view(
    "gold_sellers",
    """
SELECT store_id, brand, cluster, weight, measure, row_id, price + 1 AS price, old_price, 'new link' AS link,
       'new cart' AS cart_link, CAST(product_id AS VARCHAR(12)) AS ref_id
FROM gold_members""",
    uses=("gold_members",),
)

PARTS["gold_family_keys"] = "SELECT DISTINCT store_id, brand, cluster, family_id, family_name FROM gold_members"

# Fragments that the two engines spell differently.
_SPELLING = {
    "family_keys": ("gold_family_keys", f"({PARTS['gold_family_keys']})"),
    "half_even": (
        "CAST(bround(CAST((s_suppkey * 31) % 5400 AS DOUBLE) / 60) AS INT)",
        "CAST(round_even(CAST((s_suppkey * 31) % 5400 AS DOUBLE) / 60, 0) AS INT)",
    ),
    "doubles": ("CAST(e.embedding AS ARRAY<DOUBLE>)", "CAST(e.embedding AS DOUBLE[])"),
    "perturbed": (
        "transform(e.embedding, (x, i) -> CAST(x AS DOUBLE) + (i % 5 - 2) * 0.02D)",
        "list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE) + ((i - 1) % 5 - 2) * CAST(0.02 AS DOUBLE))",
    ),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in (*_ordered(USES.get(name, ())), name):
            if needed not in out:
                out.append(needed)
    return out


def view_sql(name: str, engine: str) -> str:
    text = VIEWS[name]
    for mark, (spark, duckdb) in _SPELLING.items():
        text = text.replace("{" + mark + "}", spark if engine == "spark" else duckdb)
    return text


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix comparison SQL with the views it needs."""
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in _ordered(names))
    body = sql.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if not ctes:
        return body if not body.startswith("+") else f"{word} {body[1:].strip()}"
    # A body that starts with "+" continues the WITH list.
    if body.startswith("+"):
        return f"{word} {ctes},\n{body[1:].strip()}"
    return f"{word} {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view (or plain table) as a DataFrame; views and parts that are ``held`` are read from there."""
    held = held or {}
    if name in held:
        return held[name]
    if name not in VIEWS and name not in PARTS:
        return table(spark, sf_dir, name)
    text = view_sql(name, "spark") if name in VIEWS else PARTS[name]
    parts = [p for p in PARTS if f"FROM {p}" in text]
    needs = () if parts and all(p in held for p in parts) else ("gold_members",) if name in PARTS else USES[name]
    for needed in (*_ordered(needs), *parts):
        view(spark, sf_dir, needed, held).createOrReplaceTempView(needed)
    for source in TABLES:
        if f"FROM {source}" in text or f"JOIN {source}" in text:
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(text)
