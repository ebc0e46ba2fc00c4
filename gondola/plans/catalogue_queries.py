"""Matching, catalogue merge and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.operators import catalogue as C
from gondola.operators import match as M
from gondola.operators.gold import FAMILY, Gold
from gondola.plans.registry import Inputs, query
from gondola.plans.text_queries import _words
from gondola.session import cut_lineage, joins_by_buckets

_PROCESSED = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' '))"


def _brand_match(slugs: str, brands: str = "brands") -> str:
    """Every slug against every brand, as the definition reads."""
    return f"""
slugs AS (SELECT DISTINCT slug FROM ({slugs}) q),
words AS (SELECT slug, {_PROCESSED.format('slug')} AS p, {_words(_PROCESSED.format('slug'))} AS w FROM slugs),
brand_words AS (SELECT brand_id, slug, {_PROCESSED.format('slug')} AS p, {_words(_PROCESSED.format('slug'))} AS w FROM {brands}),
scored AS (SELECT s.slug, b.brand_id, CASE WHEN s.slug = b.slug THEN 1000 WHEN s.slug = '' OR b.slug = '' THEN 0 ELSE
   0.6 * (100 - 100.0 * levenshtein(s.p, b.p) / greatest(length(s.p), length(b.p)))
   + 40.0 * len(list_intersect(list_distinct(s.w), list_distinct(b.w))) / len(list_distinct(list_concat(s.w, b.w))) END AS score
  FROM words s, brand_words b),
brand_match AS (SELECT slug, brand_id, least(score, 100) AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY slug ORDER BY round(score, 9) DESC, brand_id) AS rn FROM scored) r
  WHERE rn = 1 AND score >= 50 - 1e-9)"""


@query(
    "j10_match_brand",
    f"+ {_brand_match('SELECT slug FROM noisy_brands')} SELECT slug, brand_id, CAST(round(score, 4) AS DOUBLE) AS score FROM brand_match",
    ("noisy_brands",),
)
def j10(t: Inputs):
    return M.match_brand(t.noisy_brands, t.brands).withColumn("score", F.round("score", 4))


SUPPLIED = """
makers AS (SELECT CAST(c_custkey AS INT) AS brand_id, lower(c_mktsegment) || ' ' || substr(c_name, 16) AS slug FROM customer)"""


@query(
    "j10_match_brand_suppliers",
    f"""+ {SUPPLIED}, {_brand_match("SELECT concat('building ', substr(s_name, 16)) AS slug FROM supplier", "makers")}
        SELECT slug, brand_id, CAST(round(score, 4) AS DOUBLE) AS score FROM brand_match""",
)
def j10_suppliers(t: Inputs):
    t.customer.createOrReplaceTempView("customer")
    makers = t.spark.sql(f"WITH {SUPPLIED} SELECT * FROM makers")
    slugs = t.supplier.select(F.concat(F.lit("building "), F.substr("s_name", F.lit(16))).alias("slug"))
    return M.match_brand(slugs, makers).withColumn("score", F.round("score", 4))


FAMILY_MATCH = r"""
asked AS (SELECT g.store_id, g.brand, g.cluster, m.brand_id, regexp_extract(g.name, '\{*[a-zA-ZÀ-ÿ0-9]+') AS word,
    list_transform(g.embedded_name, lambda x: round(x, 6)) AS e FROM gold_families g JOIN brand_match m ON m.slug = g.brand),
near AS (SELECT a.store_id, a.brand, a.cluster, f.family_id,
    round(list_cosine_similarity(a.e, list_transform(f.embedded_name, lambda x: round(x, 6))), 9) AS similarity
  FROM asked a JOIN family_vectors f ON f.brand_id = a.brand_id AND starts_with(f.name, a.word)),
family_match AS (SELECT store_id, brand, cluster, family_id, similarity FROM (
   SELECT *, row_number() OVER (PARTITION BY store_id, brand, cluster ORDER BY similarity DESC, family_id) AS rn FROM near) r
  WHERE rn = 1 AND similarity >= 0.9)"""
GOLD = ("gold_families", "gold_variations", "gold_sellers", "family_vectors", "old_offers", "brands", "products")
BRANDED = _brand_match("SELECT brand AS slug FROM gold_families")


def _gold(t: Inputs) -> Gold:
    return Gold(t.gold_families, t.gold_variations, t.gold_sellers)


def _held(t: Inputs) -> Inputs:
    """The gold views read from members and family keys that are written once, in buckets of their family."""
    return t.holding(["gold_members", "gold_family_keys"], FAMILY)


def _merged(t: Inputs) -> C.Merge:
    t = _held(t)
    return C.merge_listings(_gold(t), _old(t))


def _old(t: Inputs) -> C.Catalogue:
    brands = t.brands.withColumn("name", F.col("slug"))
    return C.Catalogue(brands, t.family_vectors, t.products, t.old_offers)


def _branded(t: Inputs):
    match = M.match_brand(t.gold_families.select(F.col("brand").alias("slug")), t.brands)
    return M.number_families(t.gold_families.join(match.select(F.col("slug").alias("brand"), "brand_id"), "brand"))


@query(
    "j11_match_family",
    f"+ {BRANDED}, {FAMILY_MATCH} SELECT store_id, brand, cluster, CAST(family_id AS BIGINT) AS family_id, round(similarity, 6) AS similarity FROM family_match",
    GOLD,
)
def j11(t: Inputs):
    branded = cut_lineage(_branded(t))
    found = M.match_family(branded, t.family_vectors)
    return branded.join(found, "gold_id").select(
        "store_id", "brand", "cluster", "family_id", F.round("similarity", 6).alias("similarity")
    )


MERGE = f"""{BRANDED}, {FAMILY_MATCH},
offers AS (SELECT s.*, CAST(s.ref_id AS INT) AS ref, v.name, v.image_url FROM gold_sellers s JOIN gold_variations v
  USING (store_id, brand, cluster, weight, measure) WHERE s.brand IN (SELECT slug FROM brand_match)),
listed AS (SELECT o.* FROM offers o WHERE EXISTS (SELECT 1 FROM old_offers p WHERE p.store_id = o.store_id AND p.ref_id = o.ref)),
taken AS (SELECT DISTINCT store_id, brand, cluster FROM listed),
placed AS (SELECT m.* FROM family_match m ANTI JOIN taken USING (store_id, brand, cluster)),
updates AS (SELECT store_id, ref, last(o ORDER BY brand, cluster, weight, measure, row_id) AS u FROM listed o GROUP BY store_id, ref),
updated AS (SELECT p.store_product_id, p.store_id, p.product_id, p.ref_id,
    CASE WHEN u.ref IS NULL THEN p.name ELSE u.u.name END AS name, CASE WHEN u.ref IS NULL THEN p.price ELSE u.u.price END AS price,
    CASE WHEN u.ref IS NULL THEN p.old_price ELSE u.u.old_price END AS old_price, CASE WHEN u.ref IS NULL THEN p.link ELSE u.u.link END AS link,
    CASE WHEN u.ref IS NULL THEN p.cart_link ELSE u.u.cart_link END AS cart_link,
    CASE WHEN u.ref IS NULL THEN p.image_url ELSE u.u.image_url END AS image_url
  FROM old_offers p LEFT JOIN updates u ON u.store_id = p.store_id AND u.ref = p.ref_id),
latest AS (SELECT family_id, weight, measure, max(product_id) AS product_id FROM products GROUP BY ALL),
placed_variations AS (SELECT v.*, m.family_id, l.product_id FROM gold_variations v JOIN placed m USING (store_id, brand, cluster)
  LEFT JOIN latest l ON l.family_id = m.family_id AND l.weight = v.weight AND l.measure = v.measure),
made AS (SELECT family_id, weight, measure, arg_min(name, (store_id, brand, cluster)) AS name,
    row_number() OVER (ORDER BY family_id, weight, measure) + (SELECT max(product_id) FROM products) AS product_id
  FROM placed_variations WHERE product_id IS NULL GROUP BY family_id, weight, measure),
ids AS (SELECT DISTINCT family_id, weight, measure, product_id FROM placed_variations WHERE product_id IS NOT NULL
  UNION ALL SELECT family_id, weight, measure, product_id FROM made),
batch AS (SELECT o.store_id, i.product_id, first(o ORDER BY o.brand, o.cluster, o.weight, o.measure, o.row_id) AS f,
    last(o.price ORDER BY o.brand, o.cluster, o.weight, o.measure, o.row_id) AS price
  FROM offers o JOIN placed m USING (store_id, brand, cluster) JOIN ids i ON i.family_id = m.family_id AND i.weight = o.weight
    AND i.measure = o.measure GROUP BY o.store_id, i.product_id),
merged AS (SELECT p.store_id, p.product_id, p.ref_id, p.name, coalesce(b.price, p.price) AS price, p.old_price, p.link, p.cart_link, p.image_url
    FROM updated p LEFT JOIN batch b USING (store_id, product_id)
  UNION ALL SELECT b.store_id, b.product_id, b.f.ref, b.f.name, b.price, b.f.old_price, b.f.link, b.f.cart_link, b.f.image_url
    FROM batch b ANTI JOIN updated p USING (store_id, product_id))"""
OFFER_COLUMNS = "store_id, CAST(product_id AS INT) AS product_id, ref_id, name, CAST(price AS DECIMAL(18,2)) AS price, old_price, link, cart_link, image_url"


@query(
    "j13_existing_listings",
    f"+ {MERGE} SELECT store_id, brand, cluster, weight, measure, row_id, ref AS ref_id FROM listed",
    GOLD,
)
def j13(t: Inputs):
    match = M.match_brand(t.gold_families.select(F.col("brand").alias("slug")), t.brands)
    offers = C.batch_offers(_gold(t)).join(match.select(F.col("slug").alias("brand")), "brand", "left_semi")
    listed = M.existing_listings(offers, t.old_offers)
    return listed.select("store_id", "brand", "cluster", "weight", "measure", "row_id", "ref_id")


@query("c6_update_existing", f"+ {MERGE} SELECT store_product_id, {OFFER_COLUMNS} FROM updated", GOLD)
def c6(t: Inputs):
    t = _held(t)
    listed, _, _ = C.match_gold(_gold(t), _old(t))
    return C.update_existing(listed, t.old_offers)


@query(
    "c7_families_to_insert",
    f"+ {MERGE} SELECT store_id, brand, cluster, CAST(family_id AS BIGINT) AS family_id FROM placed",
    GOLD,
)
def c7(t: Inputs):
    t = _held(t)
    return C.match_gold(_gold(t), _old(t))[1].select("store_id", "brand", "cluster", "family_id")


@query(
    "j14_match_variation",
    """+ latest AS (SELECT family_id, weight, measure, max(product_id) AS product_id FROM products GROUP BY ALL)
       SELECT v.store_id, v.brand, v.cluster, v.weight, v.measure, l.product_id FROM gold_variations v
       LEFT JOIN latest l ON l.family_id = v.cluster AND l.weight = v.weight AND l.measure = v.measure""",
    GOLD,
)
def j14(t: Inputs):
    placed = t.gold_variations.withColumn("family_id", F.col("cluster").cast("int"))
    return M.match_variation(placed, t.products).select("store_id", "brand", "cluster", "weight", "measure", "product_id")


@query(
    "c8_insert_variations",
    f"""+ {MERGE} SELECT product_id, family_id, name, weight, measure FROM products
        UNION ALL SELECT CAST(product_id AS INT), CAST(family_id AS INT), name, weight, measure FROM made""",
    GOLD,
)
def c8(t: Inputs):
    return _merged(t).catalogue.products


@query("c10_merge_listings", f"+ {MERGE} SELECT {OFFER_COLUMNS} FROM merged", GOLD)
def c10(t: Inputs):
    return _merged(t).catalogue.store_products.drop("store_product_id")


@query(
    "a16_upsert_metrics",
    f"""+ {MERGE} SELECT (SELECT count(*) FROM placed_variations WHERE product_id IS NOT NULL) AS new_store_products,
          (SELECT count(*) FROM made) AS new_variations, (SELECT count(*) FROM listed) AS existent_products,
          (SELECT count(*) FROM gold_families g ANTI JOIN taken USING (store_id, brand, cluster))
            - (SELECT count(*) FROM placed) AS ignored_products""",
    GOLD,
)
def a16(t: Inputs):
    return _merged(t).metrics


@query(
    "c9_upsert_store_products",
    """+ firsts AS (SELECT store_id, CAST(ref_id AS INT) AS product_id, price FROM gold_sellers)
       SELECT o.store_id, o.product_id, CAST(coalesce(f.price, o.price) AS DECIMAL(18,2)) AS price, o.link FROM old_offers o LEFT JOIN firsts f USING (store_id, product_id)
       UNION ALL SELECT f.store_id, f.product_id, CAST(f.price AS DECIMAL(18,2)), 'new link' FROM firsts f ANTI JOIN old_offers o USING (store_id, product_id)""",
    GOLD,
)
def c9(t: Inputs):
    t = _held(t)
    offers, old = C.batch_offers(_gold(t)).withColumn("product_id", F.col("ref_id")), cut_lineage(t.old_offers)
    with joins_by_buckets(t.spark):
        return C.upsert_store_products(offers, old).select("store_id", "product_id", "price", "link")


@query("a4_distinct_brands", "SELECT DISTINCT brand FROM gold_families", GOLD)
def a4(t: Inputs):
    return C.distinct_brands(t.gold_families)


@query(
    "a5_dedupe_families",
    """SELECT name, store_id, brand, cluster FROM (
         SELECT *, row_number() OVER (PARTITION BY name ORDER BY store_id, brand, cluster) AS rn FROM gold_families) x WHERE rn = 1""",
    GOLD,
)
def a5(t: Inputs):
    return C.dedupe_families(t.gold_families.drop("embedded_name"))


@query(
    "j1_lookup_brand_id",
    "SELECT g.store_id, g.brand, g.cluster, b.brand_id FROM gold_families g LEFT JOIN brands b ON b.slug = g.brand",
    GOLD,
)
def j1(t: Inputs):
    return C.lookup_brand_id(t.gold_families, t.brands).select("store_id", "brand", "cluster", "brand_id")


@query("a23_last_wins_map", "SELECT name, max(family_id) AS family_id FROM family_vectors GROUP BY name", GOLD)
def a23(t: Inputs):
    return C.last_wins_map(t.family_vectors, ["name"], "family_id")


@query(
    "j2_lookup_family",
    """+ by_name AS (SELECT name, max(family_id) AS family_id FROM families GROUP BY name)
       SELECT g.store_id, g.brand, g.cluster, g.weight, g.measure, b.family_id
       FROM gold_variations g JOIN (SELECT DISTINCT store_id, brand, cluster, family_name FROM gold_members) f USING (store_id, brand, cluster)
         LEFT JOIN by_name b ON b.name = f.family_name""",
    ("gold_variations", "gold_members", "families"),
)
def j2(t: Inputs):
    named = t.gold_members.select("store_id", "brand", "cluster", F.col("family_name").alias("name")).distinct()
    found = C.lookup_family(t.gold_variations, named, t.families)
    return found.select("store_id", "brand", "cluster", "weight", "measure", "family_id")


@query(
    "j3_lookup_product",
    """+ last AS (SELECT name, weight, measure, max(product_id) AS product_id FROM products GROUP BY ALL)
       SELECT s.row_id, l.product_id FROM gold_sellers s JOIN gold_variations v USING (store_id, brand, cluster, weight, measure)
       LEFT JOIN last l ON l.name = v.name AND l.weight = v.weight AND l.measure = v.measure""",
    GOLD,
)
def j3(t: Inputs):
    return C.lookup_product(C.batch_offers(_gold(t)), t.products).select("row_id", "product_id")


# Seeding starts from half of the brands and from no family, product or offer.
SEED = f"""
old_brands AS (SELECT min(brand_id) AS brand_id, slug, slug AS name FROM brands JOIN gold_families g ON g.brand = slug GROUP BY slug),
seed_brands AS (SELECT * FROM old_brands UNION ALL
  SELECT row_number() OVER (ORDER BY brand) + (SELECT max(brand_id) FROM old_brands), brand, brand FROM (
    SELECT DISTINCT brand FROM gold_families WHERE brand NOT IN (SELECT slug FROM old_brands)) n),
seed_families AS (SELECT row_number() OVER (ORDER BY d.name) AS family_id, brand_id, d.name FROM (
    SELECT g.name, arg_min(g.brand, (g.store_id, g.brand, g.cluster)) AS brand FROM gold_families g GROUP BY g.name) d
  JOIN seed_brands b ON b.slug = d.brand),
seed_products AS (SELECT row_number() OVER (ORDER BY family_id, name, weight, measure) AS product_id, * FROM (
  SELECT DISTINCT f.family_id, v.name, v.weight, v.measure FROM gold_variations v JOIN gold_families g USING (store_id, brand, cluster)
    JOIN seed_families f ON f.name = g.name) d),
seed_last AS (SELECT name, weight, measure, max(product_id) AS product_id FROM seed_products GROUP BY ALL),
seed_offers AS (SELECT s.store_id, l.product_id, arg_min((s.ref_id, s.price), (v.store_id, v.brand, v.cluster, v.weight, v.measure, s.row_id)) AS o
  FROM gold_sellers s JOIN gold_variations v USING (store_id, brand, cluster, weight, measure)
    JOIN seed_last l ON l.name = v.name AND l.weight = v.weight AND l.measure = v.measure GROUP BY ALL)"""


def _unseeded(t: Inputs) -> C.Catalogue:
    spark = t.spark
    known = t.brands.join(t.gold_families.select(F.col("brand").alias("slug")), "slug", "left_semi")
    old = _old(t)
    return C.Catalogue(
        known.select("brand_id", "slug", F.col("slug").alias("name")),
        *[spark.createDataFrame([], part.schema) for part in old[1:]],
    )


def _seeded(t: Inputs) -> C.Catalogue:
    t = _held(t)
    old = _unseeded(t)
    return C.seed_catalogue(_gold(t), old._replace(brands=cut_lineage(old.brands)))


@query("c1_insert_brands", f"+ {SEED} SELECT CAST(brand_id AS BIGINT) AS brand_id, slug, name FROM seed_brands", GOLD)
def c1(t: Inputs):
    return C.insert_brands(t.gold_families, _unseeded(t).brands)


@query("c2_insert_families", f"+ {SEED} SELECT family_id, CAST(brand_id AS BIGINT) AS brand_id, name FROM seed_families", GOLD)
def c2(t: Inputs):
    return _seeded(t).families.drop("embedded_name")


@query("c3_insert_products", f"+ {SEED} SELECT product_id, family_id, name, weight, measure FROM seed_products", GOLD)
def c3(t: Inputs):
    return _seeded(t).products


@query(
    "c4_insert_store_products",
    f"""+ {SEED} SELECT store_id, CAST(product_id AS INT) AS product_id, CAST(o[1] AS INT) AS ref_id, CAST(o[2] AS DECIMAL(18,2)) AS price FROM seed_offers""",
    GOLD,
)
def c4(t: Inputs):
    return _seeded(t).store_products.select("store_id", "product_id", "ref_id", F.col("price").cast("decimal(18,2)").alias("price"))


@query(
    "c5_seeded_audit",
    "SELECT CAST(NULL AS VARCHAR) AS rule, CAST(0 AS BIGINT) AS n FROM supplier WHERE s_suppkey < 0",
)
def c5(t: Inputs):
    return C.audit_catalogue(_seeded(t), t.stores)


@query(
    "c5_broken_catalogue_audit",
    """+ bad_brands AS (SELECT brand_id, slug FROM brands WHERE slug < 'brand-4'
         UNION ALL SELECT brand_id + 1000, slug FROM brands WHERE slug < 'brand-3'),
       bad_families AS (SELECT family_id, brand_id, CASE WHEN name < 'm' THEN repeat(name, 99) ELSE name END AS name
         FROM families WHERE name NOT LIKE 'small%'),
       bad_products AS (SELECT * FROM products WHERE measure <> 'un'),
       bad_offers AS (SELECT store_id, product_id FROM old_offers UNION ALL SELECT store_id, product_id FROM old_offers WHERE price > 20000),
       bad_stores AS (SELECT store_id, CASE WHEN address LIKE 'Rua 1%' THEN 'same' ELSE slug END AS slug,
         CASE WHEN address LIKE 'Rua 1%' THEN repeat(name, 99) ELSE name END AS name FROM stores WHERE address NOT LIKE 'Rua 2%'),
       found AS (
         SELECT 'unique brand slug' AS rule, count(*) AS n FROM (SELECT slug FROM bad_brands GROUP BY slug HAVING count(*) > 1) a
         UNION ALL SELECT 'unique store slug', count(*) FROM (SELECT slug FROM bad_stores GROUP BY slug HAVING count(*) > 1) b
         UNION ALL SELECT 'unique store product', count(*) FROM (SELECT 1 FROM bad_offers GROUP BY store_id, product_id HAVING count(*) > 1) c
         UNION ALL SELECT 'family brand', count(*) FROM bad_families WHERE brand_id NOT IN (SELECT brand_id FROM bad_brands)
         UNION ALL SELECT 'product family', count(*) FROM bad_products WHERE family_id NOT IN (SELECT family_id FROM bad_families)
         UNION ALL SELECT 'offer product', count(*) FROM bad_offers WHERE product_id NOT IN (SELECT product_id FROM bad_products)
         UNION ALL SELECT 'offer store', count(*) FROM bad_offers WHERE store_id NOT IN (SELECT store_id FROM bad_stores)
         UNION ALL SELECT 'family length', count(*) FROM bad_families WHERE length(name) > 255
         UNION ALL SELECT 'store length', count(*) FROM bad_stores WHERE length(name) > 255)
       SELECT * FROM found WHERE n > 0""",
    ("brands", "families", "products", "old_offers", "stores"),
)
def c5_broken(t: Inputs):
    """A catalogue that breaks unique, reference and length rules: each one is counted."""
    brands = t.brands.where("slug < 'brand-4'").union(t.brands.where("slug < 'brand-3'").selectExpr("brand_id + 1000", "slug"))
    families = t.families.where("name not like 'small%'").withColumn("name", F.expr("if(name < 'm', repeat(name, 99), name)"))
    offers = t.old_offers.unionByName(t.old_offers.where("price > 20000"))
    first = F.col("address").like("Rua 1%")
    stores = t.stores.where("address not like 'Rua 2%'").select(
        "store_id",
        F.when(first, "same").otherwise(F.col("slug")).alias("slug"),
        F.when(first, F.repeat("name", F.lit(99))).otherwise(F.col("name")).alias("name"),
    )
    broken = C.Catalogue(brands.withColumn("name", F.col("slug")), families, t.products.where("measure <> 'un'"), offers)
    return C.audit_catalogue(broken, stores)


@query(
    "c16_unmatched_audit",
    """+ by_name AS (SELECT DISTINCT name FROM families), last AS (SELECT DISTINCT name, weight, measure FROM products)
       SELECT store_id, brand, cluster, weight, measure, v.name, 'no family' AS reason FROM gold_variations v
         JOIN gold_families g USING (store_id, brand, cluster) WHERE g.name NOT IN (SELECT name FROM by_name)
       UNION ALL SELECT store_id, brand, cluster, weight, measure, v.name, 'no product' FROM gold_sellers s
         JOIN gold_variations v USING (store_id, brand, cluster, weight, measure)
         WHERE (v.name, v.weight, v.measure) NOT IN (SELECT name, weight, measure FROM last)""",
    GOLD,
)
def c16(t: Inputs):
    return C.unmatched_audit(_gold(t), t.family_vectors, t.products)


GONE = "gone AS (SELECT family_id FROM families WHERE name LIKE 'small%'), gone_products AS (SELECT product_id FROM products WHERE measure = 'un')"


@query(
    "c12_delete_cascade",
    f"""+ {GONE}, lost AS (SELECT product_id FROM products WHERE family_id IN (SELECT family_id FROM gone)
           UNION SELECT product_id FROM gone_products)
        SELECT store_id, product_id FROM old_offers WHERE product_id NOT IN (SELECT product_id FROM lost)""",
    ("families", "products", "old_offers"),
)
def c12(t: Inputs):
    kept = C.delete_cascade(
        _old(t),
        t.families.where("name like 'small%'").select("family_id"),
        t.products.where("measure = 'un'").select("product_id"),
    )
    return kept.store_products.select("store_id", "product_id")


@query("c13_unique_audit", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def c13(t: Inputs):
    return C.unique_audit(t.lineitem, "l_partkey", "l_suppkey")


@query(
    "c14_fk_audit",
    """SELECT product_id, store_id, price FROM store_products WHERE product_id NOT IN (
         SELECT product_id FROM products WHERE measure = 'g')""",
    ("store_products", "products"),
)
def c14(t: Inputs):
    return C.fk_audit(t.store_products, t.products.where("measure = 'g'"), "product_id")


@query(
    "c15_length_audit",
    """SELECT doc_id, 'text' AS "column" FROM documents WHERE length(text) > 255
       UNION ALL SELECT doc_id, 'source' FROM documents WHERE length(source) > 255""",
)
def c15(t: Inputs):
    return C.length_audit(t.documents.select("doc_id", "text", "source"), "text", "source").select("doc_id", "column")
