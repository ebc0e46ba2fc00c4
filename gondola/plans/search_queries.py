"""Documents, search and presentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import present as P
from gondola.operators import checkout as C
from gondola.operators import documents as D
from gondola.operators import lists as L
from gondola.operators import search as Q
from gondola.plans.registry import Inputs, query

CATALOGUE = ("catalogue_offers", "products", "families", "brands", "stores")


def _catalogue(t: Inputs):
    return t.catalogue_offers, t.products, t.families, t.brands, t.stores


@query(
    "j5_catalogue_join",
    """SELECT o.store_product_id, o.store_id, o.product_id, o.price, o.old_price, o.image_url, s.slug AS store_slug,
         p.family_id, p.name, p.weight, p.measure, f.brand_id, f.name AS family_name, b.slug AS brand
       FROM catalogue_offers o JOIN products p ON p.product_id = o.product_id JOIN families f ON f.family_id = p.family_id
         JOIN brands b ON b.brand_id = f.brand_id JOIN stores s ON s.store_id = o.store_id""",
    CATALOGUE,
)
def j5(t: Inputs):
    return D.catalogue_join(*_catalogue(t))


@query(
    "a7_price_range",
    """SELECT product_id, CAST(min(nullif(price, 0)) AS DOUBLE) AS min_price, CAST(max(nullif(price, 0)) AS DOUBLE) AS max_price,
         arg_min(image_url, store_product_id) AS image_url FROM catalogue_offers GROUP BY product_id""",
    CATALOGUE,
)
def a7(t: Inputs):
    return D.price_range(t.catalogue_offers)


@query(
    "a8_store_set",
    "SELECT DISTINCT o.product_id, s.slug FROM catalogue_offers o JOIN stores s ON s.store_id = o.store_id",
    CATALOGUE,
)
def a8(t: Inputs):
    return D.store_set(t.catalogue_offers, t.stores)


DOCUMENTS = """
offered AS (
  SELECT o.product_id, CAST(min(nullif(o.price, 0)) AS DOUBLE) AS min_price, CAST(max(nullif(o.price, 0)) AS DOUBLE) AS max_price,
    arg_min(o.image_url, o.store_product_id) AS image_url, string_agg(DISTINCT s.slug, ',' ORDER BY s.slug) AS stores
  FROM catalogue_offers o JOIN stores s ON s.store_id = o.store_id GROUP BY o.product_id),
flat AS (
  SELECT f.family_id AS id, f.name AS family_name, b.slug AS brand, p.product_id, p.name, nullif(p.weight, 0) AS weight,
    p.measure, o.min_price, o.max_price, o.image_url, o.stores
  FROM offered o JOIN products p ON p.product_id = o.product_id JOIN families f ON f.family_id = p.family_id
    JOIN brands b ON b.brand_id = f.brand_id)"""


@query(
    "a6_build_documents",
    f"""+ {DOCUMENTS} SELECT id, family_name, brand, CAST(row_number() OVER (
          PARTITION BY id ORDER BY coalesce(weight, 0), product_id) - 1 AS INT) AS pos,
          product_id, name, weight, measure, min_price, max_price, image_url, stores FROM flat""",
    CATALOGUE,
)
def a6(t: Inputs):
    docs = D.build_documents(*_catalogue(t))
    return docs.select("id", F.col("name").alias("family_name"), "brand", F.posexplode("variations")).select(
        "id", "family_name", "brand", "pos", "col.product_id", "col.name", "col.weight", "col.measure",
        "col.min_price", "col.max_price", "col.image_url", F.array_join("col.stores", ",").alias("stores"),
    )


@query(
    "p10_document_to_response",
    f"""+ {DOCUMENTS} SELECT id, family_name AS name, brand, product_id AS variation_id, weight, min_price AS "minPrice",
          max_price AS "maxPrice", image_url AS "imageUrl" FROM flat""",
    CATALOGUE,
)
def p10(t: Inputs):
    docs = D.build_documents(*_catalogue(t))
    shaped = docs.select("id", "name", "brand", F.explode(P.document_to_response(F.col("variations"))).alias("v"))
    return shaped.select(
        "id", "name", "brand", F.col("v.id").alias("variation_id"), "v.weight", "v.minPrice", "v.maxPrice", "v.imageUrl"
    )


@query(
    "c11_replace_documents",
    """+ old AS (SELECT CAST(p_partkey AS INT) AS id, p_name AS name FROM part),
         new AS (SELECT CAST(l_partkey AS INT) AS id, 'new' AS name FROM lineitem WHERE l_discount > 0.09 GROUP BY l_partkey)
       SELECT id, name FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, name FROM new""",
)
def c11(t: Inputs):
    old = t.part.select(F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"))
    changed = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").cast("int").alias("id")).distinct()
    return D.replace_documents(old, changed.withColumn("name", F.lit("new")))


@query(
    "s14_bulk_lines",
    f"""+ {DOCUMENTS} SELECT CAST(id AS VARCHAR) AS key, id, family_name, brand, CAST(row_number() OVER (
          PARTITION BY id ORDER BY coalesce(weight, 0), product_id) - 1 AS INT) AS pos,
          product_id, name, weight, measure, min_price, max_price, image_url, stores FROM flat""",
    CATALOGUE,
)
def s14(t: Inputs):
    """The lines read back: each action with the document line that follows it."""
    docs = D.build_documents(*_catalogue(t))
    lines = D.bulk_lines(docs).select("value", F.get_json_object("value", "$.index._id").alias("key"))
    shape = docs.select("id", "name", "brand", "variations").schema
    bodies = lines.where("key is null").select(F.from_json("value", shape).alias("d"))
    read = bodies.select("d.id", F.col("d.name").alias("family_name"), "d.brand", F.posexplode("d.variations").alias("pos", "v"))
    keyed = read.join(lines.where("key is not null").select("key"), F.col("id").cast("string") == F.col("key"))
    return keyed.select(
        "key", "id", "family_name", "brand", "pos", "v.product_id", "v.name", "v.weight", "v.measure",
        "v.min_price", "v.max_price", "v.image_url", F.array_join("v.stores", ",").alias("stores"),
    )


DOCS = "docs AS (SELECT CAST(p_partkey AS INT) AS id, p_name AS name, lower(replace(p_brand, '#', '-')) AS brand FROM part)"
GRAMS = r"""
grams AS (SELECT id, field, unnest(gs) AS term, len(gs) AS dl FROM (
  SELECT id, field, flatten(list_transform(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+'),
    lambda w: list_transform(range(1, least(20, length(w)) + 1), lambda n: substr(w, 1, n)))) AS gs
  FROM (SELECT id, 'name' AS field, name AS txt FROM docs UNION ALL SELECT id, 'brand', brand FROM docs) f) g),
postings AS (SELECT field, term, id AS doc_id, CAST(dl AS INT) AS dl, count(*) AS tf FROM grams GROUP BY ALL),
lens AS (SELECT DISTINCT field, doc_id, dl FROM postings),
stats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avg_dl FROM lens GROUP BY field)"""
ASKED = r"""
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part),
queries AS (SELECT w AS query_id, w AS text FROM words
  UNION ALL SELECT 'pre ' || w, substr(w, 1, 2) FROM words
  UNION ALL SELECT 'brand ' || p_brand, p_brand || ' ring' FROM part GROUP BY p_brand
  UNION ALL SELECT 'name ' || p_name, p_name FROM part GROUP BY p_name
  UNION ALL SELECT 'blank ' || p_brand, ' ' FROM part GROUP BY p_brand)"""
SCORED = r"""
asked AS (SELECT query_id, term, count(*) AS times FROM (
  SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM queries WHERE trim(text) <> '') a GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
scores AS (SELECT a.query_id, p.doc_id, round(sum(a.times * CASE p.field WHEN 'name' THEN 3.0 ELSE 1.0 END
   * ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avg_dl))), 6) AS score
  FROM asked a JOIN postings p ON p.term = a.term JOIN dfs d ON d.field = p.field AND d.term = p.term
    JOIN stats s ON s.field = p.field GROUP BY a.query_id, p.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank,
   count(*) OVER (PARTITION BY query_id) AS total FROM scores)"""


def _docs(t: Inputs):
    return t.part.select(
        F.col("p_partkey").cast("int").alias("id"),
        F.col("p_name").alias("name"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand"),
    )


def _queries(t: Inputs):
    part = t.part
    words = part.select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    brands, names = part.select("p_brand").distinct(), part.select("p_name").distinct()
    rows = [
        words.select(F.col("w").alias("query_id"), F.col("w").alias("text")),
        words.select(F.concat(F.lit("pre "), "w"), F.substr("w", F.lit(1), F.lit(2))),
        brands.select(F.concat(F.lit("brand "), "p_brand"), F.concat("p_brand", F.lit(" ring"))),
        names.select(F.concat(F.lit("name "), "p_name"), "p_name"),
        brands.select(F.concat(F.lit("blank "), "p_brand"), F.lit(" ")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


@query("q1_build_postings", f"+ {DOCS}, {GRAMS} SELECT field, term, doc_id, dl, tf FROM postings")
def q1(t: Inputs):
    return Q.build_postings(_docs(t))


@query("q1_field_stats", f"+ {DOCS}, {GRAMS} SELECT * FROM stats")
def q1_stats(t: Inputs):
    return Q.field_stats(_docs(t))


def _scores(t: Inputs):
    docs = _docs(t)
    return Q.score(_queries(t), Q.build_postings(docs), Q.field_stats(docs))


@query("q2_search_scores", f"+ {DOCS}, {GRAMS}, {ASKED}, {SCORED} SELECT * FROM scores")
def q2(t: Inputs):
    return _scores(t)


@query("a22_total_hits", f"+ {DOCS}, {GRAMS}, {ASKED}, {SCORED} SELECT query_id, count(*) AS total FROM scores GROUP BY query_id")
def a22(t: Inputs):
    return Q.count_hits(_queries(t), Q.build_postings(_docs(t)))


@query(
    "w6_page_of_hits",
    f"+ {DOCS}, {GRAMS}, {ASKED}, {SCORED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank BETWEEN 11 AND 20",
)
def w6(t: Inputs):
    return Q.page_of_hits(_scores(t), page=2)


@query(
    "q4_search_products",
    f"""+ {DOCS}, {GRAMS}, {ASKED}, {SCORED} SELECT r.query_id, r.doc_id, r.score, r.rank, r.total, d.name, d.brand
        FROM ranked r JOIN docs d ON d.id = r.doc_id WHERE r.rank <= 10""",
)
def q4(t: Inputs):
    docs = _docs(t)
    return Q.search_products(_queries(t), docs, Q.build_postings(docs), Q.field_stats(docs))


@query(
    "q1_nested_postings",
    r"""+ g AS (SELECT CAST(family_id AS INT) AS id, product_id AS variation_id, len(gs) AS dl, unnest(gs) AS term FROM (
            SELECT family_id, product_id, flatten(list_transform(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'),
              lambda w: list_transform(range(1, least(20, length(w)) + 1), lambda n: substr(w, 1, n)))) AS gs FROM products
            WHERE product_id IN (SELECT product_id FROM offers_raw)) x)
       SELECT 'variations.name' AS field, term, id, variation_id, count(*) AS tf, CAST(dl AS INT) AS dl FROM g GROUP BY ALL""",
    ("products", "offers_raw"),
)
def q1_nested(t: Inputs):
    return Q.nested_postings(D.document_variations(*_catalogue(t)))


@query(
    "o1_page",
    "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20",
)
def o1(t: Inputs):
    return Q.page(t.part.select("p_partkey", "p_retailprice"), 3, [F.desc("p_retailprice"), F.col("p_partkey")])


@query(
    "f27_format_brl",
    """SELECT o_orderkey, 'R$' || chr(160) || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS total FROM orders""",
)
def f27(t: Inputs):
    return t.orders.select("o_orderkey", P.format_brl(F.col("o_totalprice")).alias("total"))


@query(
    "f28_price_range_label",
    """SELECT product_id, CASE WHEN price = old_price THEN printf('R$%.2f', CAST(price AS DOUBLE))
         ELSE printf('R$%.2f - R$%.2f', CAST(price AS DOUBLE), CAST(old_price AS DOUBLE)) END AS label, store_id FROM offers_raw""",
    ("offers_raw",),
)
def f28(t: Inputs):
    return t.offers_raw.select("product_id", "store_id", P.price_range_label(F.col("price"), F.col("old_price")).alias("label"))


@query(
    "f29_labels",
    """SELECT d.store_id, printf('%.2f km', CAST(distance_km AS DOUBLE)) AS km, CAST(duration_min AS VARCHAR) || ' min' AS minutes,
         upper(s.name[1]) AS initial, CAST(p.weight AS VARCHAR) || ' ' || p.measure AS size, p.product_id
       FROM distances d JOIN stores s ON s.store_id = d.store_id JOIN offers_raw o ON o.store_id = d.store_id
         JOIN products p ON p.product_id = o.product_id""",
    ("distances", "stores", "offers_raw", "products"),
)
def f29(t: Inputs):
    rows = t.distances.join(t.stores, "store_id").join(t.offers_raw, "store_id").join(t.products.drop("name"), "product_id")
    return rows.select(
        "store_id", "product_id",
        P.distance_label(F.col("distance_km")).alias("km"),
        P.duration_label(F.col("duration_min")).alias("minutes"),
        P.store_initial(F.col("name")).alias("initial"),
        P.size_label(F.col("weight"), F.col("measure")).alias("size"),
    )


@query(
    "f31_merge_cart_links",
    r"""+ links AS (SELECT page_id, regexp_extract(url, '^\w+://([^/]+)', 1) AS host, url FROM pages),
         q AS (SELECT *, regexp_extract(url, '\?([^#]*)', 1) AS query FROM links)
       SELECT host, regexp_extract(arg_min(url, page_id), '^[^?#]+') || '?' ||
         coalesce(string_agg(nullif(query, ''), '&' ORDER BY page_id), '') AS link FROM q GROUP BY host""",
)
def f31(t: Inputs):
    links = t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), "url")
    lists = L.nest(links, ["host"], F.struct("page_id", "url"), "links")
    return lists.select("host", P.merge_cart_links(F.transform("links", lambda x: x["url"])).alias("link"))


@query(
    "p13_format_cart_result",
    """SELECT cart_id, store_id, 'R$' || chr(160) || translate(format('{:,.2f}', CAST(sum(total_price) AS DOUBLE)), ',.', '.,') AS total,
         string_agg('R$' || chr(160) || translate(format('{:,.2f}', CAST(price AS DOUBLE)), ',.', '.,'), ' ' ORDER BY product_id) AS prices
       FROM (SELECT c.*, s.store_id, s.price, c.quantity * s.price AS total_price FROM carts c JOIN (
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS rn FROM store_products) y
           WHERE rn = 1) s ON s.product_id = c.product_id) x
       GROUP BY cart_id, store_id""",
    ("carts", "store_products"),
)
def p13(t: Inputs):
    nested = P.format_cart_result(C.nest_offers(C.cheapest_items(t.carts, t.store_products), t.stores))
    return nested.select(
        "cart_id", "store_id", F.col("formatted_total_cost").alias("total"),
        F.array_join(F.transform("items", lambda i: i["formatted_price"]), " ").alias("prices"),
    )
