"""Edge rows of checkout, search, sources and presentation."""

import json

import pytest
from pyspark.sql import functions as F

from gondola.functions import present as P
from gondola.functions import routes as T
from gondola.operators import checkout as C
from gondola.operators import documents as D
from gondola.operators import search as Q
from gondola.operators.lists import nest
from gondola.operators.silver import build_silver, drop_unpriced
from gondola.sources import layers as L
from gondola.sources.categories import allowed_categories, flatten_category_tree
from gondola.sources.stores import STORES, seed_stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_durations_and_modes(spark):
    for text, want in {"30s": 0, "90s": 2, "150s": 2, "1.5s": None, "s": None, "90": None, " 60s": 1, "-90s": -2}.items():
        assert one(spark, T.parse_duration_min(F.lit(text))) == want, text
    assert [one(spark, T.travel_mode_code(F.lit(m))) for m in ("car", "Walking", "boat")] == ["DRIVE", "WALK", ""]


def test_routes_use_the_first_leg_and_set_bad_ones_aside(spark):
    good = {"routes": [{"legs": [{"distanceMeters": 1234.5, "duration": "90s"}, {"distanceMeters": 9, "duration": "1s"}]}]}
    rows = [(1, json.dumps(good)), (2, '{"routes":[]}'), (3, "no json"), (4, json.dumps({"routes": [{"legs": [{"distanceMeters": 1, "duration": "1m"}]}]}))]
    ok, bad = C.distances_from_routes(spark.createDataFrame(rows, "store_id int, payload string"))
    assert [(r.store_id, float(r.distance_km), r.duration_min) for r in ok.collect()] == [(1, 1.23, 2)]
    assert sorted(r.store_id for r in bad.collect()) == [2, 3, 4]


def test_checkout_small(spark):
    carts = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 10, 1), (3, 99, 1)], "cart_id long, product_id int, quantity int")
    sp = spark.createDataFrame(
        [(1, 10, "5.00"), (1, 11, "5.00"), (2, 10, "4.00"), (3, 10, "4.00"), (3, 11, "7.00")], "store_id int, product_id int, p string"
    ).select("store_id", "product_id", F.col("p").cast("decimal(18,2)").alias("price"))
    near = spark.createDataFrame([(1, 2.0, 5), (3, 1.0, 9)], "store_id int, distance_km double, duration_min int")
    single = {r.cart_id: (r.store_id, float(r.total_cost)) for r in C.cheapest_single_store(carts, sp).collect()}
    # Cart 1: stores 1 and 3 tie at 15, the lower id wins; store 2 lacks a product; cart 3 has no store.
    assert single == {1: (1, 15.0), 2: (2, 4.0)}
    far = {r.cart_id: r.store_id for r in C.cheapest_single_store_with_distance(carts, sp, near).collect()}
    assert far == {1: 3, 2: 3}
    split = {(r.cart_id, r.store_id): float(r.total_cost) for r in C.cheapest_per_item(carts, sp).collect()}
    assert split == {(1, 2): 8.0, (1, 1): 5.0, (2, 2): 4.0}
    with pytest.raises(Exception, match="store without a distance"):
        C.attach_distance(C.cheapest_per_item(carts, sp), near, strict=True).collect()
    total = {r.cart_id: r.t for r in C.cheapest_per_item(carts, sp).groupBy("cart_id").agg(F.sum("total_cost").alias("t")).collect()}
    assert all(float(total[c]) <= t for c, (_, t) in single.items())


def test_search_prefixes(spark):
    docs = spark.createDataFrame([(1, "Leite Integral", "acme"), (2, "Cafe", "leite"), (3, "Acucar", None)], "id int, name string, brand string")
    asked = spark.createDataFrame([("a", "lei"), ("b", "leites"), ("c", "  "), ("d", "açúcar"), ("e", "LEITE leite")], "query_id string, text string")
    scores = Q.score(asked, Q.build_postings(docs), Q.field_stats(docs))
    got = {}
    for r in scores.collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert set(got) == {"a", "e"} and set(got["a"]) == {1, 2}
    assert got["a"][1] > got["a"][2]
    assert got["e"][1] > 1.9 * Q_single(spark, docs)
    folded = Q.score(asked.where("query_id = 'd'"), Q.build_postings(docs), Q.field_stats(docs), fold=True)
    assert [r.doc_id for r in folded.collect()] == [3]


def Q_single(spark, docs):
    asked = spark.createDataFrame([("x", "leite")], "query_id string, text string")
    rows = Q.score(asked, Q.build_postings(docs), Q.field_stats(docs)).where("doc_id = 1").collect()
    return rows[0].score


def test_documents_and_bulk(spark):
    sp = spark.createDataFrame(
        [(1, 1, 5, 0.0, "i1"), (2, 2, 5, 3.0, "i2"), (3, 1, 6, None, "i3"), (4, 9, 6, 1.0, "i4")],
        "store_product_id long, store_id int, product_id int, price double, image_url string",
    )
    products = spark.createDataFrame([(5, 1, "B", 7, "g"), (6, 1, "A", 0, "")], "product_id int, family_id int, name string, weight int, measure string")
    families = spark.createDataFrame([(1, 1, "Fam")], "family_id int, brand_id int, name string")
    brands = spark.createDataFrame([(1, "acme")], "brand_id int, slug string")
    stores = spark.createDataFrame([(1, "s1"), (2, "s2")], "store_id int, slug string")
    docs = D.build_documents(sp, products, families, brands, stores)
    (doc,) = docs.collect()
    got = [(v.product_id, v.weight, v.min_price, v.max_price, v.image_url, v.stores) for v in doc.variations]
    assert got == [(6, None, None, None, "i3", ["s1"]), (5, 7, 3.0, 3.0, "i1", ["s1", "s2"])]
    action, body = [json.loads(r.value) for r in D.bulk_lines(docs).collect()]
    assert action == {"index": {"_id": "1"}} and body["variations"][0]["weight"] is None


def test_large_family_is_one_document(spark):
    n = 1500
    sp = spark.range(n).selectExpr("id AS store_product_id", "1 AS store_id", "cast(id AS int) AS product_id", "1.0D AS price", "'i' AS image_url")
    products = spark.range(n).selectExpr("cast(id AS int) AS product_id", "1 AS family_id", "concat('p', id) AS name", "cast(id AS int) AS weight", "'g' AS measure")
    families = spark.createDataFrame([(1, 1, "Fam")], "family_id int, brand_id int, name string")
    brands = spark.createDataFrame([(1, "acme")], "brand_id int, slug string")
    stores = spark.createDataFrame([(1, "s1")], "store_id int, slug string")
    (doc,) = D.build_documents(sp, products, families, brands, stores).collect()
    assert [v.product_id for v in doc.variations] == list(range(n))
    headers = D.document_headers(D.document_variations(sp, products, families, brands, stores))
    assert headers.collect() == [(1, "Fam", "acme")]
    links = spark.range(n).select(F.lit("h").alias("host"), "id", F.concat(F.lit("https://h/x?k="), "id").alias("url"))
    (host,) = nest(links, ["host"], F.struct("id", "url"), "links").collect()
    assert [x.id for x in host.links] == list(range(n))


def test_category_cycle_ends(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3), (4, 3)], "id int, parent_id int")
    got = {r.id for r in flatten_category_tree(edges).collect()}
    assert got == {4}


def test_links_and_labels(spark):
    links = F.array(F.lit("https://shop/cart/add?sku=1&qty=2"), F.lit("https://other/x?sku=2&n=a%20b&empty"), F.lit("https://other/y"))
    assert one(spark, P.merge_cart_links(links)) == "https://shop/cart/add?sku=1&qty=2&sku=2&n=a+b&empty="
    assert one(spark, P.merge_cart_links(F.array().cast("array<string>"))) == "#"
    assert one(spark, P.format_brl(F.lit(1234.5))) == "R$ 1.234,50"
    assert one(spark, P.format_brl(F.lit(-1.0))) == "-R$ 1,00"
    assert one(spark, P.price_range_label(F.lit(1.0), F.lit(1.0))) == "R$1.00"
    assert one(spark, P.price_range_label(F.lit(1.0), F.lit(2.5))) == "R$1.00 - R$2.50"


def test_unpriced_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 0.0), (0.0, None), (0.0, 5.0)], "price double, old_price double")
    assert sorted(map(repr, drop_unpriced(df).collect())) == sorted(map(repr, df.collect()[1:]))


def test_silver_from_landed_pages(spark, tmp_path):
    store = STORES[2]
    listing = {
        "productName": "Molho ORIGINAL Giassi 2 L", "productId": "7", "brand": "Giassi", "link": "l", "multiplicador": ["0,5"], "unidade": ["KG"],
        "items": [{"sellers": [{"addToCartLink": "c", "commertialOffer": {"Price": 2.0, "ListPrice": 3.0}}], "images": [{"imageUrl": "i"}]}],
    }
    bare = {"productName": "Sal", "productId": "8", "brand": None, "items": []}
    path = tmp_path / "pages.json"
    path.write_text("\n".join([json.dumps([listing, bare]), "[]", json.dumps([listing]), "{broken"]))
    pages, bad = L.read_listing_pages(spark, str(path), store)
    assert pages.count() == 3 and [r.value for r in bad.collect()] == ["{broken"]
    distinct, _ = L.read_listing_pages(spark, str(path), store, distinct=True)
    renamed = distinct.withColumnsRenamed(store.columns).withColumn("store_id", F.lit(3))
    silver, rejected = build_silver(renamed, seed_stores(spark))
    (row,) = silver.collect()
    assert (row.name, row.brand, row.measure, row.weight, row.price, row.image_url) == ("Molho", "", "g", 500, 2.0, "i")
    assert [r.ref_id for r in rejected.collect()] == ["8"]


def test_layers(spark, tmp_path):
    root = str(tmp_path)
    assert L.write_layer(spark.range(3), root, "silver", "a")
    assert not L.write_layer(spark.range(0), root, "silver", "a")
    assert L.read_layer(spark, root, "silver", "a").count() == 3
    L.write_layer(spark.range(2).withColumn("x", F.lit(1)), root, "silver", "b")
    whole = L.read_layer(spark, root, "silver")
    assert whole.columns == ["id", "x"] and whole.count() == 5


def test_category_tree(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, None)], "id int, parent_id int")
    paths = flatten_category_tree(edges)
    assert sorted(r.path for r in paths.collect()) == ["/1/2/3/", "/1/2/4/", "/5/"]
    excluded = spark.createDataFrame([("/1/",), ("/5/",)], "path string")
    assert sorted(r.path for r in allowed_categories(paths.union(paths), excluded).collect()) == ["/1/2/3/", "/1/2/4/"]
