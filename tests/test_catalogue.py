import pytest
from pyspark.sql import functions as F

from gondola.operators import catalogue as C
from gondola.operators.gold import Gold, build_gold, flatten_gold, nest_gold
from gondola.plans.catalogue_queries import _gold, _old, _unseeded
from gondola.plans.registry import Inputs
from gondola.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_seeding_twice_changes_nothing(spark):
    t = Inputs(spark, SF_DIR)
    once = C.seed_catalogue(_gold(t), _unseeded(t))
    twice = C.seed_catalogue(_gold(t), once)
    for a, b in zip(once, twice):
        assert rows(a) == rows(b)
    assert C.audit_catalogue(twice, t.stores).count() == 0
    again = C.insert_families(_gold(t).families, once.brands, once.families, mirror=True)
    assert again.count() == 2 * once.families.count()


def test_merging_twice_changes_nothing(spark):
    t = Inputs(spark, SF_DIR)
    first = C.merge_listings(_gold(t), _old(t)).catalogue
    first = C.Catalogue(*[cut_lineage(part) for part in first])
    second = C.merge_listings(_gold(t), first)
    assert rows(second.catalogue.products) == rows(first.products)
    assert second.metrics.first().new_variations == 0
    assert second.catalogue.store_products.count() == first.store_products.count()
    assert C.unique_audit(second.catalogue.store_products, "store_id", "product_id").count() == 0


def test_family_of_the_same_brand(spark):
    gold = spark.createDataFrame(
        [(1, "acme", 0, "Leite"), (1, "best", 1, "Leite"), (1, None, 2, "Leite"), (1, "acme", 3, None)],
        "store_id int, brand string, cluster long, name string",
    )
    families = spark.createDataFrame(
        [(5, 1, "Leite"), (6, 1, "Leite"), (7, 2, "Leite"), (8, None, "Leite")], "family_id long, brand_id long, name string"
    )
    brands = spark.createDataFrame([(1, "acme"), (2, "best")], "brand_id long, slug string")
    wanted = gold.select("store_id", "brand", "cluster").where("brand is not null")
    by_brand = {r.cluster: r.family_id for r in C.lookup_family(wanted, gold, families, brands).collect()}
    assert by_brand == {0: 6, 1: 7, 3: None}
    assert {r.cluster: r.family_id for r in C.lookup_family(wanted, gold, families).collect()} == {0: 8, 1: 8, 3: None}


GOLD_COLUMNS = "store_id int, brand string, cluster long, "


def small_gold(spark, sellers):
    families = spark.createDataFrame([(1, "acme", 0, "Leite", [1.0, 0.0])], GOLD_COLUMNS + "name string, embedded_name array<double>")
    variations = spark.createDataFrame(
        [(1, "acme", 0, 1, "ml", "Leite 1", "img1"), (1, "acme", 0, 2, "ml", "Leite 2", "img2")],
        GOLD_COLUMNS + "weight int, measure string, name string, image_url string",
    )
    offers = spark.createDataFrame(
        [(1, "acme", 0, w, "ml", i, float(p), 9.0, "l", "c", ref) for i, (w, p, ref) in enumerate(sellers)],
        GOLD_COLUMNS + "weight int, measure string, row_id long, price double, old_price double, link string, cart_link string, ref_id string",
    )
    return Gold(families, variations, offers)


def small_catalogue(spark):
    return C.Catalogue(
        spark.createDataFrame([(1, "acme", "acme")], "brand_id int, slug string, name string"),
        spark.createDataFrame([(1, 1, "Leite", [1.0, 0.0])], "family_id int, brand_id int, name string, embedded_name array<double>"),
        spark.createDataFrame([(5, 1, "Leite 1", 1, "ml")], "product_id int, family_id int, name string, weight int, measure string"),
        spark.createDataFrame(
            [(50, 1, 5, 100, "old", 1.0, 2.0, "ol", "oc", "oi")],
            "store_product_id long, store_id int, product_id int, ref_id int, name string, price double, old_price double, link string, cart_link string, image_url string",
        ),
    )


def test_one_listed_seller_skips_the_whole_family(spark):
    out = C.merge_listings(small_gold(spark, [(1, 3, "100"), (2, 4, "200")]), small_catalogue(spark))
    (row,) = out.catalogue.store_products.collect()
    assert (row.price, row.name, row.link, row.product_id) == (3.0, "Leite 1", "l", 5)
    assert out.catalogue.products.count() == 1
    assert out.metrics.first().existent_products == 1


def test_conflict_replaces_the_price_only(spark):
    out = C.merge_listings(small_gold(spark, [(1, 3, "101"), (1, 7, "102"), (2, 4, "x")]), small_catalogue(spark))
    got = {r.product_id: r for r in out.catalogue.store_products.collect()}
    assert (got[5].price, got[5].name, got[5].ref_id) == (7.0, "old", 100)
    assert (got[6].price, got[6].name, got[6].ref_id) == (4.0, "Leite 2", None)
    assert out.metrics.first().new_variations == 1
    assert C.unreadable_refs(small_gold(spark, [(2, 4, "x")])).count() == 1


def test_delete_cascade(spark):
    c = small_catalogue(spark)
    gone = C.delete_cascade(c, families=c.families.select("family_id"))
    assert [gone.products.count(), gone.store_products.count(), gone.brands.count()] == [0, 0, 1]


def test_length_and_key_audits(spark):
    c = small_catalogue(spark)
    long = c.brands.unionByName(spark.createDataFrame([(1, "b" * 256, "acme")], c.brands.schema))
    stores = spark.createDataFrame([(2, "s", "S")], "store_id int, slug string, name string")
    broken = {r.rule: r.n for r in C.audit_catalogue(c._replace(brands=long), stores).collect()}
    assert broken == {"brand length": 1, "offer store": 1}


SILVER = (
    "store_id int, ref_id string, name string, brand string, measure string, weight int, price double, old_price double, "
    "link string, cart_link string, image_url string"
)


def test_gold_first_known_values_and_nesting(spark):
    silver = spark.createDataFrame(
        [
            (1, "a", "Leite Bom", "acme", "ml", 1, 1.0, 1.0, "l", "c", None),
            (1, "b", "Leite Bom", "acme", "ml", 1, 2.0, 1.0, "l", "c", "img"),
            (1, "c", "Leite Bom", "acme", "ml", 2, 3.0, 1.0, "l", "c", "img2"),
            (1, "d", "Leite Bom", "other", "ml", 1, 0.0, 0.0, "l", "c", "img2"),
            (1, "e", "Leite Bom", None, "ml", 1, None, 0.0, "l", "c", "img2"),
            (2, "f", "Leite Bom", "acme", "ml", 1, None, 0.0, "l", "c", "img2"),
        ],
        SILVER,
    )
    gold = build_gold(silver)
    nested = {r.store_id: r for r in nest_gold(gold).collect()}
    assert set(nested) == {1, 2} and gold.families.count() == 2
    one = nested[1]
    assert [(v.weight, v.image_url, [s.ref_id for s in v.sellers]) for v in one.variations] == [(1, "img", ["a", "b"]), (2, "img2", ["c"])]
    back = flatten_gold(nest_gold(gold))
    assert rows(back.variations.select("store_id", "weight", "name", "image_url")) == rows(gold.variations.select("store_id", "weight", "name", "image_url"))
    assert back.sellers.count() == 4


def test_catalogue_is_published_whole_or_not_at_all(spark, tmp_path):
    from gondola.sources.layers import catalogue_versions, read_catalogue, write_catalogue

    root = str(tmp_path)
    one = lambda name: spark.createDataFrame([(1, name)], "id int, name string")
    write_catalogue(C.Catalogue(*[one("first")] * 4), root, "v1")
    broken = spark.range(1).select(F.raise_error(F.lit("stopped")).cast("int").alias("id"), F.lit("x").alias("name"))
    for version in ("v1", "v2"):
        with pytest.raises(Exception, match="stopped"):
            write_catalogue(C.Catalogue(one("second"), one("second"), broken, one("second")), root, version)
    assert [[r.name for r in part.collect()] for part in read_catalogue(spark, root)] == [["first"]] * 4
    with pytest.raises(ValueError):
        read_catalogue(spark, root, "v2")
    write_catalogue(C.Catalogue(*[one("third")] * 4), root, "v1")
    assert [[r.name for r in part.collect()] for part in read_catalogue(spark, root, "v1")] == [["third"]] * 4
    assert catalogue_versions(spark, root).count() == 2
