"""Plans that must hold at size: what is shuffled and broadcast, with the rows of the plain way."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gondola.functions import vectors as V
from gondola.functions.text import edge_ngrams
from gondola.operators import catalogue as A
from gondola.operators import checkout as C
from gondola.operators import clusters as K
from gondola.operators import gold as G
from gondola.operators import numbering as N
from gondola.operators import search as Q
from gondola.operators import silver as S
from gondola.operators import tiles as X
from gondola.operators.gold import Gold
from gondola.operators.match import match_family, vector_key
from gondola.plans import catalog  # noqa: F401  (registers the queries)
from gondola.plans.registry import QUERIES, Inputs
from gondola.session import cut_in_buckets, cut_lineage, joins_by_buckets
from gondola.sources import layers as L


def test_sums_by_cart_ship_lists_not_joined_rows(spark, monkeypatch):
    """One shuffle of cart lines with lists of offers; large carts and long lists are divided, nulls kept."""
    for name, value in {"_LIST": 3, "_CART": 4, "_PARTS": 3, "_ROWS": 50}.items():
        monkeypatch.setattr(C, name, value)
    lines = [(c, p, 1 + (c + p) % 3) for c in range(8) for p in range(20) if c == 0 or (c * p) % 5 == 1] + [(None, 3, 2)]
    carts = spark.createDataFrame(lines, "cart_id long, product_id int, quantity int")
    sold = [(s, p, f"{s + p}.25") for s in range(9) for p in range(20) if s == 0 or (s + p) % 4] + [(None, 3, "1.00"), (50, 6, None)]
    offers = spark.createDataFrame(sold, "store_id int, product_id int, price string").withColumn("price", F.col("price").cast("decimal(18,2)"))
    dealt = C.cart_offers(carts, offers, by_cart=True)
    plain = C.cart_offers(carts, offers)
    assert sorted(map(str, dealt.drop("_part").collect())) == sorted(map(str, plain.collect()))
    summed = C.offer_by_store(dealt)
    want = sorted(map(str, C.offer_by_store(plain).collect()))
    assert sorted(map(str, summed.collect())) == want
    shuffles = [line for line in summed._jdf.queryExecution().simpleString().split("\n") if "Exchange hashpartitioning(cart_id" in line]
    assert shuffles and all("_part" in line for line in shuffles)
    full = sorted(map(str, C.full_offers(carts, offers).collect()))
    assert full == sorted(map(str, C.covers_whole_cart(C.offer_by_store(plain), carts).select("cart_id", "store_id", "total_cost", "n_items").collect()))
    assert dealt.where("cart_id = 0").select("_part").distinct().count() == 3


def test_tiles_of_small_groups_stand_in_one_cell(spark, monkeypatch):
    """The grid follows the largest side of a group, whatever the number of groups; nothing is broadcast."""
    monkeypatch.setattr(X, "_SPREAD_TILES", 4)

    def described(rows):
        return spark.createDataFrame(rows, "g int, tile_id long, centre array<double>, radius double")

    def pairs(rows, group):
        tiles = described(rows)
        met = X.pair(tiles, tiles, group, 1.0)
        plan = met._jdf.queryExecution().simpleString()
        return sorted(map(tuple, met.collect())), plan

    small = [(g, 10 * g + i, [float(2 * i)], 0.25) for g in range(40) for i in range(3)]
    found, plan = pairs(small, ["g"])
    assert found == [(t, t) for _, t, _, _ in small]
    assert X._stripes(described(small), described(small), ["g"]) is None
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    large = small + [(99, 1000 + i, [0.0], 0.25) for i in range(20)]
    both = sorted([(t, t) for _, t, _, _ in small] + [(1000 + i, 1000 + j) for i in range(20) for j in range(20)])
    assert pairs(large, ["g"])[0] == both
    assert pairs(large[-20:], [])[0] == both[-400:]


def test_layer_files_grow_with_partitions_alone(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 5).cast("int").alias("store_id"), F.col("id").alias("ref_id")).repartition(8)
    assert L.write_layer(rows, str(tmp_path), "silver", "t", partition_by=["store_id"])
    assert len(list((tmp_path / "silver" / "t").glob("store_id=*/*.parquet"))) == 5
    assert L.read_layer(spark, str(tmp_path), "silver", "t").count() == 2000


def test_postings_of_a_cut_are_not_broadcast(spark):
    """Small files may hold many postings: only words and statistics may be broadcast."""
    docs = cut_lineage(spark.createDataFrame([(i, f"ring bolt {i % 7}", "b") for i in range(50)], "id long, name string, brand string"))
    asked = spark.createDataFrame([("q", "ring", 1)], "query_id string, term string, times long")
    parts = Q.contributions(asked, cut_lineage(Q.build_postings(docs)), Q.field_stats(docs))
    joins = [line for line in parts._jdf.queryExecution().simpleString().split("\n") if "Join [field" in line and "term" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert parts.count() == 50


def test_names_are_cleaned_once_each(spark, monkeypatch):
    """Copies of a name cost a join, not another cleaning; null names stay out."""
    seen, clean = spark.sparkContext.accumulator(0), V.clean_names

    @F.udf("string")
    def count(text):
        seen.add(1)
        return text

    monkeypatch.setattr(V, "clean_names", lambda name, stop=None: clean(count(name), stop))
    names = [("Arroz de casa",), ("arroz CASA",), ("feijao",), (None,)]
    df = spark.createDataFrame(names, "name string").crossJoin(spark.range(50))
    got = V.embed_names(df, stopwords=["de"]).select("id", "name", "embedded_name").collect()
    assert seen.value == 3
    assert len(got) == 150 and len({tuple(r.embedded_name) for r in got}) == 2
    assert {r.name for r in got} == {"Arroz de casa", "arroz CASA", "feijao"}


def _terms(postings):
    return sorted(map(str, postings.select("field", "term", "doc_id", "dl", "tf").collect()))


def test_postings_are_counted_inside_rows(spark):
    """Only rows whose id repeats or is null are summed over rows; a score's pairs are dealt out before they are summed."""
    rows = [(1, "ba ba bo", "b"), (2, "ba", None), (2, "ba", "x"), (2, "bo", "x"), (3, None, None), (4, "", "--")]
    rows += [(None, "ba", "b"), (None, "ba", "b"), (None, "bu", None)]
    docs = spark.createDataFrame(rows, "id int, name string, brand string")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), edge_ngrams(F.col(f)).alias("g")) for f in ("name", "brand")]))
    plain = docs.select(F.col("id").alias("doc_id"), fields.alias("f")).select("doc_id", "f.field", F.size("f.g").alias("dl"), F.explode("f.g").alias("term"))
    postings = Q.build_postings(docs)
    assert _terms(postings) == _terms(plain.groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf")))
    plan = postings._jdf.queryExecution().simpleString()
    dealt = [part for part in plan.split("Exchange hashpartitioning(")[1:] if part.startswith("field")]
    assert dealt and all("_n" in part for part in dealt)
    asked = spark.createDataFrame([("q", "ba b")], "query_id string, text string")
    scored = Q.score(asked, postings, Q.field_stats(docs))
    assert "REPARTITION_BY_NUM" in scored._jdf.queryExecution().simpleString()
    assert {r.doc_id for r in scored.collect()} == {1, 2, None}


def test_listings_of_one_text_are_cleaned_once(spark, monkeypatch):
    """Copies of a listing's texts cost a join, not another cleaning; null measures are texts too."""
    seen, clean = spark.sparkContext.accumulator(0), S.normalize_name

    @F.udf("string")
    def count(text):
        seen.add(1)
        return text

    monkeypatch.setattr(S, "normalize_name", lambda name: clean(count(name)))
    texts = [("arroz 1kg", "Casa", None, None), ("feijao original", "Casa", ["2"], ["kg"]), ("feijao original", "Casa", None, ["kg"]), (None, "Casa", ["1"], ["g"])]
    listed = spark.createDataFrame(texts, "name string, brand string, weight array<string>, measure array<string>")
    listings = listed.crossJoin(spark.range(40).select((F.col("id") % 2).cast("int").alias("store_id"), F.col("id").alias("ref_id")))
    stores = spark.createDataFrame([(0, "casa"), (1, "outra")], "store_id int, slug string")
    silver, rejected = S.build_silver(listings, stores, drops_original=[1])
    got = silver.groupBy("store_id", "name", "brand").count().collect()
    assert seen.value == 6 and rejected.count() == 40
    assert sorted(tuple(r) for r in got) == [
        (0, "Arroz", "", 20), (0, "Feijao Original", "", 40), (1, "Arroz", "casa", 20), (1, "Feijao", "casa", 40)
    ]


def test_listings_travel_without_vectors(spark):
    """A vector moves once per different one, whatever the number of its listings; matches are those of the plain way."""
    names, rows = ["arroz", "feijao"], 40
    vectors = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [1.0, 0.05, 0.1], None, [0.0, 0.0, 0.0], [None, 1.0, 0.0]]
    gold = [(i, i % 3, names[i % 2] + " x", vectors[i % 6]) for i in range(rows)] + [(99, None, "arroz", vectors[0])]
    listings = spark.createDataFrame(gold, "gold_id long, brand_id int, name string, embedded_name array<double>")
    offered = [(10 * b + k, b, n + " y", v) for b in range(2) for k, (n, v) in enumerate([("arroz", vectors[0]), ("feijao", vectors[1])])]
    families = spark.createDataFrame(offered, "family_id int, brand_id int, name string, embedded_name array<double>")
    found = match_family(listings, families)

    def near(a, b):
        if a is None or None in a or not any(a):
            return False
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 >= 0.9

    want = [(g, f) for g, brand, name, v in gold for f, b, n, w in offered if brand == b and n[:4] == name[:4] and near(v, w)]
    assert sorted((r.gold_id, r.family_id) for r in found.collect()) == sorted(want) and want
    joined = [line for line in found._jdf.queryExecution().simpleString().split("\n") if "Join" in line]
    assert joined and not any("embedded_name" in line for line in joined)
    keys = listings.select(vector_key(F.col("embedded_name"))["_v1"].alias("k"), F.col("embedded_name").cast("string").alias("v")).distinct()
    assert keys.select("k").distinct().count() == keys.count()


def _seeding(spark):
    """Two stores with variations of one product under several families, a hot one, nulls and repeats."""
    family = "store_id int, brand string, cluster long, "
    names = ["b", None, "a", "b"]
    named = [(s, "x", c, names[c % 4], [float(c), 1.0 / 3]) for s in (2, 1) for c in range(6)] + [(1, None, 9, "lost", None)]
    families = spark.createDataFrame(named, family + "name string, embedded_name array<double>")
    sized = [(s, "x", c, w, "g", None if w == 3 else f"p{w}", f"img {c}") for s in (2, 1) for c in range(6) for w in (1, 2, 3)]
    variations = spark.createDataFrame(sized + [(2, "y", 7, 1, "g", "p1", "no family")], family + "weight int, measure string, name string, image_url string")
    sold = [(s, "x", c, w, "g", 100 * c + i, float(i), None, "l", "c", str(i)) for s in (1, 2) for c in range(5, 0, -1) for w in (1, 2, 3) for i in range(4, 0, -1)]
    sold += [(2, "y", 7, 1, "g", 1, 9.0, 9.0, "l", "c", "x"), (None, "x", 0, 1, "g", 1, 9.0, 9.0, "l", "c", "1")]
    kinds = family + "weight int, measure string, row_id long, price double, old_price double, link string, cart_link string, ref_id string"
    return Gold(families, variations, spark.createDataFrame(sold, kinds))


def test_offers_are_grouped_and_numbered_by_one_shuffle(spark, monkeypatch):
    """First offer per store and product in the order of their ids; sellers and variations in buckets are joined where they lie."""
    gold = _seeding(spark)
    products = cut_lineage(spark.createDataFrame([(7, "p1", 1, "g"), (8, "p2", 2, "g"), (9, None, 3, "g")], "product_id int, name string, weight int, measure string"))
    kinds = "store_product_id long, store_id int, product_id int, ref_id int, name string, price double, old_price double, link string, cart_link string, image_url string"
    old = spark.createDataFrame([(40, 1, 8, 1, "old", 1.0, 1.0, "l", "c", "i")], kinds)
    dealt = [cut_in_buckets(part, ["store_id", "brand", "cluster"], "seeding") for part in (gold.variations, gold.sellers)]
    plans, cut = [], N.cut_lineage

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().simpleString())
        return cut(df, *name)

    monkeypatch.setattr(N, "cut_lineage", seen)
    out = A.insert_store_products(Gold(gold.families, *dealt), products, old)
    got = [(r.store_product_id, r.store_id, r.product_id, r.ref_id, r.name, r.price, r.image_url) for r in out.collect()]
    first = [(s, p, 1, n, 1.0, "img 1") for s in (1, 2) for p, n in ((7, "p1"), (8, "p2"), (9, None)) if (s, p) != (1, 8)]
    assert sorted(got) == [(40, 1, 8, 1, "old", 1.0, "i")] + [(41 + i, *row) for i, row in enumerate(first)]
    assert A.insert_store_products(Gold(gold.families, *dealt), products, old.where("false")).count() == 6
    merges = [plan for plan in plans if plan.count("SortMergeJoin") and plan.count("Exchange rangepartitioning(") == 1]
    assert len(merges) == len(plans) == 2
    moved = [line for plan in plans for line in plan.split("\n") if "Exchange hashpartitioning(store_id" in line]
    assert not any("brand" in line for line in moved) and not any(line in plans[1] for line in moved)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_families_are_chosen_without_vectors(spark, monkeypatch):
    """Vectors are neither sorted, numbered nor moved for families that are not chosen; null names and vectors are kept."""
    gold, seen, assign = _seeding(spark), [], A.assign_ids

    def noted(df, *rest):
        seen.append(df)
        return assign(df, *rest)

    monkeypatch.setattr(A, "assign_ids", noted)
    brands = spark.createDataFrame([(3, "x", "x")], "brand_id long, slug string, name string")
    none = spark.createDataFrame([], "family_id long, brand_id long, name string, embedded_name array<double>")
    twice = gold.families.unionByName(gold.families)
    got = [tuple(r) for r in A.insert_families(twice, brands, none).orderBy("family_id").collect()]
    third = 0.333333
    assert got == [(1, 3, None, [1.0, third]), (2, 3, "a", [2.0, third]), (3, 3, "b", [0.0, third]), (4, None, "lost", None)]
    assert len(seen) == 1 and "embedded_name" not in seen[0].columns


def test_views_that_are_held_are_read_from_their_files(spark):
    """Gold views of seeding come from members written once; their groups and joins need no shuffle, the rows are the same."""
    t = Inputs(spark, "/root/testdata/sf0.001")
    held = t.holding(["gold_members", "gold_family_keys"], ["store_id", "brand", "cluster"])
    for name in ("gold_families", "gold_variations", "gold_sellers"):
        a, b = getattr(t, name), getattr(held, name)
        assert a.schema.simpleString() == b.schema.simpleString()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert all("lineitem" not in f for f in b.inputFiles())
    assert "Exchange" not in held.gold_variations._jdf.queryExecution().simpleString()


def test_stores_are_compared_whole_or_by_tiles(spark, monkeypatch):
    """Small stores make no tiles, large ones do; roots are the same, and points without store, direction or vector stay alone."""
    rng = np.random.default_rng(3)
    rows = [(int(s), [float(x) for x in rng.integers(1, 6, size=2)]) for s in range(6) for _ in range(5 + 12 * (s == 2))]
    rows += [(None, [1.0, 1.0])] * 2 + [(1, [0.0, 0.0])] * 2 + [(1, None), (1, [None, 1.0]), (1, [None, 1.0])]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "id long, store int, v array<double>").repartition(3)
    packed, pack = [], X.pack

    def seen(*args, **kwargs):
        packed.append(sorted(r.store for r in args[0].select("store").distinct().collect()))
        return pack(*args, **kwargs)

    monkeypatch.setattr(X, "pack", seen)
    found = []
    for limit in (2048, 8, 0):
        monkeypatch.setattr(K, "_WHOLE", limit)
        found.append({r.id: r.root for r in K.cluster_names(df, "id", "v", 0.01, ["store"]).collect()})
    assert packed == [[2], [0, 1, 2, 3, 4, 5]]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows[:42]]
    root = list(range(42))
    for _ in root:
        root = [min(root[j] for j in range(42) if rows[i][0] == rows[j][0] and unit[i] @ unit[j] >= 0.99) for i in range(42)]
    assert [found[0][i] for i in range(42)] == root
    assert K.cluster_names(df.union(df.where("id = 0")), "id", "v", 0.01, ["store"]).count() == len(rows)
    alone = len(rows) - 2
    assert [found[0][i] for i in range(42, len(rows))] == [*range(42, alone), alone, alone]


def test_tiles_are_read_in_small_groups(spark, monkeypatch):
    """A reader takes a row group's rows into memory at once, so few tiles are in one."""
    monkeypatch.setattr(X, "_READ_TILES", 3)
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<double>").coalesce(1)
    tiles = X.pack(points, [], "id", "v", ["id"], rows=2)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tiles.inputFiles()]
    rows = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert sum(rows) == tiles.count() >= 20 and max(rows) <= 3


def test_names_of_listings_are_cleaned_once_for_gold(spark, monkeypatch):
    """Copies of a name in many stores cost a join, not another cleaning; a null name has no family."""
    seen, clean = spark.sparkContext.accumulator(0), G.clean_names

    @F.udf("string")
    def count(text):
        seen.add(1)
        return text

    monkeypatch.setattr(G, "clean_names", lambda name, stop=None: clean(count(name), stop))
    names = spark.createDataFrame([("Arroz de casa",), ("arroz CASA",), ("feijao",), (None,)], "name string")
    listed = names.crossJoin(spark.range(30).select((F.col("id") % 3).cast("int").alias("store_id"), F.col("id").alias("row_id")))
    silver = listed.select(
        "store_id", "name", F.xxhash64("name", "row_id").alias("row_id"), F.lit("b").alias("brand"), F.lit(1).alias("weight"), F.lit("g").alias("measure"),
        *[F.lit(1.0).alias(c) for c in ("price", "old_price")], *[F.lit("x").alias(c) for c in ("link", "cart_link", "ref_id", "image_url")],
    )
    gold = G.build_gold(silver, stopwords=["de"])
    assert seen.value == 3
    assert sorted((r.store_id, r.cluster) for r in gold.families.collect()) == [(s, c) for s in range(3) for c in range(2)]
    assert gold.sellers.count() == 90 and gold.variations.count() == 6


def test_offers_travel_as_short_codes(spark, monkeypatch):
    """Offers of whole numbers and decimals are shuffled as bytes and shorts; extremes, nulls and other types are kept."""
    monkeypatch.setattr(C, "_CART", 2)
    carts = spark.createDataFrame([(c, p, 2) for c in range(5) for p in range(4) if c == 0 or (c + p) % 2] + [(None, 1, 1)], "cart_id long, product_id int, quantity int")
    sold = [(s, p, f"{s * 977 - p}.{p}5") for s in range(-3, 300, 7) for p in range(4)] + [(None, 1, "-9.99"), (5, 1, None), (None, 2, None)]
    text = spark.createDataFrame(sold, "store_id int, product_id int, price string")
    wide = spark.createDataFrame([(s, p, x) for s, p, _ in sold[:8] for x in ("1.00", "9999999999999999.99", "-9999999999999999.99")], text.schema)
    for kind, offers, coded in (("decimal(18,2)", text, True), ("int", text, True), ("decimal(18,2)", wide, False), ("string", text, False)):
        typed = offers.withColumn("price", F.expr(f"try_cast(price as {kind})"))
        dealt = C._offers_by_cart(cut_lineage(carts), typed)
        plain = carts.join(typed, "product_id")
        assert {f.name: f.dataType for f in dealt.drop("_part").schema} == {f.name: f.dataType for f in plain.schema}
        columns = sorted(plain.columns)
        assert sorted(map(str, dealt.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
        dealing = [line for line in dealt._jdf.queryExecution().simpleString().split("\n") if "Project" in line and "_part" in line]
        assert any("_c0" in line for line in dealing) == coded


def test_offers_are_not_sorted_by_store(spark, monkeypatch):
    """A table of few stores is sent to the offers, whatever its files' size; one of many is merged."""
    offers = spark.createDataFrame([(c, s, c) for c in range(4) for s in range(9)], "cart_id long, store_id int, total_cost int")
    near = spark.createDataFrame([(s, 1.5, 2) for s in range(0, 9, 2)], "store_id int, distance_km double, duration_min int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, join in ((5, "BroadcastHashJoin"), (4, "SortMergeJoin")):
            monkeypatch.setattr(C, "_SENT", limit)
            found, lost = C.attach_distance(offers, near), C.offers_without_distance(offers, near)
            assert all(join in df._jdf.queryExecution().simpleString() for df in (found, lost))
            assert found.count() == 20 and sorted(r.store_id for r in lost.collect()) == sorted([1, 3, 5, 7] * 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_land_compressed(spark):
    """Landed pages repeat their field names in every line, so they are written and read back as gzip."""
    listings = QUERIES["s4_read_listing_pages"](spark, "/root/testdata/sf0.001")
    assert listings.inputFiles() and all(f.endswith(".gz") for f in listings.inputFiles())
    assert listings.count() > Inputs(spark, "/root/testdata/sf0.001").raw_listings.count()


def test_silhouette_sums_inside_racks(spark, monkeypatch):
    """What leaves the comparison grows with points and clusters, not with pairs of tiles; the value is that of all pairs."""
    monkeypatch.setattr(X.pack, "__defaults__", (None, 4))
    monkeypatch.setattr(X, "_RACKS", 1)
    rng = np.random.default_rng(11)
    x, label = rng.normal(size=(98, 3)), np.array([i % 2 for i in range(96)] + [5, 6])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(98)], "id long, v array<double>, c int")
    sent, compare = [], X.compare

    def seen(*args, **kwargs):
        sent.append(compare(*args, **kwargs))
        return sent[-1]

    monkeypatch.setattr(X, "compare", seen)
    got = K.silhouette(df, "id", "v", "c").first()[0]
    assert sent[0].count() <= 98 * 5
    gap, scores = np.linalg.norm(x[:, None] - x[None], axis=2), []
    for i in range(98):
        a = gap[i][label == label[i]].sum() / max((label == label[i]).sum() - 1, 1)
        b = min(gap[i][label == k].mean() for k in {0, 1, 5, 6} - {int(label[i])})
        scores.append((b - a) / max(a, b) if i < 96 else 0.0)
    assert abs(got - np.mean(scores)) < 1e-9


def test_merge_joins_sellers_where_they_lie(spark, monkeypatch):
    """Sellers and variations in buckets of their family are joined without a shuffle, upserts send offers once, with the rows of the plain way."""
    gold = _seeding(spark)
    old = "store_product_id long, store_id int, product_id int, ref_id int, name string, price double, old_price double, link string, cart_link string, image_url string"
    known = spark.createDataFrame([(40, 1, 1, 1, "old", 1.0, 1.0, "l", "c", "i")], old)
    dealt = Gold(gold.families, *[cut_in_buckets(part, ["store_id", "brand", "cluster"], "merging") for part in gold[1:]])
    plans, cut = [], A.cut_lineage

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().simpleString())
        return cut(df, *name)

    monkeypatch.setattr(A, "cut_lineage", seen)
    rows = []
    for part in (gold, dealt):
        offers = A.batch_offers(part).withColumn("product_id", F.col("ref_id"))
        with joins_by_buckets(spark):
            rows.append(sorted(map(str, A.upsert_store_products(offers, known).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 9
    shuffles = [line for line in plans[1].split("\n") if "Exchange hashpartitioning(" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0] and "SortMergeJoin" in plans[1]
