"""Vectors, clusters and gold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import measure as M
from gondola.functions import vectors as V
from gondola.functions import similarity as Y
from gondola.operators import clusters as K
from gondola.operators import gold as G
from gondola.plans.registry import Inputs, query
from gondola.plans.text_queries import EXPECTED_MEASURE, EXPECTED_WEIGHT, STOP_SAMPLE, _empty, _words

# Cosine distance that gives small clusters at every scale of the test vectors.
EPS = 0.58
LOW = 1 - EPS - 1e-12
TIGHT = 1 - 0.01 - 1e-12

VECTORS = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _edges(same: str = "", low: float = LOW) -> str:
    return f"""
pairs AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.e, b.e) AS similarity
  FROM v a JOIN v b ON a.id < b.id {same} WHERE list_cosine_similarity(a.e, b.e) >= {low!r}),
links AS (SELECT id_a AS x, id_b AS y FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"""


@query("f21_vector_literal", "SELECT vec_id, CAST(sum(round(CAST(x AS DOUBLE), 6)) AS DOUBLE) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) u GROUP BY vec_id")
def f21(t: Inputs):
    rounded = V.vector_literal(F.col("embedding"))
    return t.embeddings.select("vec_id", F.aggregate(rounded, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("v2_l2_normalize", """SELECT vec_id, i, e[i] / sqrt(list_inner_product(e, e)) AS x FROM (
   SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) u""")
def v2(t: Inputs):
    unit = t.embeddings.select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("p", "x"))
    return unit.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "x")


@query(
    "v3_cosine_similarity",
    f"""+ {VECTORS} SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
        FROM v a JOIN v b ON b.id = a.id + 1""",
)
def v3(t: Inputs):
    a = t.embeddings.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("e"))
    b = t.embeddings.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("f"))
    near = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    return near.select("id_a", "id_b", F.round(V.cosine_similarity(F.col("e"), F.col("f")), 6).alias("similarity"))


_PROCESSED = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' '))"
SCORE_SQL = f"""
 round(100 - 100.0 * levenshtein(pa, pb) / greatest(length(pa), length(pb)), 6) AS edit_score,
 round(CASE WHEN len(list_distinct(list_concat(wa, wb))) = 0 THEN 0 ELSE
   len(list_intersect(list_distinct(wa), list_distinct(wb))) * 1.0 / len(list_distinct(list_concat(wa, wb))) END, 6) AS word_score"""


@query(
    "v6_mixed_similarity",
    f"""+ two AS (SELECT p_partkey, {_PROCESSED.format("p_name || ' ' || p_brand")} AS pa, {_PROCESSED.format("p_name || '-' || p_type")} AS pb FROM part),
         w AS (SELECT *, {_words('pa')} AS wa, {_words('pb')} AS wb FROM two),
         s AS (SELECT p_partkey, {SCORE_SQL} FROM w)
       SELECT p_partkey, edit_score, word_score, round(0.6 * edit_score + 40 * word_score, 4) AS score FROM s""",
)
def v6(t: Inputs):
    a, b = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws("-", "p_name", "p_type")
    return t.part.select("p_partkey", a.alias("a"), b.alias("b")).select(
        "p_partkey",
        F.round(Y.levenshtein_score(Y.processed(F.col("a"))["text"], Y.processed(F.col("b"))["text"]), 6).alias("edit_score"),
        F.round(Y.jaccard(Y.processed(F.col("a"))["words"], Y.processed(F.col("b"))["words"]), 6).alias("word_score"),
        F.round(Y.mixed_similarity(F.col("a"), F.col("b")), 4).alias("score"),
    )


BUCKETS = (
    f"list_sort(list_transform(list_filter({_words('lower(name)')}, lambda w: NOT list_contains({STOP_SAMPLE}, w)), "
    "lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64))"
)


@query(
    "v1_embed_names",
    f"""+ h AS (SELECT store_id, ref_id, unnest({BUCKETS}) AS bucket FROM raw_listings),
         c AS (SELECT store_id, ref_id, bucket, count(*) AS n FROM h GROUP BY ALL)
       SELECT store_id, ref_id, CAST(bucket AS INT) AS bucket,
         n / sqrt(sum(n * n) OVER (PARTITION BY store_id, ref_id)) AS x FROM c""",
    ("raw_listings",),
)
def v1(t: Inputs):
    named = V.embed_names(t.raw_listings, stopwords=STOP_SAMPLE)
    return named.select("store_id", "ref_id", F.posexplode("embedded_name").alias("bucket", "x")).where("x <> 0")


def _letters(names):
    """A model of two numbers per name: its length and how often it has the letter a."""
    return [(len(n), n.count("a")) for n in names]


@query(
    "u4_model_inference",
    """SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS n_chars,
         CAST(length(p_name) - length(replace(p_name, 'a', '')) AS DOUBLE) AS n_a FROM part""",
)
def u4(t: Inputs):
    names = V.embed_texts(t.part.select("p_partkey", "p_name"), "p_name", "v", _letters)
    return names.select("p_partkey", F.get("v", F.lit(0)).alias("n_chars"), F.get("v", F.lit(1)).alias("n_a"))


@query("j12_epsilon_self_join", f"+ {VECTORS}, {_edges()} SELECT id_a, id_b, similarity FROM pairs", recursive=True)
def j12(t: Inputs):
    return K.epsilon_self_join(t.embeddings, "vec_id", "embedding", EPS)


@query("a20_cluster_names", f"+ {VECTORS}, {_edges()} SELECT id, root FROM roots", recursive=True)
def a20(t: Inputs):
    return K.cluster_names(t.embeddings, "vec_id", "embedding", EPS)


@query("a20_cluster_names_tight", f"+ {VECTORS}, {_edges(low=TIGHT)} SELECT id, root FROM roots", recursive=True)
def a20_tight(t: Inputs):
    """So small a distance that points are separated by strips."""
    return K.cluster_names(t.embeddings, "vec_id", "embedding", 0.01)


@query(
    "a20_cluster_names_per_store",
    f"+ {VECTORS}, {_edges('AND a.label = b.label')} SELECT v.label, id, root FROM roots JOIN v USING (id)",
    recursive=True,
)
def a20_store(t: Inputs):
    return K.cluster_names(t.embeddings, "vec_id", "embedding", EPS, ["label"])


@query(
    "w4_cluster_number",
    f"""+ {VECTORS}, {_edges('AND a.label = b.label')} SELECT v.label, id,
        dense_rank() OVER (PARTITION BY v.label ORDER BY root) - 1 AS cluster FROM roots JOIN v USING (id)""",
    recursive=True,
)
def w4(t: Inputs):
    roots = K.cluster_names(t.embeddings, "vec_id", "embedding", EPS, ["label"])
    return K.cluster_number(roots, ["label"]).select("label", "id", "cluster")


@query(
    "a17_cluster_counts",
    f"+ {VECTORS}, {_edges()} SELECT count(DISTINCT root) AS n_clusters, CAST(0 AS BIGINT) AS n_noise FROM roots",
    recursive=True,
)
def a17(t: Inputs):
    return K.cluster_counts(a20(t).withColumnRenamed("root", "cluster"))


@query(
    "a18_silhouette",
    f"""+ {VECTORS}, sizes AS (SELECT label, count(*) AS size FROM v GROUP BY label),
       d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS total FROM v a, v b GROUP BY ALL),
       m AS (SELECT d.id, max(CASE WHEN d.other = d.label THEN total / nullif(s.size - 1, 0) END) AS a,
               min(CASE WHEN d.other <> d.label THEN total / s.size END) AS b
             FROM d JOIN sizes s ON s.label = d.other GROUP BY d.id)
       SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM m""",
)
def a18(t: Inputs):
    return K.silhouette(t.embeddings, "vec_id", "embedding", "label")


@query(
    "a19_davies_bouldin",
    f"""+ {VECTORS}, u AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM v) q GROUP BY ALL),
       c AS (SELECT label, list(x ORDER BY i) AS centre FROM u GROUP BY label),
       s AS (SELECT v.label, any_value(c.centre) AS centre, avg(list_distance(v.e, c.centre)) AS spread
             FROM v JOIN c ON c.label = v.label GROUP BY v.label),
       r AS (SELECT a.label, max((a.spread + b.spread) / list_distance(a.centre, b.centre)) AS worst
             FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
       SELECT avg(worst) AS davies_bouldin FROM r""",
)
def a19(t: Inputs):
    return K.davies_bouldin(t.embeddings, "embedding", "label")


def silver(t: Inputs):
    """Listings with the silver columns, row ids in (store, ref) order."""
    parsed = M.parse_measure(_empty(), _empty(), F.col("name")).alias("m")
    ref = F.col("ref_id").cast("string")
    return t.raw_listings.select("*", parsed).select(
        (F.col("store_id").cast("long") * 1000000000 + F.col("ref_id")).alias("row_id"),
        "store_id", "name", "brand", ref.alias("ref_id"), "m.measure", "m.weight",
        F.concat(F.lit("http://shop/"), ref).alias("link"), F.concat(F.lit("http://cart/?sku="), ref).alias("cart_link"),
        F.when(F.col("ref_id") % 5 == 0, 0).otherwise(F.col("price")).cast("decimal(18,2)").alias("price"),
        F.when(F.col("ref_id") % 10 == 0, 0).otherwise(F.col("old_price")).cast("decimal(18,2)").alias("old_price"),
        F.when(F.col("ref_id") % 3 != 0, F.concat(F.lit("http://img/"), ref)).alias("image_url"),
    )


# At eps 0.01 two word-count vectors match only if they are the same.
MEMBERS = f"""
members AS (SELECT *, min(row_id) OVER (PARTITION BY store_id, buckets) AS root FROM (
  SELECT CAST(store_id AS BIGINT) * 1000000000 + ref_id AS row_id, store_id, name, brand, ref_id, {EXPECTED_MEASURE} AS measure,
    {EXPECTED_WEIGHT} AS weight, CASE WHEN ref_id % 5 = 0 THEN 0 ELSE price END AS price,
    CASE WHEN ref_id % 3 <> 0 THEN concat('http://img/', CAST(ref_id AS VARCHAR)) END AS image_url, {BUCKETS} AS buckets
  FROM raw_listings WHERE ref_id % 10 <> 0) x),
clustered AS (SELECT *, dense_rank() OVER (PARTITION BY store_id ORDER BY root) - 1 AS cluster FROM members)"""


def _gold(t: Inputs):
    return G.build_gold(silver(t), stopwords=STOP_SAMPLE)


@query(
    "a2_gold_families",
    f"""+ {MEMBERS} SELECT store_id, brand, cluster, arg_min(name, row_id) AS name FROM clustered
        GROUP BY store_id, brand, cluster""",
    ("raw_listings",),
)
def a2(t: Inputs):
    return _gold(t).families.drop("embedded_name")


@query(
    "a3_gold_variations",
    f"""+ {MEMBERS} SELECT store_id, brand, cluster, weight, measure, arg_min(name, row_id) AS name,
          arg_min(image_url, row_id) FILTER (image_url IS NOT NULL) AS image_url
        FROM clustered GROUP BY store_id, brand, cluster, weight, measure""",
    ("raw_listings",),
)
def a3(t: Inputs):
    return _gold(t).variations


@query(
    "a1_nested_families",
    f"""+ {MEMBERS}, n AS (SELECT store_id, brand, cluster, count(DISTINCT (weight, measure)) AS n_variations,
          count(*) AS n_sellers, string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY weight, measure, row_id) AS refs
        FROM clustered GROUP BY store_id, brand, cluster) SELECT * FROM n""",
    ("raw_listings",),
)
def a1(t: Inputs):
    nested = G.nest_gold(_gold(t))
    refs = F.flatten(F.transform("variations", lambda v: F.transform(v["sellers"], lambda s: s["ref_id"])))
    return nested.select(
        "store_id", "brand", "cluster", F.size("variations").cast("long").alias("n_variations"),
        F.size(refs).cast("long").alias("n_sellers"), F.array_join(refs, ",").alias("refs"),
    )


@query(
    "j4_explode_variations_sellers",
    f"""+ {MEMBERS} SELECT store_id, brand, cluster, weight, measure, row_id, CAST(price AS DECIMAL(18,2)) AS price,
        CAST(ref_id AS VARCHAR) AS ref_id FROM clustered""",
    ("raw_listings",),
)
def j4(t: Inputs):
    flat = G.flatten_gold(G.nest_gold(_gold(t))).sellers
    return flat.select("store_id", "brand", "cluster", "weight", "measure", "row_id", "price", "ref_id")
