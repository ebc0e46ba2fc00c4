import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gondola.functions import vectors as V
from gondola.operators import clusters as K
from gondola.operators import tiles as X
from gondola.operators.components import components
from gondola.operators.lists import nest
from gondola.operators.numbering import number_rows


def roots_of(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("shape", ["path", "shuffled", "star", "random", "none"])
def test_components(spark, shape):
    rng, n = random.Random(3), 120
    order = list(range(n))
    if shape == "shuffled":
        rng.shuffle(order)
    edges = {
        "star": [(n - 1, i) for i in range(n - 1)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)],
        "none": [],
    }.get(shape, list(zip(order, order[1:])))
    v = spark.range(n)
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.root for r in components(v, e).collect()}
    assert got == roots_of(n, edges)


def points(seed=1):
    """Tight groups, loose points, exact copies and a zero vector in two stores."""
    rng = np.random.default_rng(seed)
    rows = []
    for store in (1, 2):
        for c in range(12):
            middle = rng.normal(size=16)
            rows += [(store, middle + rng.normal(size=16) * 0.03 * (c % 4)) for _ in range(12)]
        rows += [(store, rng.normal(size=16)) for _ in range(40)]
        rows += [(store, rows[-1][1])] * 5
        rows += [(store, np.zeros(16))] * 2
    return [(i, s, [float(x) for x in v]) for i, (s, v) in enumerate(rows)]


@pytest.mark.parametrize("eps", [0.01, 0.05, 0.3])
@pytest.mark.parametrize("tile_rows", [4, 256])
def test_clusters_against_brute_force(spark, monkeypatch, eps, tile_rows):
    data = points()
    monkeypatch.setattr(X.pack, "__defaults__", (None, tile_rows))
    df = spark.createDataFrame(data, "id long, store int, v array<double>").repartition(5)
    units = [np.array(v) / (np.linalg.norm(v) or 1) for _, _, v in data]
    edges = [
        (a, b)
        for a, b in itertools.combinations(range(len(data)), 2)
        if data[a][1] == data[b][1] and units[a] @ units[b] >= 1 - eps - 1e-12
    ]
    got = {r.id: r.root for r in K.cluster_names(df, "id", "v", eps, ["store"]).collect()}
    assert got == roots_of(len(data), edges)
    if tile_rows == 4:
        pairs = {(r.id_a, r.id_b) for r in K.epsilon_self_join(df, "id", "v", eps, ["store"]).collect()}
        assert pairs == set(edges)


def test_near_copies_do_not_pair_up(spark, monkeypatch):
    """A group of near copies costs one edge per point, not one per pair."""
    rng = np.random.default_rng(0)
    middle = rng.normal(size=16)
    data = [(i, [float(x) for x in middle + rng.normal(size=16) * 1e-4]) for i in range(600)]
    monkeypatch.setattr(X.pack, "__defaults__", (None, 16))
    df = K.unit_vectors(spark.createDataFrame(data, "id long, v array<double>"), "id", "v")
    packed = K._tiles(df, [], math.sqrt(0.02))
    edges = K._linking_edges(packed, [], 0.01)
    assert edges.count() <= 2 * len(data)
    assert components(df, edges).select("root").distinct().count() == 1


def test_cluster_numbers_restart_per_store(spark):
    df = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (1, 12, 12), (2, 5, 5), (2, 20, 20)], "store int, id long, root long")
    got = {(r.store, r.id): r.cluster for r in K.cluster_number(df, ["store"]).collect()}
    assert got == {(1, 10): 0, (1, 11): 0, (1, 12): 1, (2, 5): 0, (2, 20): 1}


def test_quality_guards(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], "id long, v array<double>, c int")
    assert K.silhouette(one, "id", "v", "c").first()[0] is None
    each = one.withColumn("c", F.col("id"))
    assert K.silhouette(each, "id", "v", "c").first()[0] is None


def test_silhouette_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=3)], i % 7 if i < 60 else 7 + i) for i in range(80)]
    monkeypatch.setattr(X.pack, "__defaults__", (None, 8))
    df = spark.createDataFrame(data, "id long, v array<double>, c int")
    x, c = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i in range(len(x)):
        same = c == c[i]
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = gap[i][same].sum() / (same.sum() - 1)
        b = min(gap[i][c == k].mean() for k in set(c) - {c[i]})
        scores.append((b - a) / max(a, b))
    assert K.silhouette(df, "id", "v", "c").first()[0] == pytest.approx(np.mean(scores), abs=1e-9)


def test_numbering_is_consecutive(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = [(r.k, r.n) for r in number_rows(df, ["k"], "n").collect()]
    assert sorted(got) == [(i, i) for i in range(5000)]


def test_nest_keeps_one_row_per_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    rows = nest(df, ["k"], F.struct("id"), "items").select("k", F.expr("transform(items, i -> i.id)").alias("ids")).collect()
    assert len(rows) == 501 and sorted(i for r in rows for i in r.ids) == list(range(5000))
    assert all(r.ids == sorted(r.ids) for r in rows)


def test_embedding_hook(spark):
    def lengths(names):
        return [[float(len(n)), 1.0] for n in names]

    df = spark.createDataFrame([("O Arroz de casa",)], "name string")
    row = V.embed_names(df, stopwords=["o", "de"], model=lengths).first()
    assert row.embedded_name == [float(len("arroz casa")), 1.0]
    assert V.embed_names(df).first().embedded_name is not None


def test_one_vector_and_only_zero_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    assert {r.id: r.root for r in K.cluster_names(one, "id", "v", 0.01).collect()} == {1: 1, 2: 1}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    assert {r.id: r.root for r in K.cluster_names(zero, "id", "v", 0.01).collect()} == {1: 1, 2: 2, 3: 3}


def test_tiles_are_sent_once_per_cell_not_once_per_pair(spark, monkeypatch):
    monkeypatch.setattr(X, "_RACKS", 2, raising=False)
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(16)], "id long, v array<double>")
    tiles = X.pack(points.coalesce(1), [], "id", "v", ["id"], rows=2)
    n = tiles.count()
    small = X.describe(tiles)

    def kernel(a, b):
        b["met"] = b.get("met", 0) + 1
        return pd.DataFrame({"a": [a["tile"]], "b": [b["tile"]], "met": [b["met"]]})

    found = X.compare(X.pair(small, small, [], None), tiles, tiles, kernel, "a long, b long, met long").collect()
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in range(n) for b in range(n)]
    # Two racks on the left: each right tile arrives twice, whatever the number of its pairs.
    assert sum(r.met == 1 for r in found) == 2 * n
