"""Near duplicates and vector search against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import nn_descent, one_bit_search, sketch_dedup
from gondola.llm.dedup_queries import op3_nn_descent, op8_sketch_dedup

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, shingle_set(text, k))
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(s), roots(sets, links)[i]) for i, s in sets.items()} if len(sets) < 2 else _named(sets, roots(sets, links))


def _named(sets, found):
    return {i: (len(s), found[i]) for i, s in sets.items()}


def test_op8_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 3, 85)
    got = op8_sketch_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def near_group(rng, n, others):
    """A text and copies with some words changed, similar to different degrees, among others."""
    vocabulary = [f"w{i}" for i in range(4000)]
    middle = rng.choices(vocabulary, k=300)
    rows = []
    for i in range(n):
        words = list(middle)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 200)))) for i in range(others)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(3000 + i, passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(others)]
    return rows


@pytest.mark.parametrize("words, percent, tiles", [(3, 85, None), (5, 80, None), (3, 85, (16, 3_000))])
def test_near_copies_of_all_degrees(spark, monkeypatch, tiles, words, percent):
    rows = near_group(random.Random(7), 50 if tiles else 150, 10 if tiles else 60)
    if tiles:
        monkeypatch.setattr(sketch_dedup, "BUCKET_TILE", tiles[0])
        monkeypatch.setattr(sketch_dedup, "CLUSTER_TILE", tiles[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_dedup.near_duplicates(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_hard_rows(spark, hard_docs, no_docs):
    rows, df = hard_docs
    got = sketch_dedup.near_duplicates(df, 5, 80).collect()
    want = brute([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = sketch_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ids.count(None) == 2
    assert sketch_dedup.near_duplicates(no_docs).count() == 0 and sketch_dedup.drop_near_duplicates(no_docs).count() == 0


def test_drop_keeps_columns_of_any_name_and_type(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base, {"a": 1}, 5), (1, base, {"a": 1}, 5), (2, base + " x", {"b": 2}, 6), (3, "other words here", None, 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _key map<string,int>, `_id.x` int").withColumn("_id", F.lit(1))
    kept = sketch_dedup.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id, r._key) for r in kept.collect()) == [(1, {"a": 1}), (3, None)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (1.0, 0.9, 0.5):
        keep = int(400 * share)
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, 400 - keep).astype(np.uint64)])
        true = keep / (800 - keep)
        same = (sketch_dedup.sketch(np.unique(a), 4000) == sketch_dedup.sketch(np.unique(b), 4000)).mean()
        assert abs(same - true) < 0.04
    for n in (1, 2, 50):  # every bin is filled, also from tiny sets
        assert (sketch_dedup.sketch(a[:n], 120) != np.iinfo(np.uint64).max).all()


def vector_rows(rng):
    rows = []
    for label in range(3):
        middle = rng.normal(size=24)
        rows += [(label, middle + rng.normal(size=24) * s) for s in rng.uniform(0.02, 0.22, 120)]
        rows += [(label, rng.normal(size=24)) for _ in range(150)]
        rows += [(label, rows[-1][1])] * 4
        rows += [(label, 3.0 * rows[-1][1]), (label, np.zeros(24)), (label, rng.normal(size=7))]
    rows += [(None, middle), (0, None), (0, np.array([np.nan] * 24)), (0, np.array([np.inf] + [1.0] * 23))]
    made = [(i, None if v is None else [float(x) for x in v], s) for i, (s, v) in enumerate(rows)]
    return [*made, (len(made), [1.0, None], 0), (None, made[0][1], 0), (3, made[3][1], 0)]


def test_nn_descent_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "TILE", 32)
    rows = vector_rows(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    fine = [
        (i, s, np.array(v) / np.linalg.norm(v))
        for i, v, s in rows
        if None not in (i, v, s) and None not in v and np.isfinite(v).all() and any(v)
    ]
    near = [
        (a, b)
        for a, b in itertools.combinations(range(len(fine)), 2)
        if fine[a][1] == fine[b][1] and len(fine[a][2]) == len(fine[b][2]) and fine[a][2] @ fine[b][2] >= 0.93
    ]
    links = np.bincount(np.array(near).ravel(), minlength=len(fine))
    want = {f[0]: n for f, n in zip(fine, links, strict=True)}
    found = roots({i for i, *_ in fine}, [(fine[a][0], fine[b][0]) for a, b in near])
    got = nn_descent.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (want.get(r.vec_id, 0), found.get(r.vec_id, r.vec_id))
            assert r.kept == (r.component_id == r.vec_id)
    assert nn_descent.near_duplicate_vectors(df.limit(0)).count() == 0


def nn_descent_equals_all_pairs(spark, x):
    """``x`` as one label; whole results against all pairs."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), np.argwhere(np.triu(near)).tolist())
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicate_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(x))}
    return near


def test_nn_descent_joins_saturated_neighbourhoods(spark, monkeypatch):
    """Two groups of near copies with a few links across: no list of eight holds one of them."""
    monkeypatch.setattr(nn_descent, "LONGEST", 8)
    monkeypatch.setattr(nn_descent, "TILE", 128)
    rng = np.random.default_rng(4)
    one = np.eye(64)[0]
    other = 0.935 * one + np.sqrt(1 - 0.935**2) * np.eye(64)[1]
    x = np.concatenate([c + 0.1 / 8 * rng.normal(size=(200, 64)) for c in (one, other)])
    near = nn_descent_equals_all_pairs(spark, x)
    assert near[:200, 200:].any() and near[:200, :200].sum() > 200 * 190


def test_nn_descent_finds_isolated_pairs_beside_a_hot_group(spark, monkeypatch):
    """A third of the label are near copies, whose links outnumber those of all pairs; one tree misses many pairs."""
    monkeypatch.setattr(nn_descent, "TREES", 1)
    rng = np.random.default_rng(6)
    hot = np.eye(64)[0] + 0.1 / 8 * rng.normal(size=(500, 64))
    one = rng.normal(size=(500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.normal(size=(500, 64))
    side -= (side * one).sum(axis=1, keepdims=True) * one
    other = 0.94 * one + np.sqrt(1 - 0.94**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    near = nn_descent_equals_all_pairs(spark, np.concatenate([hot, one, other]))
    assert near[500:, 500:].sum() >= 1000


def test_op3_runs_on_all_rows(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert op3_nn_descent(spark, SF).count() == n


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(one_bit_search, "BLOCK_VECTORS", 200)
    monkeypatch.setattr(one_bit_search, "BLOCK_QUERIES", 20)
    rows = vector_rows(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    fine = [
        (n, i, np.array(v)) for n, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    got = {}
    for r in one_bit_search.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for n, i, v in fine:
        if i % 20:
            continue
        scores = sorted((-float((v * x).sum()), j) for m, j, x in fine if m != n and len(x) == len(v))[:20]
        own = sorted(got[i])
        assert [k for k, *_ in own] == list(range(1, len(own) + 1)) and len(own) == len(scores)
        hits += len({j for _, j, _ in own} & {j for _, j in scores})
        total += len(scores)
    assert hits >= 0.99 * total
    assert one_bit_search.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_walks_read_the_texts_of_clusters_only(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(5)
    base = " ".join(rng.choices(words, k=80))
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(40)] + [(50, base), (51, base + " end"), (51, base + " end")]
    read = []
    confirmed = sketch_dedup._confirmed

    def counted(members, texts, *rest):
        read.extend(r.id for r in texts.collect())
        return confirmed(members, texts, *rest)

    monkeypatch.setattr(sketch_dedup, "_confirmed", counted)
    got = sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(read) == [50, 51]
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(40)}, 50: 50, 51: 50} and len(got) == 43
