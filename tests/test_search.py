"""Pruned search against all scores, and its counts against all pairs."""

import random

from pyspark.sql import functions as F

from gondola.operators import search as Q

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("", "la", "ro", "nté")]


def tables(spark, n=3_000, asked=40):
    rng = random.Random(6)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 9))), rng.choice([None, "bala", "coro"])) for i in range(n)]
    docs += [(n + i, "bala bala", "coro") for i in range(200)]  # ties
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(asked)] + ["bala", "bala bala", "zz", " ", None, "zz gu b"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    made = spark.createDataFrame(docs, "id int, name string, brand string").repartition(4).cache()
    return queries, made


def test_pruned_pages_are_those_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_DOCS", 16)
    queries, docs = tables(spark)
    postings, stats = Q.build_postings(docs).cache(), Q.field_stats(docs)
    scores = Q.score(queries, postings, stats).cache()
    for page, size in ((1, 10), (3, 7)):
        want = {(r.query_id, r.rank): (r.doc_id, r.score) for r in Q.page_of_hits(scores, page, size).collect()}
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in Q.best_hits(queries, postings, stats, page, size).collect()}
        assert got == want and want
    totals = {r.query_id: r.total for r in Q.total_hits(scores).collect()}
    assert {r.query_id: r.total for r in Q.count_hits(queries, postings).collect()} == totals
    asked = Q.asked_terms(queries)
    parts = Q.contributions(asked, postings, stats).groupBy("term", "doc_id").agg(F.sum("part").alias("part"))
    scored, every = Q.candidates(asked, parts, 10).count(), scores.count()
    print(f"scored {scored} of {every} pairs")
    assert scored < every / 5
    none = docs.limit(0)
    assert Q.search_products(queries, none, Q.build_postings(none), Q.field_stats(none)).count() == 0
    assert Q.search_products(queries.limit(0), docs, postings, stats).count() == 0
