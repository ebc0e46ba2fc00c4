"""Registered queries on near duplicates and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import nn_descent, one_bit_search, sketch_dedup
from gondola.llm.registry import query, table


@query("op8_sketch_dedup")
def op8_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return made.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_nn_descent")
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


_SEARCH_SQL = """
WITH usable AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score
    FROM usable q JOIN usable x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 20
"""


@query("op6_one_bit_search", _SEARCH_SQL)
def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search.search(vectors, F.col("vec_id") % 20 == 0, k=20)
