"""Registered queries on document quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import quality
from gondola.llm.registry import query, table


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(documents, labels, keep=["doc_id", "lang"])
    return judged.select("doc.doc_id", "doc.lang", "perplexity", "threshold", "kept")
