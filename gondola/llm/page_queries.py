"""Registered query on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import page_text
from gondola.llm.registry import query, table


@query("op11_page_text")
def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = page_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.select(
        F.col("page.page_id").cast("long").alias("page_id"),
        "page.url",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        "n_template",
    )
