"""Registered query on periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import periodic_runs
from gondola.llm.registry import query, table


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by the hash of their id, end in one repeated stretch."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.when((hashed % 10 == 0) & F.col("doc_id").isNotNull(), words).alias("words"),
        F.floor(hashed / 10).alias("g"),
    )
    n = F.size("words").cast("long")
    placed = split.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    )
    at = lambda i: F.col("a") + (i - F.col("a")) % F.col("p")
    made = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get(F.col("words"), at(i).cast("int"))).otherwise(w))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def _hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")), keep=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        _hex(listed).alias("runs_sha256"),
        _hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
