"""Registered queries on personal data and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import pii, secrets
from gondola.llm import spans as S
from gondola.llm.registry import query, table
from gondola.llm.staging import staged, text_or_empty


def _digest(base: Column) -> Column:
    return F.sha2(S.listed(base).cast("binary"), 256).alias("base_sha256")


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc.doc_id",
        *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        _digest(F.col("base")),
        S.listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts arrive in two calls: the second is asked for all of them and scans what the ledger has not seen.
    docs = table(spark, sf_dir, "documents")
    ledger = staged(secrets.scan(docs.where(secrets.blob_of(text_or_empty()) < "8")), "secret-ledger")
    found, _ = secrets.find_secrets(docs, keep=["doc_id"], ledger=ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.name for r in secrets.BASE]))
    return found.select("doc.doc_id", base.alias("base"), "spans").select(
        "doc_id",
        *[S.count_kind(F.col("base"), r.name).alias(f"n_{r.name}") for r in secrets.BASE],
        _digest(F.col("base")),
        S.listed(F.col("spans")).alias("spans"),
    )
