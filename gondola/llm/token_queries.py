"""Registered queries on token ids and on conversations."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import chat, packing, pieces, token_files
from gondola.llm.registry import query, table
from gondola.llm.staging import shared_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Mixture of the packed windows: sources weigh the root of their size.
FLATTEN = 0.5


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0, flatten=FLATTEN)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window_id",
    )


@query("op2_sampled_pieces")
def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query("op7_token_planes")
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_ids(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2
    )
    ids = token_files.read_ids(spark, path)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_CHAT_SQL = r"""
WITH every AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
           coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS earlier,
           length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars,
           length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars
    FROM every
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
           AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN earlier = role THEN 8 ELSE 8 + role_chars + 8 + 7 END) AS BIGINT)
           AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op9_chat_format", _CHAT_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    marks = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string"
    )
    made = chat.format_conversations(rows.unionByName(planted))
    turns = chat.read_turns(F.col("formatted"))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
