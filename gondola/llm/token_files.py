"""Token ids in files of shuffled planes.

Blocks of a fixed number of ids are transposed into byte or bit planes, each plane
is compressed with zstandard, and an index says where every block begins. A shard
is what one task wrote, in ascending document order; blocks never cross shards.
Beside its planes a block names the documents that touch it, so one block alone
can be read and checked. Files are written by Spark's own writer, so a lost
executor leaves no half-written shard.

Layout below ``path``: ``blocks`` (planes and documents), ``index`` (one row per
block: shard, block, first_id, n_ids, plane_bytes, crc32).

Defined results: null text is empty, so its document holds the end id only; null
ids come first; documents with one id follow their text; an empty table gives
files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.staging import text_or_empty
from gondola.llm.tokens import encode_batches

BLOCK_IDS = 65_536
LEVEL = 3

_BLOCKS = (
    "shard int, block int, first_id long, n_ids int, crc32 long, plane string, plane_bytes array<int>, "
    "planes array<binary>, documents array<struct<doc_id:long,start:long,n:long>>"
)
_PIECES = "doc_id long, shard int, start long, n long, first long, ids binary"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids, each compressed."""
    lanes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if kind == "bit":
        bits = np.unpackbits(lanes[:, :, None], axis=2, bitorder="little")
        lanes = np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1)
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(np.ascontiguousarray(lane).tobytes()) for lane in lanes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    lanes = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if kind == "bit":
        bits = np.unpackbits(lanes, axis=1, count=n).reshape(4, 8, n)
        lanes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(lanes.T).view("<u4").reshape(-1)


def _write_kernel(tokenizer: str, end_id: int, kind: str, block_ids: int):
    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("block", pa.int32()),
            ("first_id", pa.int64()),
            ("n_ids", pa.int32()),
            ("crc32", pa.int64()),
            ("plane", pa.string()),
            ("plane_bytes", pa.list_(pa.int32())),
            ("planes", pa.list_(pa.binary())),
            ("documents", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        waiting = bytearray()
        documents: list[dict] = []
        block = first = filled = 0

        def row(raw: bytes) -> pa.RecordBatch:
            nonlocal block, first, documents
            ids = np.frombuffer(raw, "<u4")
            planes = to_planes(ids, kind)
            made = {
                "shard": shard,
                "block": block,
                "first_id": first,
                "n_ids": len(ids),
                "crc32": zlib.crc32(raw),
                "plane": kind,
                "plane_bytes": [len(p) for p in planes],
                "planes": planes,
                "documents": [d for d in documents if d["start"] < first + len(ids)],
            }
            block, first = block + 1, first + len(ids)
            documents = [d for d in documents if d["start"] + d["n"] > first]
            return pa.RecordBatch.from_pylist([made], schema)

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at, encoded in encode_batches(texts, tokenizer):
                for i, raw in enumerate(encoded, at):
                    waiting += raw + end
                    n = len(raw) // 4 + 1
                    documents.append({"doc_id": names[i], "start": filled, "n": n})
                    filled += n
                    if len(waiting) >= 4 * block_ids:
                        whole = len(waiting) // (4 * block_ids) * 4 * block_ids
                        for k in range(0, whole, 4 * block_ids):
                            yield row(bytes(waiting[k : k + 4 * block_ids]))
                        del waiting[:whole]
        if waiting:
            yield row(bytes(waiting))

    return kernel


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of all documents, each followed by ``end_id``, below ``path``."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    blocks = ordered.mapInArrow(_write_kernel(tokenizer, end_id, kind, block_ids), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    index = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    index.select("shard", "block", "first_id", "n_ids", "plane_bytes", "crc32").write.parquet(f"{path}/index")


def _read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("shard", pa.int32()),
            ("start", pa.int64()),
            ("n", pa.int64()),
            ("first", pa.int64()),
            ("ids", pa.binary()),
        ]
    )
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            raw = from_planes(row["planes"], row["n_ids"], row["plane"]).tobytes()
            if zlib.crc32(raw) != row["crc32"]:
                raise ValueError(f"shard {row['shard']}, block {row['block']}: wrong checksum")
            out = []
            for d in row["documents"]:
                begin = max(d["start"], row["first_id"])
                stop = min(d["start"] + d["n"], row["first_id"] + row["n_ids"])
                piece = raw[4 * (begin - row["first_id"]) : 4 * (stop - row["first_id"])]
                out.append({**d, "shard": row["shard"], "first": begin, "ids": piece})
            yield pa.RecordBatch.from_pylist(out, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before it. Only documents that cross
    a block are gathered; the offsets have one row per shard, hence the broadcast.
    """
    index = spark.read.parquet(f"{path}/index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        index.groupBy("shard")
        .agg(F.sum("n_ids").alias("_n"))
        .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    pieces = blocks.select("shard", "first_id", "n_ids", "crc32", "plane", "planes", "documents").mapInArrow(
        _read_kernel, _PIECES
    )
    whole = F.length("ids") == 4 * F.col("n")
    parts = F.array_sort(F.collect_list(F.struct("first", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    crossing = pieces.where(~whole).groupBy("shard", "start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), joined.alias("ids")
    )
    every = pieces.where(whole).select("doc_id", "shard", "start", "n", "ids").unionByName(crossing)
    return every.join(F.broadcast(bases), "shard").select(
        "doc_id",
        (F.col("start") + F.col("_base")).alias("start"),
        F.col("n").alias("n_tokens"),
        "ids",
    )
