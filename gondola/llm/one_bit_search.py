"""Nearest neighbours by randomly rotated one-bit codes.

A vector minus the centre of all vectors is scaled to length one, rotated by a random
orthogonal matrix and kept as its signs. Beside the packed bits stand two scalars: the
length of the difference, and the inner product of the code with the vector it stands
for. With them the inner product with a query is estimated without bias, and its error
is bounded; only vectors whose upper bound reaches the k-th best exact product are
computed exactly.

Queries and vectors meet in blocks of bounded size, each block pair in one task; a pair
sends k rows per query, ranked again over all blocks. Work grows with queries times
vectors, as the search is defined over all of them, at one bit per component for most.

Defined results: vectors that are null, zero or not finite and rows with null id take
no part; only vectors of equal length meet; repeated rows are rows of their own; a
query never finds its own row; ties go to the smaller id; no queries, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.staging import staged
from gondola.llm.vectors import matrix, usable

BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 1_024
#: Standard errors of the bound; the estimate leaves it about once in a thousand.
BOUND = 3.0
SEED = 20

_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _rotations:
        made, upper = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
        _rotations[d] = made * np.sign(np.diag(upper))
    return _rotations[d]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, fit) per row; fit is the inner product of code and scaled vector."""
    rest = x - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    turned = rest / np.where(length > 0, length, 1)[:, None] @ rotation(x.shape[1])
    fit = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean of all vectors by their dimension: one small row per task, then one per component."""

    def sums(batches):
        for batch in batches:
            for d in np.unique(batch.column("d").to_numpy()):
                own = batch.filter(pa.array(batch.column("d").to_numpy() == d))
                total = matrix(own.column("embedding")).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([own.num_rows], pa.int64()), pa.array([total.tolist()])],
                    ["d", "n", "total"],
                )

    parts = vectors.select("d", "embedding").mapInArrow(sums, "d int, n long, total array<double>")
    means = (
        parts.select("d", "n", F.posexplode("total").alias("i", "x"))
        .groupBy("d", "i")
        .agg((F.sum("x") / F.sum("n")).alias("mean"))
        .groupBy("d")
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("means"))
    )
    return {r.d: np.array([m.mean for m in r.means]) for r in means.collect()}


def build_index(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, d, embedding, code, length, fit, centre_product) of all usable vectors, written once."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("d"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    centres = _centres(rows)

    def kernel(batches):
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                codes, length, fit = encode(matrix(own.column("embedding")), centres[int(d)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns,
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(length, pa.float64()),
                        pa.array(fit, pa.float64()),
                        pa.array(matrix(own.column("embedding")) @ centres[int(d)], pa.float64()),
                    ],
                    [*own.schema.names, "code", "length", "fit", "centre_product"],
                )

    schema = "row long, vec_id long, d int, embedding array<double>, code binary, length double, fit double, centre_product double"
    return staged(rows.mapInArrow(kernel, schema), "one-bit-index")


def _nearest(ids, exact, k):
    return np.lexsort((ids, -exact))[:k]


def search_block(q, x, k: int) -> list[tuple[int, int, float]]:
    """(query row, vector row number, score) of the ``k`` best of one block for each query."""
    codes, d = x["code"], x["embedding"].shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (q["embedding"] @ rotation(d)).astype(np.float32)
    reach = np.sqrt((q["embedding"] ** 2).sum(axis=1))
    scale = x["length"] / x["fit"]
    spread = x["length"] * np.sqrt(np.maximum(0, 1 - x["fit"] ** 2)) / x["fit"] * (BOUND / math.sqrt(max(d - 1, 1)))
    found = []
    for at in range(0, len(turned), 64):
        dots = turned[at : at + 64] @ signs.T / np.float32(math.sqrt(d))
        for i in range(len(dots)):
            n = at + i
            estimate = q["centre_product"][n] + dots[i] * scale
            estimate[x["row"] == q["row"][n]] = -np.inf
            first = np.argpartition(-estimate, k)[: k + 1] if len(estimate) > k + 1 else np.arange(len(estimate))
            exact = (x["embedding"][first] * q["embedding"][n]).sum(axis=1)
            exact = exact[x["row"][first] != q["row"][n]]
            worst = np.sort(exact)[-k] if len(exact) >= k else -np.inf
            upper = estimate + spread * reach[n]
            near = np.flatnonzero((upper >= worst) & (x["row"] != q["row"][n]))
            near = np.union1d(near, first[x["row"][first] != q["row"][n]])
            exact = (x["embedding"][near] * q["embedding"][n]).sum(axis=1)
            best = _nearest(x["vec_id"][near], exact, k)
            found += [(n, near[j], exact[j]) for j in best]
    return found


def _arrays(table: pa.Table, sides: np.ndarray, side: bool) -> dict[str, np.ndarray]:
    own = table.filter(pa.array(sides == side))
    made = {c: own[c].to_numpy() for c in ("row", "vec_id", "length", "fit", "centre_product")}
    whole = own["embedding"].combine_chunks()
    made["embedding"] = matrix(whole)
    made["code"] = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(own.num_rows, -1)
    return made


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query row."""
    index = build_index(vectors)
    marked = index.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    sizes = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_query").cast("int")), F.lit(0))).first()
    n_x, n_q = (max(1, math.ceil(n / b)) for n, b in zip(sizes, (BLOCK_VECTORS, BLOCK_QUERIES), strict=True))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    columns = ["row", "vec_id", "d", "embedding", "code", "length", "fit", "centre_product"]
    queries = marked.where("_query").select(*columns, F.lit(True).alias("query"), own(n_q, 1).alias("qb"), blocks(n_x).alias("xb"))
    others = marked.select(*columns, F.lit(False).alias("query"), blocks(n_q).alias("qb"), own(n_x, 2).alias("xb"))

    names = ["query_row", "query_id", "vec_id", "row"]
    empty = pa.table({**{c: pa.array([], pa.int64()) for c in names}, "score": pa.array([], pa.float64())})

    def kernel(table: pa.Table) -> pa.Table:
        sides = table["query"].to_numpy()
        if sides.all() or not sides.any():  # a block without queries or without vectors
            return empty
        q, x = _arrays(table, sides, True), _arrays(table, sides, False)
        found = search_block(q, x, k)
        n, j, score = (np.array(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
        return pa.table(
            {
                "query_row": pa.array(q["row"][n], pa.int64()),
                "query_id": pa.array(q["vec_id"][n], pa.int64()),
                "vec_id": pa.array(x["vec_id"][j], pa.int64()),
                "row": pa.array(x["row"][j], pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    best = queries.unionByName(others).groupBy("d", "qb", "xb").applyInArrow(
        kernel, "query_row long, query_id long, vec_id long, row long, score double"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
