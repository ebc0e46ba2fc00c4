"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from the leaves of random-hyperplane trees and is refined by
joining neighbours of neighbours: around every vector its neighbours in both directions
meet and improve each other's lists. A list whose last entry still reaches the threshold
is saturated and is enlarged for the next round. The descent ends when a round finds no
new link, or after ``ROUNDS``.
Its components say which vectors share a tile. Then all tiles of a label meet that their
centres and radii do not keep apart: this counts the links of every vector exactly and
joins components that links lead across, so results never depend on the length of a
list and no pair is written.

Equal vectors of a label are one point with a weight. Leaves, neighbourhoods and
clusters are divided by hash into pieces of bounded size, so a label, a hub or a group
of near copies may hold any share of the rows.

Defined results: a null label, and vectors that are null, zero or not finite, link with
nothing; vectors of different length never link; a row with null id links with nothing
and is kept; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.staging import staged
from gondola.llm.vectors import matrix, units, usable
from gondola.operators.components import components
from gondola.session import cut_lineage

TREES, LEAF, NEIGHBOURS, LONGEST = 6, 64, 8, 64
ROUNDS = 4
#: Members of a neighbourhood and of a tile of a cluster that meet in one task.
MEETING, TILE = 64, 1_024
SEED = 93

_LISTS = "id long, found array<struct<sim:double,id:long>>"


def _top(ids: np.ndarray, sims: np.ndarray, least: np.ndarray, k: int):
    """Per row the up to ``k`` largest similarities above ``least``: (positions, values)."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(sims, at, axis=1)
    good = values > least[:, None]
    return ids[at], values, good


def _meeting_kernel(k: int):
    """All members of a row meet; each keeps the best others it did not have."""

    def kernel(batches):
        for batch in batches:
            owners, found_ids, found_sims, counts = [], [], [], []
            for i in range(batch.num_rows):
                members = batch.column("members").slice(i, 1).flatten()
                ids = members.field("id").to_numpy()
                if len(ids) < 2:
                    continue
                u = units(matrix(members.field("embedding")))
                sims = u @ u.T
                np.fill_diagonal(sims, -2)
                near, values, good = _top(ids, sims, members.field("least").to_numpy(), k)
                some = good.any(axis=1)
                owners.append(ids[some])
                counts.append(good[some].sum(axis=1))
                found_ids.append(near[some][good[some]])
                found_sims.append(values[some][good[some]])
            if owners:
                yield _list_batch(*(np.concatenate(x) for x in (owners, counts, found_ids, found_sims)))

    return kernel


def _list_batch(owners, counts, ids, sims) -> pa.RecordBatch:
    pairs = pa.StructArray.from_arrays([pa.array(sims, pa.float64()), pa.array(ids, pa.int64())], ["sim", "id"])
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pairs)
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), lists], ["id", "found"])


def _best(lists: DataFrame, k: Column) -> DataFrame:
    """(id, found): the ``k`` best distinct neighbours per id; pre-merged over salts, as a hub may get very many."""
    order = lambda c, n: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))), asc=False), 1, n)
    salted = lists.groupBy("id", F.pmod(F.xxhash64("found"), F.lit(8)).alias("_salt")).agg(
        order("found", LONGEST).alias("found")
    )
    merged = salted.groupBy("id").agg(order("found", LONGEST).alias("found"))
    return merged.select("id", F.slice("found", 1, k).alias("found"))


def _leaves(points: DataFrame) -> DataFrame:
    """(cell columns, id, embedding): the leaf of every point in every tree."""
    sizes = points.groupBy("label", "d").agg(
        F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / LEAF))).cast("int").alias("bits")
    )

    def kernel(batches):
        for batch in batches:
            dims = batch.column("d").to_numpy()
            codes = np.zeros((batch.num_rows, TREES), np.int64)
            bits = batch.column("bits").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = matrix(batch.column("embedding").take(pa.array(own)))
                planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), TREES * 32))
                sides = (x @ planes > 0).reshape(len(own), TREES, 32)
                used = np.arange(32)[None, :] < bits[own][:, None]
                codes[own] = ((sides & used[:, None, :]) << np.arange(32)).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("label", "d", "id", "embedding")],
                    pa.array(codes.tolist(), pa.list_(pa.int64())),
                ],
                ["label", "d", "id", "embedding", "codes"],
            )

    coded = points.join(sizes, ["label", "d"]).select("label", "d", "id", "embedding", "bits").mapInArrow(
        kernel, "label long, d int, id long, embedding array<double>, codes array<long>"
    )
    placed = coded.select("label", "d", "id", "embedding", F.posexplode("codes").alias("tree", "code"))
    return _bounded(placed, ["label", "d", "tree", "code"], 2 * LEAF)


def _bounded(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Members of each key in lists of about ``size``, divided by hash; keys with one row are left out."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / size).cast("int")
    least = F.col("least") if "least" in rows.columns else F.lit(-2.0)
    return (
        rows.join(counts, keys)
        .withColumn("_part", F.pmod(F.xxhash64("id", *keys), parts))
        .groupBy(*keys, "_part")
        .agg(F.collect_list(F.struct("id", "embedding", least.alias("least"))).alias("members"))
    )


def _meet(groups: DataFrame) -> DataFrame:
    return groups.select("members").mapInArrow(_meeting_kernel(NEIGHBOURS), _LISTS)


def _descend(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """One round: neighbours of neighbours meet, saturated lists grow."""
    forward = graph.select(F.col("id").alias("hub"), F.explode("found.id").alias("id"))
    backward = forward.select(F.col("id").alias("hub"), F.col("hub").alias("id"))
    itself = graph.select(F.col("id").alias("hub"), "id")
    around = forward.unionByName(backward).unionByName(itself).distinct()
    least = graph.select(
        "id", F.when(F.size("found") >= F.col("k"), F.element_at("found", -1)["sim"]).otherwise(F.lit(-2.0)).alias("least")
    )
    known = points.select("id", "embedding").join(least, "id")
    better = _meet(_bounded(around.join(known, "id"), ["hub"], MEETING))
    last = F.element_at("found", -1)["sim"]
    grown = graph.select(
        "id",
        F.when((F.size("found") >= F.col("k")) & (last >= threshold), F.least(2 * F.col("k"), F.lit(LONGEST)))
        .otherwise(F.col("k"))
        .alias("k"),
    )
    every = graph.select("id", "found").unionByName(better)
    merged = _best(every, F.lit(LONGEST)).join(grown, "id")
    return merged.select("id", "k", F.slice("found", 1, F.col("k")).alias("found"))


def neighbour_graph(points: DataFrame, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """(id, k, found). Ends when a round finds no new link, or after ``rounds``; the tiles find what is left."""
    start = _best(_meet(_leaves(points)), F.lit(NEIGHBOURS))
    none = F.array().cast("array<struct<sim:double,id:long>>")
    graph = cut_lineage(
        points.select("id").join(start, "id", "left").select(
            "id", F.lit(NEIGHBOURS).alias("k"), F.coalesce("found", none).alias("found")
        )
    )
    links = _edges(graph, threshold).count()
    for _ in range(rounds):
        graph = cut_lineage(_descend(graph, points, threshold))
        before, links = links, _edges(graph, threshold).count()
        if links == before:
            break
    return graph


def _edges(graph: DataFrame, threshold: float) -> DataFrame:
    near = graph.select("id", F.explode(F.filter("found", lambda x: x["sim"] >= threshold)).alias("x"))
    return near.select(F.col("id").alias("src"), F.col("x.id").alias("dst"))


def _roots(edges: DataFrame) -> DataFrame:
    edges = cut_lineage(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return cut_lineage(components(nodes, edges, "id"))


def _bounds_kernel(batches):
    """The unit mean of every tile and the largest angle of a member to it."""
    for batch in batches:
        centres, radii = [], []
        for i in range(batch.num_rows):
            u = units(matrix(batch.column("members").slice(i, 1).flatten().field("embedding")))
            mean = u.sum(axis=0)
            centre = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else u[0]
            centres.append(centre)
            radii.append(float(np.arccos(np.clip(u @ centre, -1, 1)).max()))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("label", "d", "tile")],
                pa.array([c.tolist() for c in centres], pa.list_(pa.float64())),
                pa.array(radii, pa.float64()),
            ],
            ["label", "d", "tile", "centre", "radius"],
        )


def _bridges(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots that join what ``near`` joins: at most as many as rows and columns."""
    near = near & (left[:, None] != right[None, :])
    _, first, at = np.unique(right, return_index=True, return_inverse=True)
    group = first[at]
    pairs: list[tuple[int, int]] = []
    for row in np.flatnonzero(near.any(axis=1)):
        met = np.unique(group[near[row]])
        pairs += [(left[row], right[x]) for x in met]
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    src, dst = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0).T
    return src, dst


def _pair_kernel(threshold: float):
    """Per pair of tiles (id, n, null): links of each point, and (root, 0, other root): roots that links join."""

    def kernel(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c).slice(i, 1).flatten() for c in ("members", "more"))
                left, right = units(matrix(a.field("embedding"))), units(matrix(b.field("embedding")))
                ids_a, ids_b = a.field("id").to_numpy(), b.field("id").to_numpy()
                near = (left @ right.T >= threshold) & (ids_a[:, None] != ids_b[None, :])
                if not near.any():
                    continue
                names, counts = [ids_a], [near @ b.field("copies").to_numpy()]
                if not batch.column("same")[i].as_py():
                    counts.append(a.field("copies").to_numpy() @ near)
                    names.append(ids_b)
                name, n = np.concatenate(names), np.concatenate(counts)
                src, dst = _bridges(near, a.field("root").to_numpy(), b.field("root").to_numpy())
                name, n = name[n > 0], n[n > 0]
                other = pa.array(np.append(np.zeros_like(name), dst), pa.int64(), mask=np.arange(len(n) + len(dst)) < len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(name, src), pa.int64()), pa.array(np.append(n, np.zeros_like(src)), pa.int64()), other],
                    ["id", "n", "other"],
                )

    return kernel


def _tiles(points: DataFrame) -> DataFrame:
    """(label, d, tile, members): points of a label in tiles; a large component has tiles of its own, so these are narrow."""
    large = points.groupBy("label", "d", "root").count().where(F.col("count") >= TILE // 4).drop("count")
    own = F.coalesce("_large", F.lit(False))
    seated = (
        points.join(large.withColumn("_large", F.lit(True)), ["label", "d", "root"], "left")
        .withColumn("_large", own)
        .withColumn("_seat", F.when(F.col("_large"), F.col("root")).otherwise(F.lit(0)))
    )
    keys = ["label", "d", "_large", "_seat"]
    sizes = seated.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_tiles"))
    return cut_lineage(
        seated.join(sizes, keys)
        .withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")))
        .groupBy(*keys, "_tile")
        .agg(F.collect_list(F.struct("id", "embedding", "copies", "root")).alias("members"))
        .select("label", "d", F.monotonically_increasing_id().alias("tile"), "members")
    )


def links_of_tiles(points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links within each label, whatever the descent found: (id, n) and (src, dst) between roots.

    ``points`` is (label, d, id, embedding, copies, root). All tiles of a label meet, but
    for pairs whose centres lie further apart than both radii and the angle of the
    threshold. No pair of points is written: a task returns the weighted number of links
    of each point and the pairs of roots that join what its links join.
    """
    tiles = _tiles(points)
    bounds = cut_lineage(
        tiles.mapInArrow(_bounds_kernel, "label long, d int, tile long, centre array<double>, radius double")
    )
    right = bounds.select("label", "d", *[F.col(c).alias(f"_{c}") for c in ("tile", "centre", "radius")])
    cosine = F.aggregate(F.zip_with("centre", "_centre", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.col("radius") + F.col("_radius") + math.acos(threshold) + 1e-6
    pairs = cut_lineage(
        bounds.join(right, ["label", "d"])
        .where((F.col("tile") == F.col("_tile")) | ((F.col("tile") < F.col("_tile")) & (angle <= reach)))
        .select("tile", "_tile", (F.col("tile") == F.col("_tile")).alias("same"))
    )
    more = tiles.select(F.col("tile").alias("_tile"), F.col("members").alias("more"))
    meetings = pairs.join(tiles.select("tile", "members"), "tile").join(more, "_tile").select("members", "more", "same")
    met = cut_lineage(meetings.mapInArrow(_pair_kernel(threshold), "id long, n long, other long"))
    counts = met.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    return counts, met.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    takes_part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    points = staged(
        rows.where(takes_part)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("d", F.size("embedding")),
        "vector-points",
    )
    graph = neighbour_graph(points, threshold)
    roots = _roots(_edges(graph, threshold))
    rooted = points.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    counts, bridges = links_of_tiles(rooted, threshold)
    wider = _roots(bridges).select(F.col("id").alias("root"), F.col("root").alias("_wider"))
    per_point = (
        rooted.join(wider, "root", "left")
        .join(counts, "id", "left")
        .select(
            "label",
            F.col("embedding").alias("embedding"),
            F.coalesce("_wider", "root").alias("_root"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("_links"),
        )
    )
    joined = rows.withColumn("_takes", takes_part).join(per_point, ["label", "embedding"], "left")
    component = F.when(F.col("_takes"), F.col("_root")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("_takes"), F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
