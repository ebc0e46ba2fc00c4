"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles. The sketch throws all shingles into
``t`` bins in rounds: round i < t places each by hash, round t + j puts all into bin
j, and a bin keeps the smallest (round, hash). Every bin is filled after 2t rounds,
usually after one or two, and the number of equal bins of two sketches concentrates
around their similarity, so five standard deviations below the threshold is a safe
bound for leaving a pair out.

1. Equal sets become one class, so copies are never compared.
2. Bands of the sketch give buckets. Inside a bucket a search walks from document to
   document and takes what it reaches out of the pool, so a group of near copies costs
   about its size and yields one edge per document, never all pairs.
3. Connected buckets are clusters of similar sketches. Their texts are brought together
   once, and the same walk confirms each step on the full shingle sets.
4. Confirmed links give the components.

Buckets and clusters are divided into tiles of bounded size, dealt by tile and read
from sorted rows, so a task holds one tile at a time. For a cluster of several tiles the
tiles are walked alone, then one leader of every part, then the documents outside the
largest part against all tiles: nothing is left out. There sketches meet first, and
texts travel only for documents that have a similar sketch in the other tile.

Defined results: texts without words, null texts and rows with null id link with
nothing; rows with one id are one document; an empty table gives no rows; other
columns are ignored. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.staging import slices, staged, text_or_empty
from gondola.operators.components import components
from gondola.session import cut_lineage

#: Sketch values per band; the number of bands follows from the threshold.
BAND_VALUES = 5
#: Chance that banding misses a pair exactly at the threshold.
MISS = 1e-6
#: Standard deviations below the threshold from which on sketches rule a pair out.
SPREAD = 5.0
#: Documents in a tile of a bucket, shingles in a tile of a cluster.
BUCKET_TILE, CLUSTER_TILE = 8_192, 500_000

_U = np.uint64
_LOW = _U((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(x)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_LETTER[_SEPARATOR] = 0
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.full(1 << 14, 0x9E3779B97F4A7C15 | 5, _U))


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**BAND_VALUES))


def lowest_estimate(threshold: float) -> float:
    t = bands_for(threshold) * BAND_VALUES
    return threshold - SPREAD * math.sqrt(threshold * (1 - threshold) / t)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; one for a shorter text, none without words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SEPARATOR[data]
    if not inside.any():
        return np.empty(0, _U)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = _LETTER[data[starts[0] :]] * _POWER[at % len(_POWER)]
    sums = np.add.reduceat(values, starts - starts[0])
    lengths = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0]).astype(_U)
    each = _mix(sums + lengths * _U(0xD6E8FEB86659FD93))
    k = min(words, len(each))
    run = np.full(len(each) - k + 1, k, _U)
    for j in range(k):
        run = _mix(run * _U(0xC2B2AE3D27D4EB4F) + each[j : len(each) - k + 1 + j])
    return np.unique(run)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """``t`` bins of (round, hash) minima; further rounds never change a filled bin."""
    bins = np.full(t, np.iinfo(_U).max, _U)
    done = 0
    together = max(1, min(t, math.ceil(2 * t * math.log(t + 1) / len(items))))
    while done < t:
        rounds = np.arange(done, min(t, done + together), dtype=_U)
        hashes = _mix(items[None, :] ^ _mix(rounds + _U(0x51ED270B27D4EB4F))[:, None])
        where = ((hashes >> _U(40)) * _U(t)) >> _U(24)
        np.minimum.at(bins, where.ravel().astype(np.intp), ((rounds << _U(40))[:, None] | (hashes & _LOW)).ravel())
        done += together
        if (bins != np.iinfo(_U).max).all():
            return bins
    for j in np.flatnonzero(bins == np.iinfo(_U).max):
        i = _U(t + j)
        bins[j] = (_mix(items ^ _mix(i + _U(0x51ED270B27D4EB4F))) & _LOW).min() | (i << _U(40))
    return bins


def _band_keys(bins: np.ndarray) -> np.ndarray:
    rows = bins.reshape(-1, BAND_VALUES)
    key = np.arange(len(rows), dtype=_U)
    for j in range(BAND_VALUES):
        key = _mix(key * _U(0xC2B2AE3D27D4EB4F) + rows[:, j])
    return key.view(np.int64)


def _sketch_kernel(words: int, bands: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, sketches, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text, words)
                n.append(len(items))
                if len(items):
                    bins = sketch(items, bands * BAND_VALUES)
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    sketches.append((_mix(bins) & _U(255)).astype(np.uint8).tobytes())
                    keys.append(_band_keys(bins))
                else:
                    digests.append(None)
                    sketches.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n", "digest", "sketch", "bands"],
            )

    return kernel


def walk(ids, sizes, sketches, percent: int, lowest: float, sets=None, part=None) -> list[tuple[int, int]]:
    """Edges of a search over similar documents; reached ones leave the pool.

    With ``sets`` each step is confirmed exactly. Documents of one ``part`` count as
    linked already: reaching one reaches all, and no edge is given inside a part.
    """
    m = len(ids)
    edges: list[tuple[int, int]] = []
    pool = np.arange(m)
    wide = sketches.shape[1]
    order = list(np.argsort(-sizes, kind="stable"))
    waiting = np.ones(m, bool)
    while len(pool) and order:
        start = order.pop()
        if not waiting[start]:
            continue
        stack = [start] if part is None else list(pool[part[pool] == part[start]])
        waiting[stack] = False
        pool = pool[waiting[pool]]
        while stack and len(pool):
            x = stack.pop()
            low, high = np.minimum(sizes[pool], sizes[x]), np.maximum(sizes[pool], sizes[x])
            near = pool[100 * low >= percent * high]
            near = near[(sketches[near] == sketches[x]).sum(axis=1) >= lowest * wide]
            if sets is not None and len(near):
                near = near[_similar(sets, x, near, percent)]
            if not len(near):
                continue
            edges += [(ids[x], ids[y]) for y in near if ids[x] != ids[y]]
            if part is not None:
                near = pool[np.isin(part[pool], part[near])]
            waiting[near] = False
            stack += list(near)
            pool = pool[waiting[pool]]
    return edges


def _similar(sets, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` reach the threshold with ``x`` on full sets."""
    mine = sets[x]
    sizes = np.array([len(sets[y]) for y in others])
    every = np.concatenate([sets[y] for y in others])
    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    common = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (sizes + len(mine) - common)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of ``g``, which follow one another across batches."""
    waiting: list[pa.RecordBatch] = []
    current = None
    for batch in slices(batches):
        keys = batch.column("g").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if keys[a] != current and waiting:
                yield pa.Table.from_batches(waiting)
                waiting = []
            current = keys[a]
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _sketches(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8)
    return group.column("id").to_numpy(), group.column("n").to_numpy(), sketches.reshape(group.num_rows, -1)


def _walk_kernel(percent: int, lowest: float, words: int | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids, sizes, sketches = _sketches(group)
            sets = part = None
            if words is not None:
                sets = [shingles(t, words) for t in group.column("text").to_pylist()]
                part = group.column("part").to_numpy()
            found = walk(ids, sizes, sketches, percent, lowest, sets, part)
            if found:
                src, dst = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return kernel


def _similar_kernel(percent: int, lowest: float):
    """Of a pair of tiles (side 0 and 1): documents with a similar sketch of another part on the other side."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, sizes, sketches = _sketches(group)
            part, side = group.column("part").to_numpy(), group.column("side").to_numpy()
            others, met = np.flatnonzero(side == 1), np.zeros(len(ids), bool)
            for x in np.flatnonzero(side == 0):
                low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
                near = others[(100 * low >= percent * high) & (part[others] != part[x])]
                near = near[(sketches[near] == sketches[x]).sum(axis=1) >= lowest * sketches.shape[1]]
                met[near] = True
                met[x] |= len(near) > 0
            if met.any():
                yield pa.RecordBatch.from_arrays(
                    [group.column(c).combine_chunks().filter(pa.array(met)) for c in ("g", "id", "key")], ["g", "id", "key"]
                )

    return kernel


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one ``g`` next to each other in one partition."""
    return rows.select("g", *columns).repartition("g").sortWithinPartitions("g")


def _edges(rows: DataFrame, percent: int, lowest: float, words: int | None = None) -> DataFrame:
    columns = ["id", "n", "sketch"] if words is None else ["id", "n", "sketch", "text", "part"]
    return _dealt(rows, columns).mapInArrow(_walk_kernel(percent, lowest, words), "src long, dst long")


def _bucket_edges(classes: DataFrame, percent: int, lowest: float) -> DataFrame:
    """Edges between documents that share a bucket and have similar sketches."""
    placed = classes.select("id", "key", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tiles = F.ceil(F.col("_n") / BUCKET_TILE).cast("int")
    members = (
        placed.join(shared, "band")
        .select("band", "id", "key", tiles.alias("_tiles"), F.pmod(F.xxhash64("id", "key"), tiles).cast("int").alias("tile"))
        .join(classes.select("id", "key", "n", "sketch"), ["id", "key"])
    )
    # A tile of a large bucket meets each other tile: a row goes to the pairs its tile is part of.
    every = F.sequence(F.lit(0), F.col("_tiles") - 1)
    pair = F.transform(every, lambda t: F.xxhash64("band", F.least("tile", t), F.greatest("tile", t)))
    return _edges(members.withColumn("g", F.explode(pair)), percent, lowest)


def _labels(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in ``edges``."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return components(nodes, edges, "id")


def _tiled(members: DataFrame) -> DataFrame:
    """``members`` with the tile of their cluster and the number of its tiles."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / CLUSTER_TILE).cast("int").alias("_tiles"))
    tile = F.pmod(F.xxhash64("id", "key"), F.col("_tiles")).cast("int")
    return members.join(sizes, "root").withColumn("tile", tile)


def _confirmed(members: DataFrame, texts: DataFrame, percent: int, lowest: float, words: int) -> DataFrame:
    """Exact links that connect the documents of each cluster; members (root, id, key, n, sketch), texts (id, key, text)."""
    walked = lambda rows: _edges(texts.join(rows, ["id", "key"]), percent, lowest, words)
    in_tile = F.xxhash64("root", "tile")
    alone = _tiled(members).withColumns({"part": F.xxhash64("id", "key"), "g": in_tile})
    edges = cut_lineage(walked(alone))
    sizes = members.groupBy("root").agg(F.sum("n").alias("_n")).where(F.col("_n") > CLUSTER_TILE)
    large = cut_lineage(members.join(sizes.select("root"), "root", "left_semi"))
    if large.isEmpty():
        return edges
    # One leader of every part inside a tile, then all documents outside the largest part against all tiles.
    for leaders in (True, False):
        labels = _labels(edges).select("id", F.col("root").alias("_part"))
        parted = large.join(labels, "id", "left").withColumn("part", F.coalesce("_part", "id")).drop("_part")
        parts = parted.groupBy("root", "part").agg(
            F.count(F.lit(1)).alias("_size"), F.min(F.struct("id", "key")).alias("_lead")
        )
        if leaders:
            heads = parts.select("root", "part", F.col("_lead.id").alias("id"), F.col("_lead.key").alias("key"))
            led = _tiled(parted.join(heads, ["root", "part", "id", "key"], "left_semi"))
            more = walked(led.withColumn("g", in_tile))
        else:
            more = walked(_across(parted, parts, percent, lowest))
        edges = cut_lineage(edges.unionByName(more))
    return edges


def _across(parted: DataFrame, parts: DataFrame, percent: int, lowest: float) -> DataFrame:
    """Documents by pair of tiles ``g`` that may link: those outside of a cluster's largest part against all."""
    largest = parts.groupBy("root").agg(F.max_by("part", F.struct("_size", "part")).alias("_main"))
    rest = cut_lineage(_tiled(parted.join(largest, "root").where(F.col("part") != F.col("_main")).drop("_main")))
    every = cut_lineage(_tiled(parted))
    count = lambda df: df.groupBy("root").agg(F.first("_tiles").alias("_others"))
    to_all = lambda df, others: df.join(count(others), "root").withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_others") - 1))
    )
    left = to_all(rest, every).withColumns({"g": F.xxhash64("root", "tile", "_other"), "side": F.lit(0)})
    right = to_all(every, rest).withColumns({"g": F.xxhash64("root", "_other", "tile"), "side": F.lit(1)})
    columns = ["id", "key", "n", "sketch", "part", "side"]
    both = left.select("g", *columns).unionByName(right.select("g", *columns))
    met = _dealt(both, columns).mapInArrow(_similar_kernel(percent, lowest), "g long, id long, key long")
    return met.distinct().join(parted.select("id", "key", "n", "sketch", "part"), ["id", "key"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept): one row per row of ``docs``.

    Links have ``100 * intersection >= percent * union``; key is the hash of the text.
    """
    lowest = lowest_estimate(percent / 100)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text")
    )
    sketched = staged(
        rows.mapInArrow(
            _sketch_kernel(words, bands_for(percent / 100)),
            "doc_id long, key long, n long, digest binary, sketch binary, bands array<long>",
        ),
        "sketches",
    )
    linkable = sketched.where("doc_id is not null and digest is not null")
    classes = staged(
        linkable.groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "key")).alias("_rep"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
            F.first("bands").alias("bands"),
        )
        .select("digest", F.col("_rep.doc_id").alias("id"), F.col("_rep.key").alias("key"), "n", "sketch", "bands"),
        "shingle-classes",
    )
    similar = cut_lineage(_bucket_edges(classes, percent, lowest).distinct())
    clusters = cut_lineage(_labels(similar).join(classes.select("id", "key", "n", "sketch"), "id"))
    # All texts are shuffled once; the walks read those of clusters only, which are a part of them.
    named = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), "key", "text")
    clustered = named.join(clusters.select("id", "key").hint("merge"), ["id", "key"], "left_semi")
    texts = staged(clustered.dropDuplicates(["id", "key"]), "cluster-texts")
    links = _confirmed(clusters, texts, percent, lowest, words)
    found = _labels(links)
    per_class = classes.select("digest", "id").join(found, "id", "left").select(
        "digest", F.coalesce("root", "id").alias("_component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return sketched.select("doc_id", "key", "n", "digest").join(per_class, "digest", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies; repeated rows stay once.

    Columns may have any names and types; map values are compared by their JSON.
    """
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    place = {c: x for c, x in zip(docs.columns, inner, strict=True)}
    named = docs.toDF(*inner)
    core = named.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"))
    kept = near_duplicates(core, words, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    key = F.xxhash64(text_or_empty(place["text"]))
    same = F.col("_id").eqNullSafe(F.col(place["doc_id"]).cast("long")) & (F.col("_key") == key)
    maps = {f"_m{x}": F.to_json(F.struct(x)) for x in inner if "map<" in named.schema[x].dataType.simpleString()}
    plain = [x for x in inner if f"_m{x}" not in maps]
    left = named.join(kept.distinct(), same, "left_semi").withColumns(maps).dropDuplicates([*plain, *maps])
    return left.select(*inner).toDF(*docs.columns)
