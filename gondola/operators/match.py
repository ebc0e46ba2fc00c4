"""Matching gold families against the catalogue: brand, family, listing, variation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.similarity import EDIT_WEIGHT, WORD_WEIGHT, jaccard, mixed_of_processed, processed
from gondola.functions.text import get_words
from gondola.functions.vectors import l2_normalize, norm, vector_key, vector_literal
from gondola.operators import tiles as X
from gondola.operators.numbering import number_rows
from gondola.session import cut_lineage, forget

# Brands and listing slugs of one block key that meet in one cell of its grid.
_CHUNK, _SLUG_CHUNK = 4096, 65_536
# Principal axes whose cells order the vectors of a block before they are cut into tiles.
_AXES = 4
# Nearest tiles a tile meets in the first round, and how many times more after each round.
_FIRST, _MORE = 1, 4


def _block_keys(p: Column, threshold: float) -> Column:
    """Keys of which any two slugs scoring at least ``threshold`` share one.

    Either they share a word, or the edit part alone reaches the threshold. Then
    at most ``loss`` of the longer text is edited: with a loss up to one sixth
    two texts of six or more characters share three in a row, and shorter ones
    are equal; with a larger loss they still share a character.
    """
    words = F.transform(p["words"], lambda w: F.concat(F.lit("w:"), w))
    keys = [words, F.array(F.concat(F.lit("="), p["text"]))]
    loss = 1 - threshold / (100 * EDIT_WEIGHT)
    if loss > 0:
        size = 3 if loss <= 1 / 6 + 1e-9 else 1
        starts = F.sequence(F.lit(1), F.greatest(F.length(p["text"]) - size + 1, F.lit(1)))
        keys.append(F.transform(starts, lambda i: F.concat(F.lit("g:"), F.substr(p["text"], i, F.lit(size)))))
    return F.array_distinct(F.concat(*keys))


def match_brand(listings: DataFrame, brands: DataFrame, threshold: float = 50.0) -> DataFrame:
    """(slug, brand_id, score) for every distinct listing slug that has a brand.

    Equal slugs first; the others take the brand with the best mixed score, the
    lowest id on a tie, if it reaches ``threshold``. Candidates come from an
    equi-join on block keys; a pair that shares several keys is scored at the
    smallest of them only. A key that many share is a grid of cells of bounded
    size on both sides, and only the best candidate per slug leaves each task.

    Below a threshold of 50 the edit part can reach it with a single shared
    character, so nearly all brands are candidates of each slug.
    """
    slugs = listings.select("slug").where("slug is not null").distinct()
    known = brands.select("brand_id", "slug").where("slug is not null")
    by_slug = known.groupBy("slug").agg(F.min("brand_id").alias("brand_id"))
    exact = slugs.join(by_slug, "slug").select("slug", "brand_id", F.lit(100.0).alias("score"))
    rest = slugs.join(by_slug, "slug", "left_anti").where("slug <> ''").withColumn("a", processed(F.col("slug")))
    named = known.where("slug <> ''").select("brand_id", processed(F.col("slug")).alias("b"))

    left = rest.select("slug", "a", F.explode(_block_keys(F.col("a"), threshold)).alias("key"))
    right = named.select("brand_id", "b", F.explode(_block_keys(F.col("b"), threshold)).alias("key"))

    def cells(side: DataFrame, size: int, name: str) -> DataFrame:
        return side.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    grid = cells(left, _SLUG_CHUNK, "_rows").join(cells(right, _CHUNK, "_columns"), "key")
    own = lambda c, n: F.pmod(F.hash(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid, "key").select("slug", "a", "key", own("slug", "_rows").alias("row"), every("_columns").alias("column"))
    right = right.join(grid, "key").select("brand_id", "b", "key", own("brand_id", "_columns").alias("column"), every("_rows").alias("row"))
    shared = F.array_intersect(_block_keys(F.col("a"), threshold), _block_keys(F.col("b"), threshold))
    shorter = F.least(F.length("a.text"), F.length("b.text"))
    longer = F.nullif(F.greatest(F.length("a.text"), F.length("b.text")), F.lit(0))
    bound = 100 * (
        EDIT_WEIGHT * F.coalesce(shorter / longer, F.lit(1.0))
        + WORD_WEIGHT * jaccard(F.col("a.words"), F.col("b.words"))
    )
    scored = (
        left.join(right, ["key", "row", "column"])
        .where(bound >= threshold - 1e-6)
        .where(F.array_min(shared) == F.col("key"))
        .select("slug", "brand_id", mixed_of_processed(F.col("a"), F.col("b")).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = scored.groupBy("slug").agg(
        F.max_by(F.struct("brand_id", "score"), F.struct(F.round("score", 9), -F.col("brand_id"))).alias("m")
    )
    return exact.unionByName(best.select("slug", "m.brand_id", "m.score"))


def prefix_filter(name: Column, word: Column) -> Column:
    """Name begins with the word, case-sensitive."""
    return name.startswith(word)


def number_names(names: DataFrame, group: list[str]) -> DataFrame:
    """Distinct (group.., name) plus ``number``: their place in the order of group and name's bytes."""
    known = names.select(*group, "name").na.drop().distinct().withColumn("_key", F.col("name").cast("binary"))
    return number_rows(known, [*group, "_key"], "number").drop("_key")


def prefix_intervals(numbered: DataFrame, words: DataFrame, group: list[str]) -> DataFrame:
    """(group.., word, first, last): the numbers of the names that begin with each word.

    Names that share a beginning are neighbours in the order of ``number_names``, so a
    word needs one interval and no row per name. A mark before the word and one behind
    all its extensions are sorted in among the names; the names ahead of a mark are its
    number among all rows less its number among the marks. Any word will do, the empty
    one has all names of its group; words that begin no name and null ones have no row.
    """
    asked = words.select(*group, "word").na.drop().distinct()
    start = F.col("word").cast("binary")
    # No byte of UTF-8 is FF, so the second mark lies behind every name that begins with the word.
    ends = F.array(start, F.concat(start, F.lit(b"\xff")))
    marks = cut_lineage(asked.withColumn("_key", F.explode(ends)).withColumn("_kind", F.lit(0)))
    rows = numbered.select(*group, F.lit(None).cast("string").alias("word"), F.col("name").cast("binary").alias("_key"), F.lit(1).alias("_kind"))
    order = [*group, "_key", "_kind"]
    among_all = number_rows(marks.unionByName(rows), order, "_all").where("_kind = 0").drop("_kind")
    among_marks = number_rows(marks, order, "_own").drop("_kind", "word")
    ahead = among_all.join(among_marks, [*group, "_key"]).withColumn("_ahead", F.col("_all") - F.col("_own"))
    found = ahead.groupBy(*group, "word").agg(F.min("_ahead").alias("first"), (F.max("_ahead") - 1).alias("last"))
    return found.where("first <= last")


def prefix_pairs(numbered: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """(group.., word, name): the intervals written out, for those who want every pair."""
    blocks = intervals.withColumn("_from", F.explode(F.sequence("first", "last", F.lit(_CHUNK).cast("long"))))
    numbers = F.sequence("_from", F.least(F.col("_from") + _CHUNK - 1, F.col("last")))
    return blocks.select(*group, "word", F.explode(numbers).alias("number")).join(numbered.select("number", "name"), "number").drop("number")


def _prefixes(name: Column) -> Column:
    """Every beginning of the leading run that a first word can consist of."""
    run = F.regexp_extract(name, r"^\{*[a-zA-ZÀ-ÿ0-9]*", 0)
    return F.when(run != "", F.transform(F.sequence(F.lit(1), F.length(run)), lambda n: F.substr(run, F.lit(1), n)))


def _in_cells(sides: list[DataFrame], axes_of: DataFrame, width: float) -> tuple[list[DataFrame], list[str]]:
    """The sides with their cells along the principal axes of ``axes_of``, and the columns to sort by.

    Neighbours in that order are near each other, so tiles cut from it are tight.
    """
    dims = axes_of.select(F.size("unit")).first()
    if dims is None or axes_of.limit(2).count() < 2:
        return [df.withColumn("_p", F.get("unit", F.lit(0))) for df in sides], ["_p"]
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    count = min(_AXES, dims[0])
    typed = lambda df: df.withColumn("_vector", array_to_vector("unit"))
    model = PCA(k=count, inputCol="_vector", outputCol="_projected").fit(typed(axes_of))
    names = [f"_c{i}" for i in range(count)]

    def placed(df: DataFrame) -> DataFrame:
        on_axes = model.transform(typed(df)).withColumn("_axes", vector_to_array("_projected"))
        cells = [F.floor(F.get("_axes", F.lit(i)) / width).cast("int").alias(c) for i, c in enumerate(names)]
        return on_axes.select(*df.columns, *cells, F.get("_axes", F.lit(0)).alias("_p"))

    return [placed(df) for df in sides], [*names, "_p"]


def _best_first(left: DataFrame, right: DataFrame, block: list[str], similarity: float) -> DataFrame:
    """(rep, family_id, similarity): the best family of every listing that has one.

    Tiles meet nearest first. After each round a tile whose listings all have a family
    drops the tiles that lie farther than its worst match so far; when none is left,
    what was found is the best, as no closer vector was passed over.
    """
    reach = lambda worst: F.sqrt(2 * F.greatest(1 - worst + 2e-9, F.lit(0.0))) + 1e-9
    low = similarity - 1e-12

    def kernel(a: dict, b: dict) -> pd.DataFrame:
        score = np.round(a["x"] @ b["x"].T, 9)
        best = score.max(axis=1)
        first = np.where(score == best[:, None], b["ids"][None, :], np.iinfo(np.int64).max).min(axis=1)
        hit = best >= low
        return pd.DataFrame({"tile": a["tile"], "rep": a["ids"][hit], "family_id": first[hit], "similarity": best[hit]})

    widest = math.sqrt(max(0.0, 2 * (1 - similarity)))
    nearest = Window.partitionBy("left_tile").orderBy("near", "right_tile")
    met = X.pair(X.describe(left, *block), X.describe(right, *block), block, widest, measured=True)
    waiting = cut_lineage(met.select("left_tile", "right_tile", "gap", F.row_number().over(nearest).alias("place")))
    sizes = left.select(F.col("tile_id").alias("tile"), "n")
    found, upto = None, _FIRST
    while found is None or not waiting.isEmpty():
        now = waiting.where(F.col("place") <= upto).select("left_tile", "right_tile")
        hits = X.compare(now, left, right, kernel, "tile long, rep long, family_id long, similarity double")
        earlier, behind = found, waiting
        known = hits if earlier is None else hits.unionByName(earlier)
        best = F.max_by(F.struct("family_id", "similarity"), F.struct("similarity", -F.col("family_id"))).alias("m")
        found = cut_lineage(known.groupBy("tile", "rep").agg(best).select("tile", "rep", "m.*"))
        worst = found.groupBy("tile").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("matched"))
        settled = worst.join(sizes, "tile").where("matched = n").select(F.col("tile").alias("left_tile"), "worst")
        later = waiting.where(F.col("place") > upto).join(settled, "left_tile", "left")
        still = F.col("worst").isNull() | (F.col("gap") <= reach(F.col("worst")))
        waiting = cut_lineage(later.where(still).select("left_tile", "right_tile", "gap", "place"))
        forget(hits, earlier, behind)
        upto *= _MORE
    forget(waiting)
    return found.drop("tile")


def match_family(
    listings: DataFrame, families: DataFrame, similarity: float = 0.9, id_col: str = "gold_id", vectors: DataFrame | None = None
) -> DataFrame:
    """(id, family_id, similarity): nearest family of the same brand whose name
    begins with the listing's first word, if it is similar enough.

    ``listings`` has id, brand_id, name, embedded_name. Both vectors are rounded
    as stored. Equal (brand, word, vector) rows are matched once. Blocks are
    searched tile by tile, nearest first, so one brand may hold any share of the rows.

    Listings travel with the key of their vector, a vector once per different one. With
    ``vectors`` (key, embedded_name) listings have the key (``vector_key``) and no vector.
    """
    rounded = l2_normalize(vector_literal(F.col("embedded_name")))
    key = ["_v1", "_v2"]
    if vectors is None:
        listings = listings.withColumns(vector_key(F.col("embedded_name")))
        vectors = listings
    asked = listings.select(
        F.col(id_col).cast("long").alias("id"), "brand_id", F.get(get_words(F.col("name")), F.lit(0)).alias("word"), *key
    ).where("word is not null and brand_id is not null")
    copies = asked.groupBy("brand_id", "word", *key).agg(F.min("id").alias("rep"))
    # Few files may hold many vectors: no broadcast by the size of files.
    held = copies.join(vectors.select(*key, "embedded_name").distinct().hint("merge"), key)
    unique = cut_lineage(held.withColumn("unit", rounded).drop("embedded_name"))
    blocks = unique.select("brand_id", "word").distinct()
    offered = (
        families.select("family_id", "brand_id", F.explode(_prefixes(F.col("name"))).alias("word"), "embedded_name")
        .join(blocks, ["brand_id", "word"], "left_semi")
        .select("brand_id", "word", F.col("family_id").cast("long").alias("family_id"), rounded.alias("unit"))
        .where(norm(F.col("unit")) > 0)
    )
    block = ["brand_id", "word"]
    sides = [unique.where(norm(F.col("unit")) > 0), cut_lineage(offered)]
    (asking, offering), order = _in_cells(sides, sides[1], math.sqrt(max(0.02, 2 * (1 - similarity))))
    left = X.pack(asking, block, "rep", "unit", [*order, "rep"])
    right = X.pack(offering, block, "family_id", "unit", [*order, "family_id"])
    best = _best_first(left, right, block, similarity)
    chosen = unique.join(best, "rep").select(*block, *key, "family_id", "similarity")
    return asked.join(chosen, [*block, *key]).select(F.col("id").alias(id_col), "family_id", "similarity")


def existing_listings(sellers: DataFrame, store_products: DataFrame) -> DataFrame:
    """Seller rows whose (store_id, ref_id) is in the catalogue already."""
    known = store_products.select("store_id", "ref_id").distinct()
    return sellers.join(known, ["store_id", "ref_id"], "left_semi")


def match_variation(variations: DataFrame, products: DataFrame) -> DataFrame:
    """Variations (with family_id) plus the product_id of equal weight and measure, or null.

    Of several products with the same key the last id counts.
    """
    last = products.groupBy("family_id", "weight", "measure").agg(F.max("product_id").alias("product_id"))
    v, p = variations.alias("v"), last.alias("p")
    on = (
        (F.col("v.family_id") == F.col("p.family_id"))
        & F.col("v.weight").eqNullSafe(F.col("p.weight"))
        & F.col("v.measure").eqNullSafe(F.col("p.measure"))
    )
    return v.join(p, on, "left").select("v.*", F.col("p.product_id").alias("product_id"))


def number_families(families: DataFrame) -> DataFrame:
    return number_rows(families, ["store_id", "brand", "cluster"], "gold_id")
