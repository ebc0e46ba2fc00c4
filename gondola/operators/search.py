"""Prefix search: postings table and BM25 ranking for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.functions.text import edge_ngrams, fold_accents, search_tokens
from gondola.session import cut_lineage

K1, B = 1.2, 0.75
# Field boosts and page size of the product search.
BOOSTS = {"name": 3.0, "brand": 1.0}
PAGE_SIZE = 10
#: Documents of a block of postings, and levels of contribution that blocks of a term are made of.
BLOCK_DOCS, LEVELS = 128, 64
#: Scores are rounded to six places; bounds allow for that and for sums in another order.
_MARGIN = 2e-6


def build_postings(docs: DataFrame, fields: tuple[str, ...] = ("name", "brand")) -> DataFrame:
    """(field, term, doc_id, tf, dl) for the edge n-grams of every field.

    The terms of a row are counted inside the row, so that no task holds its n-grams in a
    table. Only rows whose id occurs again (or is null) are summed over rows.
    """
    salt = F.when(F.col("id").isNull(), F.xxhash64(*fields))
    rows = docs.select("id", *fields).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id", salt)))
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _counted(edge_ngrams(F.col(f))).alias("g")) for f in fields]))

    def grams(part: DataFrame) -> DataFrame:
        listed = part.select(F.col("id").alias("doc_id"), by_field.alias("f"))
        return listed.select("f.field", "doc_id", "f.g.dl", F.inline("f.g.terms")).select("field", "term", "doc_id", "dl", "tf")

    again = F.col("id").isNull() | (F.col("_n") > 1)
    summed = grams(rows.where(again)).groupBy("field", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    return grams(rows.where(~again)).unionByName(summed)


def _counted(grams: Column) -> Column:
    """Struct (dl, terms): the number of n-grams, and every different one with its count, from one sorted list."""

    def runs(g: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(g))
        # The first place of every run of equal n-grams, and the end of the list.
        starts = F.filter(places, lambda i: (i == 0) | (i == F.size(g)) | ~F.get(g, i).eqNullSafe(F.get(g, i - 1)))
        return let(
            starts,
            lambda s: F.transform(
                F.slice(s, F.lit(1), F.size(s) - 1),
                lambda i, k: F.struct(F.get(g, i).alias("term"), (F.get(s, k + 1) - i).cast("long").alias("tf")),
            ),
        )

    return let(
        F.array_sort(grams),
        lambda g: F.struct(F.size(g).alias("dl"), F.when(F.size(g) > 0, runs(g)).alias("terms")),
    )


def nested_postings(variations: DataFrame) -> DataFrame:
    """Postings of the names of flat variations; indexed, but no query reads them."""
    names = variations.select(
        F.struct(F.col("family_id").alias("id"), F.col("product_id").alias("variation_id")).alias("id"), "name"
    )
    return build_postings(names, ("name",)).select(
        F.lit("variations.name").alias("field"), "term", "doc_id.*", "tf", "dl"
    )


def field_stats(docs: DataFrame, fields: tuple[str, ...] = ("name", "brand")) -> DataFrame:
    """One row per field: documents that have it and their mean length."""
    lengths = docs.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(edge_ngrams(F.col(f))).alias("dl")) for f in fields])).alias("f")
    ).select("f.field", "f.dl")
    return lengths.where("dl > 0").groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")
    )


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avg_dl: Column) -> Column:
    idf = F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def non_blank_query(queries: DataFrame) -> DataFrame:
    return queries.where(F.trim("text") != "")


def asked_terms(queries: DataFrame, fold: bool = False) -> DataFrame:
    """(query_id, term, times) of the words of every query that is not blank.

    ``fold`` folds the accents of the queries, for an index of folded names; the
    source application does not.
    """
    text = fold_accents(F.lower("text")) if fold else F.col("text")
    words = non_blank_query(queries).select("query_id", F.explode(search_tokens(text)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def contributions(asked: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, doc_id, part): what a document gains by a term, for the asked-for terms.

    Only postings of asked-for terms leave the index. A term's document count
    comes from those rows, and the joins run on (field, term); adaptive
    execution splits a term that most documents carry. A merge join is asked for,
    as compressed postings look small enough to be broadcast.
    """
    found = postings.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # ``stats`` has one row per indexed field.
    known = frequency.join(F.broadcast(stats), "field")
    boost = F.lit(0.0)
    for field, weight in BOOSTS.items():
        boost = F.when(F.col("field") == field, weight).otherwise(boost)
    return found.join(known.hint("merge"), ["field", "term"]).select(
        "term",
        "doc_id",
        (boost * bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avg_dl"))).alias("part"),
    )


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))


def score(queries: DataFrame, postings: DataFrame, stats: DataFrame, fold: bool = False) -> DataFrame:
    """(query_id, doc_id, score) for every document that holds any query word."""
    asked = asked_terms(queries, fold)
    pairs = contributions(asked, postings, stats).join(asked, "term")
    # A frequent word makes a row per query and document in one task. Dealt out before they
    # are summed, they wait in no task's table; a given number of parts is not merged again.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _summed(pairs.repartition(parts, "query_id", "doc_id"))


def blocks(parts: DataFrame) -> DataFrame:
    """(term, top, docs): postings in blocks of about equal contribution, with the largest one of each.

    A block belongs to one of ``LEVELS`` levels of its term and holds about ``BLOCK_DOCS``
    documents; a term of most documents is divided by hash, never sorted in one task.
    """
    tops = parts.groupBy("term").agg(F.max("part").alias("most"))
    level = F.ceil(LEVELS * F.col("part") / F.col("most")).cast("int")
    placed = parts.join(tops, "term").select("term", "doc_id", "part", level.alias("level"))
    sizes = placed.groupBy("term", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("n"))
    cell = F.pmod(F.xxhash64("doc_id"), F.col("n"))
    return (
        placed.join(sizes, ["term", "level"])
        .groupBy("term", "level", cell.alias("cell"))
        .agg(F.max("part").alias("top"), F.collect_list(F.struct("doc_id", "part")).alias("docs"))
        .select("term", "top", "docs")
    )


def _exact(pairs: DataFrame, asked: DataFrame, parts: DataFrame) -> DataFrame:
    """Scores of given (query_id, doc_id) pairs."""
    wanted = pairs.join(asked, "query_id")
    # The files of ``parts`` are many times smaller than a broadcast of its rows.
    return _summed(wanted.join(parts.hint("merge"), ["term", "doc_id"]))


def _floors(asked: DataFrame, parts: DataFrame, blocked: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that ``k`` documents of the query reach; 0 where it has fewer.

    The first documents of each word's best blocks are scored; no other document has to be
    looked at for a floor, and any ``k`` documents give a valid one.
    """
    best = Window.partitionBy("term").orderBy(F.desc("top"))
    few = blocked.select("term", "top", F.slice("docs.doc_id", 1, k).alias("ids"))
    first = few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    tried = asked.select("query_id", "term").join(first, "term").select("query_id", F.explode("ids").alias("doc_id")).distinct()
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = _exact(tried, asked, parts).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    floors = asked.select("query_id").distinct().join(kth.select("query_id", "score"), "query_id", "left")
    return floors.select("query_id", F.coalesce("score", F.lit(0.0)).alias("floor"))


def candidates(asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id) pairs among which the ``k`` best of every query are for certain.

    A document needs one of the words whose bounds, together with those of all weaker
    words, reach the floor; and from a block of such a word it can only reach the floor
    if the block's largest contribution and the bounds of all other words do. Blocks that
    cannot are never opened. What the opened blocks say of a document is then summed; a word
    whose block stayed closed adds less than what would have opened it.
    """
    blocked = cut_lineage(blocks(parts))
    floors = _floors(asked, parts, blocked, k)
    bounds = blocked.groupBy("term").agg(F.max("top").alias("most"))
    weaker = Window.partitionBy("query_id").orderBy("bound", "term")
    bounded = asked.join(bounds, "term").withColumn("bound", F.col("times") * F.col("most"))
    weighed = (
        bounded.withColumn("reach", F.sum("bound").over(weaker))
        .withColumn("rest", F.sum("bound").over(Window.partitionBy("query_id")) - F.col("bound"))
        .join(floors, "query_id")
        .withColumn("least", F.col("floor") - F.col("rest") - _MARGIN)
        .withColumn("needed", F.col("reach") >= F.col("floor") - _MARGIN)
    )
    closed = F.when(F.col("needed"), F.least("bound", F.greatest("least", F.lit(0.0)))).otherwise(F.col("bound"))
    known = cut_lineage(
        weighed.withColumn("closed", closed).withColumn("spare", F.sum("closed").over(Window.partitionBy("query_id")))
    )
    opened = known.where("needed").join(blocked, "term").where(F.col("times") * F.col("top") >= F.col("least"))
    each = opened.select("query_id", "times", "least", "closed", F.col("spare") - F.col("floor") + _MARGIN, F.inline("docs"))
    each = each.toDF("query_id", "times", "least", "closed", "slack", "doc_id", "part").where(F.col("times") * F.col("part") >= F.col("least"))
    summed = each.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("times") * F.col("part") - F.col("closed")).alias("gain"), F.first("slack").alias("slack")
    )
    return summed.where(F.col("gain") + F.col("slack") >= 0).select("query_id", "doc_id")


def best_hits(
    queries: DataFrame, postings: DataFrame, stats: DataFrame, page: int = 1, size: int = PAGE_SIZE, fold: bool = False
) -> DataFrame:
    """(query_id, doc_id, score, rank) of one page, scoring only documents that can be on it."""
    asked = cut_lineage(asked_terms(queries, fold))
    parts = contributions(asked, postings, stats).groupBy("term", "doc_id").agg(F.sum("part").alias("part"))
    parts = cut_lineage(parts)
    pairs = candidates(asked, parts, page * size)
    return page_of_hits(_exact(pairs, asked, parts), page, size)


def count_hits(queries: DataFrame, postings: DataFrame, fold: bool = False) -> DataFrame:
    """(query_id, total): documents that hold any word of the query; doc_id is an integer.

    Documents of a term are bits, 32,768 to a bucket; a query's buckets are the union of its
    words' buckets. No row per query and document is made.
    """
    asked = asked_terms(queries, fold)
    terms = asked.select("term").distinct()
    bits = (
        postings.join(terms, "term", "left_semi")
        .groupBy("term", F.bitmap_bucket_number("doc_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))
    )
    merged = (
        asked.join(bits, "term")
        .groupBy("query_id", "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    )
    return merged.groupBy("query_id").agg(F.sum("n").alias("total"))


def total_hits(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))


def page_of_hits(scores: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Hits (page-1)*size+1 .. page*size of every query.

    The rank filter is applied by Spark before the shuffle too, so each task
    sends at most page*size rows per query.
    """
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(ranking))
    return ranked.where((F.col("rank") <= page * size) & (F.col("rank") > (page - 1) * size))


def search_products(
    queries: DataFrame, docs: DataFrame, postings: DataFrame, stats: DataFrame, page: int = 1, fold: bool = False
) -> DataFrame:
    """One page of documents per query with the total number of hits."""
    hits = best_hits(queries, postings, stats, page, fold=fold).join(count_hits(queries, postings, fold), "query_id")
    return hits.join(docs, hits["doc_id"] == docs["id"]).drop("id")


def page(ranked: DataFrame, number: int, order: list[Column], size: int = PAGE_SIZE) -> DataFrame:
    """A page of one ranking."""
    return ranked.orderBy(*order).offset((number - 1) * size).limit(size)
