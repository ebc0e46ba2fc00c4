"""Name vectors: embedding, normalising, rounding, cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.functions.text import get_words, remove_stopwords
from gondola.session import cut_lineage


def portuguese_stopwords() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("portuguese")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Word counts over ``dims`` hash buckets, as array<double>."""
    bucket = F.transform(
        get_words(text),
        lambda w: F.pmod(F.conv(F.substr(F.md5(w), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(dims)).cast("int"),
    )
    return let(
        bucket,
        lambda hits: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: (F.size(hits) - F.size(F.array_remove(hits, i))).cast("double"),
        ),
    )


def clean_names(name: Column, stopwords: Iterable[str] | None = None) -> Column:
    """The text of a name that its vector is made from."""
    return remove_stopwords(name, portuguese_stopwords() if stopwords is None else stopwords)


def embed_texts(df: DataFrame, text: str, out: str, model: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """Add a vector per cleaned text.

    Without a model the words are hashed and the result has unit length. With
    one, ``model`` gets Arrow batches of texts and returns one vector per text.
    """
    if model is None:
        return df.withColumn(out, l2_normalize(hashed_embedding(F.col(text))))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(batch)])

    return df.withColumn(out, run(F.col(text)))


def embed_names(
    df: DataFrame,
    name: str = "name",
    out: str = "embedded_name",
    stopwords: Iterable[str] | None = None,
    model: Callable[[pd.Series], list] | None = None,
) -> DataFrame:
    """Add a vector per name; each distinct name is cleaned once, each distinct cleaned name embedded once.

    Merge joins are asked for: hashed words are mostly zeros, so vectors look far smaller than they are.
    """
    names = df.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    texts = cut_lineage(names.withColumn("_text", clean_names(F.col("_name"), stopwords)))
    vectors = embed_texts(texts.select("_text").distinct(), "_text", out, model)
    known = texts.join(vectors.hint("merge"), "_text").drop("_text")
    return df.join(known.hint("merge"), F.col(name) == F.col("_name")).drop("_name")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    scaled = F.struct(v.alias("v"), F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)).alias("n"))
    return let(scaled, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def cosine_similarity(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_literal(v: Column, places: int = 6) -> Column:
    """Components rounded as the stored vector is."""
    return F.transform(v, lambda x: F.round(x.cast("double"), places))


def vector_key(v: Column) -> dict[str, Column]:
    """Columns of 128 bits that stand for a vector, its length and the places of its nulls."""
    holes = F.transform(v, lambda x: x.isNull())
    return {"_v1": F.xxhash64(v, holes), "_v2": F.xxhash64(F.lit(1), v, holes)}


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))
