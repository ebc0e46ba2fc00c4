"""String similarity of brand slugs, 0..100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.functions.text import default_process, get_words

# Weights of the two parts of the mixed score.
EDIT_WEIGHT, WORD_WEIGHT = 0.6, 0.4


def levenshtein_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(100 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)) * 100, F.lit(100.0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 when both are empty."""
    union = F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return F.coalesce(F.size(F.array_intersect(a, b)) / union, F.lit(0.0))


def processed(text: Column) -> Column:
    """Struct (text, words) as both parts of the score see it."""
    return let(default_process(text), lambda p: F.struct(p.alias("text"), get_words(F.lower(p)).alias("words")))


def mixed_of_processed(a: Column, b: Column) -> Column:
    return EDIT_WEIGHT * levenshtein_score(a["text"], b["text"]) + WORD_WEIGHT * 100 * jaccard(a["words"], b["words"])


def mixed_similarity(a: Column, b: Column) -> Column:
    both = F.struct(processed(a).alias("a"), processed(b).alias("b"))
    score = let(both, lambda s: mixed_of_processed(s["a"], s["b"]))
    empty = F.coalesce((a == "") | (b == ""), F.lit(True))
    return F.when(empty, F.lit(0.0)).otherwise(score)
