"""Name and brand cleaning as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.functions.vocabulary import ABBREVIATIONS, CONNECTIVES, FOLD_MANY, REMOVALS, fold_pairs

# Python's \s also covers the four ASCII separators.
_SPACE = r"(?U)[\s\x1C-\x1F]+"
_WORD = r"(?U)\{*\b[a-zA-ZÀ-ÿ0-9]+\b"


def _quoted(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def strip_all(text: Column) -> Column:
    """Collapse whitespace and trim."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def get_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def replace_full_word(text: Column, old: str, new: str) -> Column:
    """Replace ``old`` where it stands as a whole word, in any case."""
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"(?iU)\b{_quoted(old)}\b", safe)


def fold_accents(text: Column) -> Column:
    """Latin text to ASCII. Characters outside the table stay as they are."""
    source, target = fold_pairs()
    many = "[" + "".join(FOLD_MANY) + "]"

    def expand(value: Column) -> Column:
        spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), FOLD_MANY.items(), value)
        return F.when(value.rlike(many), spelled).otherwise(value)

    # Most names are plain ASCII and skip the table altogether.
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, source, target), expand)).otherwise(t))


def title_case(text: Column) -> Column:
    """Capital after every non-letter: ``2l`` -> ``2L``, ``d'agua`` -> ``D'Agua``."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _until_stable(text: Column, pattern: str) -> Column:
    """Delete ``pattern`` again and again until nothing changes.

    Every pass that changes the text shortens it, so its length bounds the
    passes. They run in blocks of 16: once two passes agree, the rest of the
    block does no regex work and later blocks are skipped.
    """

    def once(state: Column, _: Column) -> Column:
        shorter = F.struct(
            F.regexp_replace(state["now"], pattern, "").alias("now"), state["now"].alias("before")
        )
        return F.when(state["now"] == state["before"], state).otherwise(shorter)

    def block(state: Column, _: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(1), F.lit(16)), state, once)
        return F.when(state["now"] == state["before"], state).otherwise(more)

    def loop(value: Column) -> Column:
        start = F.struct(value.alias("now"), F.lit(None).cast("string").alias("before"))
        blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 16).cast("int"))
        return F.when(value.rlike(pattern), F.aggregate(blocks, start, block, lambda s: s["now"])).otherwise(value)

    return let(text, loop)


def remove_patterns(text: Column) -> Column:
    """Drop weights, containers, promotions and counts from a folded name."""
    # (?d): only \n ends a line, for both "." and "$".
    return reduce(lambda c, p: _until_stable(c, f"(?id){p}"), REMOVALS, text)


def expand_connectives(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, f"(?i){rule[0]}", rule[1]), CONNECTIVES, text)


def expand_abbreviations(text: Column, table: dict[str, str] | None = None) -> Column:
    """Expand whole tokens, in table order, so one expansion can feed the next."""
    rules = {key.rstrip(".").lower(): value for key, value in (table or ABBREVIATIONS).items()}
    any_key = r"(?i)(?<!\S)(?:" + "|".join(_quoted(k) for k in rules) + r")\.?(?!\S)"

    def expand(value: Column) -> Column:
        return reduce(
            lambda c, kv: F.regexp_replace(c, rf"(?i)(?<!\S){_quoted(kv[0])}\.?(?!\S)", kv[1]), rules.items(), value
        )

    # One scan decides whether any of the rules can apply at all.
    return let(text, lambda t: F.when(t.rlike(any_key), expand(t)).otherwise(t))


def hyphen_to_space(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(" "))


def normalize_name(text: Column) -> Column:
    cleaned = remove_patterns(fold_accents(F.lower(text)))
    expanded = expand_abbreviations(expand_connectives(cleaned))
    return title_case(strip_all(hyphen_to_space(expanded)))


def brand_slug(brand: Column) -> Column:
    return F.lower(F.array_join(get_words(strip_all(fold_accents(brand))), "-"))


def strip_private_label(name: Column, brand: Column, slug: Column) -> Column:
    """Struct (name, brand): a store's own brand leaves the name and becomes ''."""

    def cut(row: Column) -> Column:
        name, brand, at = row["name"], row["brand"], row["at"]
        rest = F.concat(
            F.substr(name, F.lit(1), at - 1), F.lit(" "), F.substr(name, at + F.length(brand))
        )
        shorter = F.when(at > 0, strip_all(rest)).otherwise(name)
        return F.struct(title_case(shorter).alias("name"), F.lit("").alias("brand"))

    at = F.position(F.lower(brand), F.lower(name))
    row = F.struct(name.alias("name"), brand.alias("brand"), at.alias("at"))
    return F.when(brand == slug, let(row, cut)).otherwise(F.struct(name.alias("name"), brand.alias("brand")))


def remove_word_original(name: Column, brand: Column) -> Column:
    """Drop the word "original" unless it is the brand itself."""
    dropped = strip(F.regexp_replace(name, r"(?iU)\boriginal\b", ""))
    return F.when(F.lower(strip(brand)) != "original", dropped).otherwise(name)


def remove_stopwords(text: Column, stopwords: Iterable[str]) -> Column:
    """Lower-case words without the stop words, joined by spaces."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
    return F.array_join(F.filter(get_words(F.lower(text)), lambda w: ~F.array_contains(stop, w)), " ")


def default_process(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]", " ")))


def edge_ngrams(text: Column, shortest: int = 1, longest: int = 20) -> Column:
    """All prefixes of every letter/digit run, lower-cased, repeats kept."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= shortest)
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(w))),
            lambda n: F.substr(w, F.lit(1), n),
        ),
    )
    return F.flatten(grams)


# A mark between two letters, or between two digits, stays inside the token.
_TOKEN = r"[\p{L}\p{N}_]+(?:(?:(?<=\p{L})[.'’:·](?=\p{L})|(?<=\p{N})[.,;'’](?=\p{N}))[\p{L}\p{N}_]+)*"


def search_tokens(text: Column) -> Column:
    """Whole lower-case words of a query."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def leaf_path(prefix: Column, node: Column) -> Column:
    return F.concat(prefix, F.lit("/"), node.cast("string"))


def variation_key(product_id: Column, name: Column, weight: Column, measure: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (product_id, name, weight, measure)]
    return F.concat_ws("-", *parts)
