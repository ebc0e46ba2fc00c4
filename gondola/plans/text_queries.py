"""Text, measure and silver queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gondola.functions import measure as M
from gondola.functions import text as X
from gondola.functions.vocabulary import ABBREVIATIONS, COUNT_UNITS, FOLD_MANY, LIQUID_UNITS, SOLID_UNITS, fold_pairs
from gondola.operators import silver as S
from gondola.plans.registry import Inputs, query
from gondola.sources.stores import STORES

LISTINGS = ("raw_listings",)
SPACES = r"regexp_replace({}, '[\s\x0B\x1C-\x1F\x85\xA0\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')"


def _words(expr: str) -> str:
    return (
        rf"list_filter(regexp_extract_all({expr}, '\{{*[\p{{L}}\p{{N}}_]+'), "
        r"lambda w: regexp_full_match(w, '\{*[a-zA-ZÀ-ÿ0-9]+'))"
    )


def _title(expr: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all(lower({expr}), '\p{{L}}+|\P{{L}}+'), "
        "lambda c: upper(c[1]) || c[2:]), '')"
    )


def _fold(expr: str) -> str:
    source, target = (s.replace("'", "''") for s in fold_pairs())
    out = f"translate({expr}, '{source}', '{target}')"
    for char, many in FOLD_MANY.items():
        out = f"replace({out}, '{char}', '{many}')"
    return out


@query("f1_strip_all", f"SELECT doc_id, trim({SPACES.format('text')}, ' ') AS text FROM documents")
def f1(t: Inputs):
    return t.documents.select("doc_id", X.strip_all(F.col("text")).alias("text"))


@query("f2_get_words", f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS words FROM documents")
def f2(t: Inputs):
    return t.documents.select("doc_id", F.array_join(X.get_words(F.col("text")), " ").alias("words"))


@query(
    "f3_replace_full_word",
    # Twice, since a border between two words belongs to both.
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1zzz\2', 'g'),
          '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1zzz\2', 'g') AS text FROM documents""",
)
def f3(t: Inputs):
    return t.documents.select("doc_id", X.replace_full_word(F.col("text"), "the", "zzz").alias("text"))


@query("f4_fold_accents", f"SELECT doc_id, {_fold('text')} AS text FROM documents")
def f4(t: Inputs):
    return t.documents.select("doc_id", X.fold_accents(F.col("text")).alias("text"))


@query("f5_title_case", f"SELECT ref_id, store_id, {_title('name')} AS title FROM raw_listings", LISTINGS)
def f5(t: Inputs):
    return t.raw_listings.select("ref_id", "store_id", X.title_case(F.col("name")).alias("title"))


# What each of the ten name endings of the listings view must turn into.
_KIND = "CAST(ref_id % 10 AS INT)"
_SIZE = r"regexp_extract(name, '(\d+)\D*$', 1)"
_BASE = r"regexp_extract(name, '^(\w+ \w+)', 1)"
EXPECTED_NAME = f"""CASE {_KIND}
  WHEN 6 THEN {_BASE} || ' para cozinha' WHEN 7 THEN {_BASE} || ' refrigerante zero'
  WHEN 8 THEN {_BASE} || ' ' || {_SIZE} || ' garrafas' WHEN 9 THEN {_BASE} || ' presunto' ELSE {_BASE} END"""
EXPECTED_MEASURE = f"CASE {_KIND} WHEN 0 THEN 'g' WHEN 1 THEN 'g' WHEN 8 THEN 'g' WHEN 7 THEN '' WHEN 2 THEN 'ml' WHEN 3 THEN 'ml' WHEN 6 THEN 'ml' ELSE 'un' END"
EXPECTED_WEIGHT = f"""CAST(CASE {_KIND} WHEN 7 THEN 0 WHEN 9 THEN 1 WHEN 3 THEN 1000 + 100 * CAST({_SIZE} AS INT)
  WHEN 0 THEN 1000 * CAST({_SIZE} AS INT) WHEN 6 THEN 1000 * CAST({_SIZE} AS INT) ELSE CAST({_SIZE} AS INT) END AS INT)"""


@query("f10_normalize_name", f"SELECT ref_id, store_id, {_title(EXPECTED_NAME)} AS name FROM raw_listings", LISTINGS)
def f10(t: Inputs):
    return t.raw_listings.select("ref_id", "store_id", X.normalize_name(F.col("name")).alias("name"))


@query("f6_remove_patterns")
def f6(t: Inputs):
    return t.documents.select("doc_id", X.remove_patterns(X.fold_accents(F.lower("text"))).alias("text"))


# DuckDB has no look-around: what must not be a digit is captured and put back.
_NO_DIGIT = r"(\s(?:\D|$)|[^\d\s]|$)"
_CONNECTED = "lower(name)"
for _found, _put in [
    (rf"\bp/{_NO_DIGIT}", r"para \1"),
    (rf"\bs/{_NO_DIGIT}", r"sem \1"),
    (rf"\bc/{_NO_DIGIT}", r"com \1"),
    (rf"\b\s?/\s?{_NO_DIGIT}", r" e \1"),
    (r"(^|[^\d\s])\s*\+\s*", r"\1 + "),
    (r"(^|\D)\.(\D|$)", r"\1. \2"),
]:
    _CONNECTED = f"regexp_replace({_CONNECTED}, '{_found}', '{_put}', 'g')"
_SPELLED = "lower(name)"
for _key, _value in ABBREVIATIONS.items():
    _token = re.escape(_key.rstrip(".").lower()).replace("\\ ", " ")
    for _ in range(2):  # a blank between two tokens belongs to both
        _SPELLED = f"regexp_replace({_SPELLED}, '(^|\\s){_token}\\.?(\\s|$)', '\\1{_value}\\2', 'g')"


@query("f7_expand_connectives", f"SELECT ref_id, store_id, {_CONNECTED} AS name FROM raw_listings", LISTINGS)
def f7(t: Inputs):
    return t.raw_listings.select("ref_id", "store_id", X.expand_connectives(F.lower("name")).alias("name"))


@query("f8_expand_abbreviations", f"SELECT ref_id, store_id, {_SPELLED} AS name FROM raw_listings", LISTINGS)
def f8(t: Inputs):
    return t.raw_listings.select("ref_id", "store_id", X.expand_abbreviations(F.lower("name")).alias("name"))


@query("f9_hyphen_to_space", "SELECT doc_id, replace(text, '-', ' ') AS text FROM documents")
def f9(t: Inputs):
    return t.documents.select("doc_id", X.hyphen_to_space(F.col("text")).alias("text"))


@query(
    "f11_brand_slug",
    f"SELECT doc_id, lower(array_to_string({_words(_fold('source'))}, '-')) AS slug, "
    f"lower(array_to_string({_words('trim(' + SPACES.format(_fold('text')) + ')')}, '-')) AS text_slug FROM documents",
)
def f11(t: Inputs):
    return t.documents.select(
        "doc_id", X.brand_slug(F.col("source")).alias("slug"), X.brand_slug(F.col("text")).alias("text_slug")
    )


_CUT = "instr(lower(listing), lower(brand))"
OWN_BRAND = f"""
listed AS (SELECT ref_id, store_id, brand, brand || ' ' || name || ' ' || upper(brand) AS listing,
             concat('brand-', CAST(store_id % 25 AS VARCHAR)) AS slug FROM raw_listings),
cut AS (SELECT *, CASE WHEN {_CUT} > 0 THEN trim({SPACES.format(f"substr(listing, 1, {_CUT} - 1) || ' ' || substr(listing, {_CUT} + length(brand))")})
          ELSE listing END AS rest FROM listed)"""


@query(
    "f12_strip_private_label",
    f"""+ {OWN_BRAND} SELECT ref_id, store_id, CASE WHEN brand = slug THEN '' ELSE brand END AS brand,
        CASE WHEN brand = slug THEN {_title('rest')} ELSE listing END AS name FROM cut""",
    LISTINGS,
)
def f12(t: Inputs):
    listing = F.concat_ws(" ", "brand", "name", F.upper("brand"))
    slug = F.concat(F.lit("brand-"), (F.col("store_id") % 25).cast("string"))
    cut = X.strip_private_label(listing, F.col("brand"), slug)
    return t.raw_listings.select("ref_id", "store_id", cut.alias("c")).select("ref_id", "store_id", "c.brand", "c.name")


@query(
    "f13_remove_word_original",
    r"""SELECT ref_id, store_id, CASE WHEN store_id % 3 <> 0 THEN
          trim(regexp_replace(concat('Original ', name, ' ORIGINAL'), '(?i)\boriginal\b', '', 'g'))
        ELSE concat('Original ', name, ' ORIGINAL') END AS name FROM raw_listings""",
    LISTINGS,
)
def f13(t: Inputs):
    name = F.concat(F.lit("Original "), F.col("name"), F.lit(" ORIGINAL"))
    brand = F.when(F.col("store_id") % 3 == 0, " Original ").otherwise(F.col("brand"))
    return t.raw_listings.select("ref_id", "store_id", X.remove_word_original(name, brand).alias("name"))


def _empty():
    return F.array().cast("array<string>")


@query(
    "f14_parse_measure",
    f"SELECT ref_id, store_id, {EXPECTED_MEASURE} AS measure, {EXPECTED_WEIGHT} AS weight FROM raw_listings",
    LISTINGS,
)
def f14(t: Inputs):
    parsed = M.parse_measure(_empty(), _empty(), F.col("name")).alias("m")
    return t.raw_listings.select("ref_id", "store_id", parsed).select("ref_id", "store_id", "m.*")


# Unit columns on every third listing: usable, a plain count, or two elements.
UNIT_COLUMNS = f"""
typed AS (SELECT *, CASE CAST(store_id % 4 AS INT) WHEN 0 THEN '0,5' WHEN 1 THEN '6' WHEN 2 THEN 'x' ELSE '2' END AS w,
            CASE CAST(store_id % 4 AS INT) WHEN 0 THEN 'KG' WHEN 1 THEN 'un' WHEN 2 THEN 'kg' ELSE 'Litro' END AS u
          FROM raw_listings)"""


@query(
    "f19_parse_measure_columns",
    f"""+ {UNIT_COLUMNS} SELECT ref_id, store_id,
          CASE CAST(store_id % 4 AS INT) WHEN 0 THEN 'g' WHEN 3 THEN 'ml'
            WHEN 1 THEN CASE WHEN {_KIND} IN (0, 1, 2, 3, 6, 8) THEN {EXPECTED_MEASURE} ELSE 'un' END
            ELSE {EXPECTED_MEASURE} END AS measure,
          CASE CAST(store_id % 4 AS INT) WHEN 0 THEN 500 WHEN 3 THEN 2000
            WHEN 1 THEN CASE WHEN {_KIND} IN (0, 1, 2, 3, 6, 8) THEN {EXPECTED_WEIGHT} ELSE 6 END
            ELSE {EXPECTED_WEIGHT} END AS weight FROM typed""",
    LISTINGS,
)
def f19(t: Inputs):
    t.raw_listings.createOrReplaceTempView("raw_listings")
    typed = t.spark.sql(f"WITH {UNIT_COLUMNS} SELECT * FROM typed")
    parsed = M.parse_measure(F.array("w"), F.array("u"), F.col("name")).alias("m")
    return typed.select("ref_id", "store_id", parsed).select("ref_id", "store_id", "m.*")


def _first_quantity(pattern: str) -> str:
    return (
        f"TRY_CAST(replace(regexp_extract(name, '{pattern}', 1), ',', '.') AS DOUBLE) AS weight, "
        f"nullif(lower(regexp_extract(name, '{pattern}', 2)), '') AS measure"
    )


@query(
    "f15_solid_quantity",
    f"SELECT ref_id, store_id, {_first_quantity('(?i)([0-9]+)' + chr(92) + 's*(' + '|'.join(SOLID_UNITS) + ')')} FROM raw_listings",
    LISTINGS,
)
def f15(t: Inputs):
    found = M.solid_quantity(F.col("name")).alias("q")
    return t.raw_listings.select("ref_id", "store_id", found).select("ref_id", "store_id", "q.weight", "q.measure")


@query(
    "f16_liquid_quantity",
    f"SELECT ref_id, store_id, {_first_quantity('(?i)([0-9]+(?:[.,][0-9]+)?)' + chr(92) + 's*(' + '|'.join(LIQUID_UNITS) + ')')} FROM raw_listings",
    LISTINGS,
)
def f16(t: Inputs):
    found = M.liquid_quantity(F.col("name")).alias("q")
    return t.raw_listings.select("ref_id", "store_id", found).select("ref_id", "store_id", "q.weight", "q.measure")


_UNITS = "|".join(COUNT_UNITS)


@query(
    "f17_unit_count",
    rf"""+ parts AS (SELECT ref_id, store_id, name, regexp_extract(name, '(?i)(?:c/|com)\s*(\d+(?:/\d+)?)', 1) AS pack,
           regexp_extract(name, '(?i)(\d+(?:/\d+)?)(?:\s*(?:{_UNITS}))\s*(?:[^\w\s]|$)', 1) AS counted FROM raw_listings)
       SELECT ref_id, store_id, CASE WHEN pack <> '' THEN CAST(string_split(pack, '/')[-1] AS DOUBLE)
           WHEN counted <> '' THEN CAST(string_split(counted, '/')[-1] AS DOUBLE)
           WHEN regexp_matches(name, '(?i){_UNITS}') THEN 1.0 END AS units FROM parts""",
    LISTINGS,
)
def f17(t: Inputs):
    return t.raw_listings.select("ref_id", "store_id", M.unit_count(F.col("name")).alias("units"))


BASE_UNIT = """
sized AS (SELECT p_partkey, p_size + 0.001 AS w, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'kg' WHEN 1 THEN 'quilo'
   WHEN 2 THEN 'l' WHEN 3 THEN 'litros' WHEN 4 THEN 'gramas' WHEN 5 THEN 'lt' ELSE 'un' END AS m FROM part)"""


@query(
    "f18_to_base_unit",
    f"""+ {BASE_UNIT} SELECT p_partkey, CASE WHEN m IN ('kg', 'quilo') THEN 'g' WHEN m IN ('l', 'lt') THEN 'ml' ELSE m END AS measure,
        CAST(trunc(CASE WHEN m IN ('kg', 'quilo', 'l', 'lt') THEN CAST(w AS DOUBLE) * 1000 ELSE CAST(w AS DOUBLE) END) AS INT) AS weight FROM sized""",
)
def f18(t: Inputs):
    t.part.createOrReplaceTempView("part")
    sized = t.spark.sql(f"WITH {BASE_UNIT} SELECT p_partkey, CAST(w AS DOUBLE) AS w, m FROM sized")
    return sized.select("p_partkey", M.to_base_unit(F.col("w"), F.col("m")).alias("b")).select("p_partkey", "b.*")


def stopwords(t: Inputs) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("portuguese")


STOP_SAMPLE = ["de", "la", "que", "the", "and", "um", "para", "com", "não", "uma", "os"]


@query(
    "f20_remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter({_words('lower(text)')}, lambda w: NOT list_contains({STOP_SAMPLE}, w)), ' ') AS text
        FROM documents""",
)
def f20(t: Inputs):
    return t.documents.select("doc_id", X.remove_stopwords(F.col("text"), STOP_SAMPLE).alias("text"))


@query(
    "f22_default_process",
    r"SELECT doc_id, lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g'), ' ')) AS text FROM documents",
)
def f22(t: Inputs):
    return t.documents.select("doc_id", X.default_process(F.col("text")).alias("text"))


@query(
    "f23_edge_ngrams",
    r"""SELECT gram, count(*) AS n FROM (
          SELECT unnest(list_transform(range(1, least(20, length(w)) + 1), lambda n: substr(w, 1, n))) AS gram FROM (
            SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) a) b
        GROUP BY gram""",
)
def f23(t: Inputs):
    grams = t.documents.select(F.explode(X.edge_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f24_search_tokens",
    r"""SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\p{L}\p{N}_]+'), ' ') AS tokens FROM part""",
)
def f24(t: Inputs):
    text = F.concat_ws(" ", "p_name", "p_brand")
    return t.part.select("p_partkey", F.array_join(X.search_tokens(text), " ").alias("tokens"))


@query(
    "f32_variation_key",
    """SELECT product_id, concat(CAST(product_id AS VARCHAR), '-', name, '-', CAST(weight AS VARCHAR), '-', measure) AS variation_key
       FROM products""",
    ("products",),
)
def f32(t: Inputs):
    key = X.variation_key(F.col("product_id"), F.col("name"), F.col("weight"), F.col("measure"))
    return t.products.select("product_id", key.alias("variation_key"))


def bronze(t: Inputs):
    """Nested listings: some without items, some without sellers or images."""
    listing = F.struct(F.col("price").cast("double").alias("Price"), F.col("old_price").cast("double").alias("ListPrice"))
    seller = F.struct(
        F.concat(F.lit("http://cart/?sku="), F.col("ref_id").cast("string")).alias("addToCartLink"),
        listing.alias("commertialOffer"),
    )
    image = F.struct(F.concat(F.lit("http://img/"), F.col("ref_id").cast("string")).alias("imageUrl"))
    item = F.struct(
        F.when(F.col("ref_id") % 17 != 0, F.array(seller)).otherwise(F.array().cast("array<struct<addToCartLink:string,commertialOffer:struct<Price:double,ListPrice:double>>>")).alias("sellers"),
        F.when(F.col("ref_id") % 19 != 0, F.array(image)).alias("images"),
    )
    return t.raw_listings.select(
        "store_id",
        F.col("ref_id").cast("string").alias("productId"),
        F.col("name").alias("productName"),
        "brand",
        F.concat(F.lit("http://shop/"), F.col("ref_id").cast("string")).alias("link"),
        F.when(F.col("ref_id") % 13 != 0, F.array(item)).alias("items"),
        F.lit("x").alias("clusterHighlights"),
    )


_ABSENT = "CASE WHEN ref_id % 13 = 0 OR ref_id % {} = 0 THEN NULL ELSE {} END"
OFFER_SQL = f"""
  {_ABSENT.format(17, "CAST(price AS DOUBLE)")} AS price, {_ABSENT.format(17, "CAST(old_price AS DOUBLE)")} AS old_price,
  {_ABSENT.format(17, "concat('http://cart/?sku=', CAST(ref_id AS VARCHAR))")} AS cart_link,
  {_ABSENT.format(19, "concat('http://img/', CAST(ref_id AS VARCHAR))")} AS image_url"""


@query(
    "p3_extract_offer",
    f"SELECT store_id, CAST(ref_id AS VARCHAR) AS ref_id, {OFFER_SQL} FROM raw_listings",
    LISTINGS,
)
def p3(t: Inputs):
    offer = S.extract_offer(F.col("items")).alias("_offer")
    return bronze(t).select("store_id", F.col("productId").alias("ref_id"), offer).select("store_id", "ref_id", "_offer.*")


@query(
    "p1_rename_and_project",
    f"""SELECT name, brand, CAST(ref_id AS VARCHAR) AS ref_id, CAST(NULL AS VARCHAR) AS measure, CAST(NULL AS INT) AS weight,
          concat('http://shop/', CAST(ref_id AS VARCHAR)) AS link, CAST(NULL AS VARCHAR) AS cart_link,
          CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS old_price, CAST(NULL AS VARCHAR) AS image_url, store_id
        FROM raw_listings""",
    LISTINGS,
)
def p1(t: Inputs):
    return S.project_silver(S.rename_source_columns(S.drop_columns(bronze(t)), STORES[0]))


@query(
    "p12_build_silver",
    f"""SELECT {_title(EXPECTED_NAME)} AS name, CASE WHEN brand = 'brand-1' THEN '' ELSE brand END AS brand,
          CAST(ref_id AS VARCHAR) AS ref_id, {EXPECTED_MEASURE} AS measure, {EXPECTED_WEIGHT} AS weight,
          concat('http://shop/', CAST(ref_id AS VARCHAR)) AS link, {OFFER_SQL}, store_id FROM raw_listings""",
    LISTINGS,
)
def p12(t: Inputs):
    renamed = S.rename_source_columns(S.drop_columns(bronze(t)), STORES[0]).withColumns(
        {"weight": _empty(), "measure": _empty()}
    )
    labels = t.stores.select("store_id", F.lit("brand-1").alias("slug"))
    silver, _ = S.build_silver(renamed, labels)
    return silver.drop("inserted_at")


@query(
    "p4_drop_unpriced",
    """+ priced AS (SELECT store_id, ref_id, CASE CAST(ref_id % 4 AS INT) WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE price END AS price,
          CASE CAST(store_id % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE old_price END AS old_price FROM raw_listings)
       SELECT * FROM priced WHERE NOT coalesce(price = 0 AND old_price = 0, FALSE)""",
    LISTINGS,
)
def p4(t: Inputs):
    r, s = F.col("ref_id") % 4, F.col("store_id") % 3
    zero = F.lit(0).cast("decimal(18,2)")
    priced = t.raw_listings.select(
        "store_id",
        "ref_id",
        F.when(r == 0, zero).when(r == 1, None).otherwise(F.col("price")).alias("price"),
        F.when(s == 0, zero).when(s == 1, None).otherwise(F.col("old_price")).alias("old_price"),
    )
    return S.drop_unpriced(priced)
