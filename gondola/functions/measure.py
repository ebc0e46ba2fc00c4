"""Pack size of a listing: (measure, weight) from unit columns or the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.bind import let
from gondola.functions.vocabulary import (
    COUNT_UNITS,
    LIQUID_UNITS,
    SOLID_UNITS,
    TO_GRAMS,
    TO_MILLILITRES,
)

_COUNT = "|".join(COUNT_UNITS)
_SOLID = rf"(?iU)(\d+)\s*({'|'.join(SOLID_UNITS)})"
_LIQUID = rf"(?iU)(\d+(?:[.,]\d+)?)\s*({'|'.join(LIQUID_UNITS)})"
_STRICT_SOLID = rf"(?iU)(\d+(?:[.,]\d+)?)\s*({'|'.join(SOLID_UNITS)})\b"
_STRICT_LIQUID = rf"(?iU)(\d+(?:[.,]\d+)?)\s*({'|'.join(LIQUID_UNITS)})\b"
_PACK = r"(?iU)(?:c/|com)\s*(\d+(?:/\d+)?)"
_COUNTED = rf"(?iU)(\d+(?:/\d+)?)(?:\s*(?:{_COUNT}))(?!\s*\w)"
_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_PLURALS = {"quilos": "quilo", "quilogramas": "quilograma", "gramas": "g", "grama": "g",
            "litros": "litro", "mililitros": "ml", "mililitro": "ml"}


def _number(text: Column) -> Column:
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(_NUMBER), F.trim(dotted).try_cast("double"))


def first_of_list(value: Column) -> Column:
    """The element of a one-element array, else null."""
    return F.when(F.size(value) == 1, F.get(value, F.lit(0)))


def first_character(value: Column) -> Column:
    """A plain string read as a list: its first character."""
    return F.substr(value, F.lit(1), F.lit(1))


def _quantity(name: Column, pattern: str) -> Column:
    """Struct (weight, measure) of the first match, or null."""

    def pick(number: Column) -> Column:
        found = F.struct(
            F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("weight"),
            F.lower(F.regexp_extract(name, pattern, 2)).alias("measure"),
        )
        return F.when(number != "", found)

    return let(F.regexp_extract(name, pattern, 1), pick)


def solid_quantity(name: Column, strict: bool = False) -> Column:
    return _quantity(name, _STRICT_SOLID if strict else _SOLID)


def liquid_quantity(name: Column, strict: bool = False) -> Column:
    return _quantity(name, _STRICT_LIQUID if strict else _LIQUID)


def unit_count(name: Column, strict: bool = False) -> Column:
    """Number of units named in the text, or null; ``a/b`` counts as b."""

    def last(number: Column) -> Column:
        return F.element_at(F.split(number, "/"), -1).try_cast("double")

    any_unit = rf"(?iU)\b(?:{_COUNT})\b" if strict else rf"(?iU){_COUNT}"
    bare = F.when(name.rlike(any_unit), F.lit(1.0))
    counted = let(F.regexp_extract(name, _COUNTED, 1), lambda n: F.when(n != "", last(n)).otherwise(bare))
    return let(F.regexp_extract(name, _PACK, 1), lambda n: F.when(n != "", last(n)).otherwise(counted))


def to_base_unit(weight: Column, measure: Column, strict: bool = False) -> Column:
    """Struct (measure, weight) in g or ml where the unit is a large one."""
    if strict:
        plural = F.create_map(*[F.lit(x) for pair in _PLURALS.items() for x in pair])
        measure = F.coalesce(F.try_element_at(plural, measure), measure)
    unit = (
        F.when(measure.isin(TO_GRAMS), "g").when(measure.isin(TO_MILLILITRES), "ml").otherwise(measure)
    )
    scaled = F.when(measure.isin(TO_GRAMS + TO_MILLILITRES), weight * 1000).otherwise(weight)
    return F.struct(unit.alias("measure"), scaled.try_cast("int").alias("weight"))


def parse_measure(weight: Column, measure: Column, name: Column, strict_units: bool = False) -> Column:
    """Struct (measure, weight) from the unit columns (arrays of strings) or the name.

    Unit columns win when they hold a known unit and a number. Otherwise a solid
    quantity in the name, then a liquid one, then a unit count; else ('', 0).
    A column with several elements, or a weight that is no number, makes both
    unit columns unusable.
    """
    raw_weight = F.nullif(first_of_list(weight), F.lit(""))
    raw_measure = F.nullif(F.lower(first_of_list(measure)), F.lit(""))
    broken = (
        F.coalesce(F.size(weight) > 1, F.lit(False))
        | F.coalesce(F.size(measure) > 1, F.lit(False))
        | (raw_weight.isNotNull() & _number(raw_weight).isNull())
    )
    columns = F.struct(
        F.when(~broken, _number(raw_weight)).alias("weight"), F.when(~broken, raw_measure).alias("measure")
    )

    def decide(given: Column) -> Column:
        w, m = given["weight"], given["measure"]
        known = F.coalesce((w != 0) & m.isin(SOLID_UNITS + LIQUID_UNITS), F.lit(False))
        counted = F.coalesce((w > 0) & m.isin([u for u in COUNT_UNITS if "\\" not in u]), F.lit(False))

        def pair(weight: Column, measure: Column) -> Column:
            return F.struct(weight.alias("weight"), measure.alias("measure"))

        by_count = let(
            unit_count(name, strict_units),
            lambda n: F.when(n.isNotNull(), pair(n, F.lit("un"))).otherwise(pair(F.lit(0.0), F.lit(""))),
        )
        return F.when(known, given).otherwise(
            F.coalesce(
                solid_quantity(name, strict_units),
                liquid_quantity(name, strict_units),
                F.when(counted, pair(w, F.lit("un"))),
                by_count,
            )
        )

    chosen = let(columns, decide)
    return let(chosen, lambda c: to_base_unit(c["weight"], c["measure"], strict_units))
