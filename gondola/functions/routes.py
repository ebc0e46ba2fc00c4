"""Scalar functions around routes, travel modes and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes the route service expects per travel mode.
TRAVEL_MODES = {
    "bicycle": "BICYCLE",
    "car": "DRIVE",
    "motorcycle": "TWO_WHEELER",
    "walking": "WALK",
}

ROUTE_SCHEMA = "struct<routes:array<struct<legs:array<struct<distanceMeters:double,duration:string>>>>>"


def travel_mode_code(mode: Column) -> Column:
    code = F.lit("")
    for known, value in TRAVEL_MODES.items():
        code = F.when(F.lower(mode) == known, value).otherwise(code)
    return code


def parse_duration_min(text: Column) -> Column:
    """``"90s"`` -> 2 minutes, halves to even; null for any other form."""
    seconds = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*s+$", 1)
    whole = F.nullif(seconds, F.lit("")).try_cast("int")
    return F.bround(whole / F.lit(60.0)).cast("int")


def meters_to_km(meters: Column) -> Column:
    return F.round(meters / 1000, 2).cast("decimal(10,2)")


def first_leg(payload: Column) -> Column:
    """Leg from the origin to the store: first leg of the first route, or null."""
    parsed = F.from_json(payload, ROUTE_SCHEMA)
    return F.get(F.get(parsed["routes"], F.lit(0))["legs"], F.lit(0))


def null_if_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))
