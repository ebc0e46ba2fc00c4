"""Columns shown to shoppers: prices, labels and merged cart links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def format_brl(price: Column) -> Column:
    """``R$ 1.234,50`` with a no-break space after the sign."""
    digits = F.translate(F.format_number(F.abs(price), 2), ",.", ".,")
    return F.concat(F.when(price < 0, "-").otherwise(""), F.lit(f"R${NBSP}"), digits)


def price_range_label(low: Column, high: Column) -> Column:
    one = F.format_string("R$%.2f", low.cast("double"))
    both = F.format_string("R$%.2f - R$%.2f", low.cast("double"), high.cast("double"))
    return F.when(low == high, one).when(low.isNotNull() & high.isNotNull(), both)


def size_label(weight: Column, measure: Column) -> Column:
    return F.concat_ws(" ", weight.cast("string"), measure)


def distance_label(km: Column) -> Column:
    return F.format_string("%.2f km", km.cast("double"))


def duration_label(minutes: Column) -> Column:
    return F.concat(minutes.cast("string"), F.lit(" min"))


def store_initial(name: Column) -> Column:
    return F.upper(F.substr(name, F.lit(1), F.lit(1)))


def _reencoded(part: Column) -> Column:
    """One query-string component decoded and encoded again as a form does."""
    return F.url_encode(F.coalesce(F.try_url_decode(part), part))


def _pairs(link: Column) -> Column:
    """The encoded ``key=value`` pairs of one link, repeats kept."""
    raw = F.coalesce(F.try_parse_url(link, F.lit("QUERY")), F.lit(""))
    given = F.filter(F.split(raw, "&"), lambda p: p != "")

    def encode(pair: Column) -> Column:
        at = F.locate("=", pair)
        key = F.when(at > 0, F.substr(pair, F.lit(1), at - 1)).otherwise(pair)
        value = F.when(at > 0, F.substr(pair, at + 1)).otherwise("")
        return F.concat(_reencoded(key), F.lit("="), _reencoded(value))

    return F.transform(given, encode)


def merge_cart_links(links: Column) -> Column:
    """First link's origin and path with the parameters of all links; ``#`` when empty."""
    first = F.get(links, F.lit(0))
    origin = F.concat(
        F.try_parse_url(first, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(first, F.lit("AUTHORITY"))
    )
    path = F.coalesce(F.nullif(F.try_parse_url(first, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.array_join(F.flatten(F.transform(links, _pairs)), "&")
    return F.when(F.size(links) == 0, F.lit("#")).otherwise(F.concat(origin, path, F.lit("?"), query))


def format_items(items: Column) -> Column:
    """Items with formatted price and formatted total."""
    return F.transform(
        items,
        lambda i: i.withField("formatted_price", format_brl(i["price"])).withField(
            "formatted_total_price", format_brl(i["total_price"])
        ),
    )


def format_cart_result(offers):
    """Nested offers (``items``, ``total_cost``) with their formatted amounts."""
    return offers.withColumns(
        {"items": format_items(F.col("items")), "formatted_total_cost": format_brl(F.col("total_cost"))}
    )


def document_to_response(variations: Column) -> Column:
    """Variations of a search document under the names of the response."""
    return F.transform(
        variations,
        lambda v: F.struct(
            v["product_id"].alias("id"),
            v["weight"].alias("weight"),
            v["measure"].alias("measure"),
            v["name"].alias("name"),
            v["image_url"].alias("imageUrl"),
            v["min_price"].alias("minPrice"),
            v["max_price"].alias("maxPrice"),
            v["stores"].alias("stores"),
        ),
    )
