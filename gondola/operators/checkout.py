"""Cart optimisation for many carts at once.

Inputs
  carts           cart_id, product_id, quantity        (unique per cart and product)
  store_products  store_id, product_id, price [, name, cart_link]  (unique pair)
  distances       store_id, distance_km, duration_min [, cart_id]

Totals stay flat (one row per cart and store) and items stay flat (one row per
cart, store and product); ``nest_offers`` builds the nested form at the edge.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType

from gondola.functions.routes import first_leg, meters_to_km, parse_duration_min
from gondola.operators.lists import nest
from gondola.session import cut_lineage

MONEY = "decimal(38,2)"

# Offers of one list, lines of a cart that one task takes whole, parts of a larger
# cart at most, and joined rows that one task sums in memory.
_LIST, _CART, _PARTS, _ROWS = 1024, 4096, 64, 2_000_000
# Joined rows that one task sorts into nested lists in memory.
NESTED_ROWS = 400_000
# Rows of a table of stores that is sent to every task instead of sorting the offers by store.
_SENT = 500_000


def cart_to_request(items: DataFrame) -> DataFrame:
    """One quantity per (cart, product): the row with the highest ``pos`` wins."""
    return items.groupBy("cart_id", "product_id").agg(F.max_by("quantity", "pos").alias("quantity"))


def validate_cart(requests: DataFrame, carts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into accepted and rejected (with the first broken rule)."""
    sizes = carts.groupBy("cart_id").agg(F.count(F.lit(1)).alias("n_products"))

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    no_store = F.coalesce(F.size("stores") <= 0, F.lit(True)) | F.coalesce(
        F.exists("stores", lambda s: F.coalesce(F.trim(s) == "", F.lit(True))), F.lit(True)
    )
    reason = (
        F.when(F.col("n_products").isNull(), "no products")
        .when(blank("origin"), "origin")
        .when(blank("destination"), "destination")
        .when(blank("travel_mode"), "travel_mode")
        .when(no_store, "stores")
    )
    checked = requests.join(sizes, "cart_id", "left").withColumn("reason", reason)
    accepted = checked.where("reason is null").drop("reason", "n_products")
    return accepted, checked.where("reason is not null").drop("n_products")


def stores_by_slug(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores named by any request."""
    wanted = requests.select(F.explode("stores").alias("slug")).distinct()
    return stores.join(wanted, "slug", "left_semi")


def offers_for_products(store_products: DataFrame, carts: DataFrame) -> DataFrame:
    """Store offers of products that are in some cart."""
    return store_products.join(carts.select("product_id").distinct(), "product_id", "left_semi")


def offers_with_store(store_products: DataFrame, stores: DataFrame) -> DataFrame:
    return store_products.join(stores, "store_id")


def _column_of(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda row: row[name])


def packed_offers(store_products: DataFrame) -> DataFrame:
    """(product_id, one array per other column): the offers of a product in lists of about ``_LIST``."""
    rest = [c for c in store_products.columns if c != "product_id"]
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("product_id")) / _LIST).cast("int")
    # The lists need no other shuffle than the count of their product.
    celled = store_products.withColumn("_cell", F.pmod(F.xxhash64(*rest), lists))
    packed = celled.groupBy("product_id", "_cell").agg(F.collect_list(F.struct(*rest)).alias("_o"))
    return packed.select("product_id", *[_column_of(F.col("_o"), c).alias(c) for c in rest])


class _Codes(NamedTuple):
    """How the columns of an offer lie in one number: above the least of its list, one further up, so that 0 is null."""

    kinds: dict[str, DataType]
    places: dict[str, tuple[int, int]]  # first bit and number of bits

    @property
    def chunks(self) -> dict[str, int]:
        """Columns of 16 bits, the last one of 8 if that is enough, and their first bit."""
        return {f"_c{i}": 16 * i for i in range(-(-sum(n for _, n in self.places.values()) // 16))}

    def kind(self, chunk: str) -> tuple[str, int]:
        left = sum(n for _, n in self.places.values()) - self.chunks[chunk]
        return ("byte", 128) if left <= 8 else ("short", 32768)

    def value(self, code: Column, name: str) -> Column:
        """The number of a column, without the scale of a decimal one; null for 0."""
        at, n = self.places[name]
        raw = F.shiftright(code, at).bitwiseAND(F.lit((1 << n) - 1))
        return F.when(raw != 0, F.col(f"_least_{name}") + raw - 1)

    def code(self, row) -> Column:
        out = F.lit(0).cast("long")
        for c, at in self.chunks.items():
            out = out + F.shiftleft(row(c).cast("long") + self.kind(c)[1], at)
        return out


def _plain_number(value: Column, kind: DataType) -> Column:
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    return (value * F.lit(Decimal(10**scale))).cast("long") if scale else value.cast("long")


def _codes_of(packed: DataFrame) -> _Codes | None:
    """Codes for lists of whole numbers and decimals of up to 18 digits; None where they do not fit. Only the widest spans reach the driver."""
    kinds = {f.name: f.dataType.elementType for f in packed.schema if f.name != "product_id"}
    if not all(isinstance(k, (ByteType, ShortType, IntegerType, LongType)) or isinstance(k, DecimalType) and k.precision <= 18 for k in kinds.values()):
        return None
    end = lambda value, kind: _plain_number(value, kind).cast("decimal(20,0)")
    spans = packed.agg(*[F.max(end(F.array_max(c), k) - end(F.array_min(c), k)) for c, k in kinds.items()]).first()
    places, at = {}, 0
    for name, span in reversed(list(zip(kinds, spans))):
        n = (int(span or 0) + 1).bit_length()
        places[name] = (at, n)
        at += n
    return _Codes(kinds, places) if at <= 62 else None


def _coded(packed: DataFrame, codes: _Codes) -> DataFrame:
    """Lists of codes in order, cut into arrays of shorts: a few bytes an offer that lists of wide numbers would not shrink to."""
    least = {f"_least_{c}": F.coalesce(_plain_number(F.array_min(c), k), F.lit(0).cast("long")) for c, k in codes.kinds.items()}

    def one(offer: Column) -> Column:
        out = F.lit(0).cast("long")
        for c, (at, _) in codes.places.items():
            above = _plain_number(offer[c], codes.kinds[c]) - F.col(f"_least_{c}") + 1
            out = out + F.shiftleft(F.coalesce(above, F.lit(0).cast("long")), at)
        return out

    listed = packed.withColumns(least).withColumn("_code", F.array_sort(F.transform(F.arrays_zip(*codes.kinds), one)))

    def chunk(name: str, at: int) -> Column:
        kind, half = codes.kind(name)
        part = lambda x: (F.shiftright(x, at).bitwiseAND(F.lit(2 * half - 1)) - half).cast(kind)
        return F.transform("_code", part).alias(name)

    return listed.select("product_id", *least, *[chunk(c, at) for c, at in codes.chunks.items()])


def _read_codes(rows: DataFrame, codes: _Codes) -> DataFrame:
    code = codes.code(F.col)

    def read(name: str) -> Column:
        value, kind = codes.value(code, name), codes.kinds[name]
        if isinstance(kind, DecimalType):
            value = value.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))
        return value.cast(kind).alias(name)

    kept = [c for c in rows.columns if c not in codes.chunks and not c.startswith("_least_")]
    return rows.select(*kept, *[read(c) for c in codes.kinds])


def _offers_by_cart(kept: DataFrame, store_products: DataFrame, sized: bool = False, most: int | None = None) -> DataFrame:
    """``kept.join(store_products, "product_id")`` dealt by cart, plus ``_part``.

    What is shuffled is a cart line with the list of its product's offers, as codes where
    these are numbers; the rows of the join are made behind that shuffle, and groups of
    (cart_id, _part, ..) need no other. A part is a share of the stores, and only a cart of many lines has several.
    ``sized`` adds ``_size``, the lines of the cart, and leaves out lines without a cart.
    ``most`` are the joined rows of a task. ``kept`` is a cut, as it is read several times. Merge joins are asked for, since a
    cut's files are many times smaller than its rows in a broadcast.
    """
    rest = [c for c in store_products.columns if c != "product_id"]
    packed = cut_lineage(packed_offers(store_products))
    sizes = kept.groupBy("cart_id").agg(F.count(F.lit(1)).alias("_size"))
    lines = kept.join(sizes.hint("merge"), "cart_id") if sized else kept.join(cut_lineage(sizes.where(F.col("_size") > _CART)), "cart_id", "left")
    parts = F.least(F.ceil(F.coalesce("_size", F.lit(1)) / _CART), F.lit(_PARTS)).cast("int")
    dealt = lines.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    codes = _codes_of(packed)
    lists, fields = (packed, rest) if codes is None else (_coded(packed, codes), list(codes.chunks))
    store = lambda o: o["store_id"] if codes is None else codes.value(codes.code(lambda c: o[c]), "store_id")
    own = F.filter(F.arrays_zip(*fields), lambda o: F.pmod(F.xxhash64(store(o)), F.col("_parts")) == F.col("_part"))
    shown = [F.when(F.col("_parts") == 1, F.col(c)).otherwise(_column_of(own, c)).alias(c) for c in fields]
    columns = [*[c for c in kept.columns if c != "product_id"], *(["_size"] if sized else [])]
    columns += [c for c in lists.columns if c not in ("product_id", *fields)]
    joined = dealt.join(lists.hint("merge"), "product_id").select("product_id", *columns, "_part", *shown)

    offered = packed.groupBy("product_id").agg(F.sum(F.size("store_id")).alias("_offers"))
    asked = kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("_lines"))
    rows = asked.join(offered, "product_id").agg(F.sum(F.col("_lines") * F.col("_offers"))).first()[0] or 0
    tasks = max(kept.sparkSession.sparkContext.defaultParallelism, -(-rows // (most or _ROWS)))
    together = joined.repartition(tasks, "cart_id", "_part")
    made = together.select("product_id", *columns, "_part", F.inline(F.arrays_zip(*fields)))
    return made if codes is None else _read_codes(made, codes)


def _by_store(table: DataFrame) -> DataFrame:
    """A table of stores for joins: broadcast if it is small by the number of its rows, which alone reaches the driver."""
    return F.broadcast(table) if table.limit(_SENT + 1).count() <= _SENT else table


def cart_offers(carts: DataFrame, store_products: DataFrame, by_cart: bool = False, most: int | None = None) -> DataFrame:
    """Every store offer for every cart line.

    ``by_cart`` deals the rows by cart and adds ``_part``, for sums per cart and store; ``most`` are the rows of a task.
    """
    items = _offers_by_cart(cut_lineage(carts), store_products, most=most) if by_cart else carts.join(store_products, "product_id")
    return items.withColumn("total_price", (F.col("quantity") * F.col("price")).cast(MONEY))


def _offer_keys(items: DataFrame) -> list[str]:
    """Keys of an offer; the part of rows dealt by cart follows from the other two."""
    return ["cart_id", *[c for c in ("_part",) if c in items.columns], "store_id"]


def offer_by_store(items: DataFrame) -> DataFrame:
    summed = items.groupBy(*_offer_keys(items)).agg(
        F.sum("total_price").cast(MONEY).alias("total_cost"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return summed.drop("_part")


def covers_whole_cart(offers: DataFrame, carts: DataFrame) -> DataFrame:
    """Offers of stores holding every product of the cart.

    Counting is a subset test because (store, product) and (cart, product) are
    unique keys. The sizes meet the offers after those are aggregated, so a huge
    cart arrives here as one row per store.
    """
    sizes = carts.groupBy("cart_id").agg(F.count(F.lit(1)).alias("_size"))
    return offers.join(sizes, "cart_id").where("n_items = _size").drop("_size")


def full_offers(carts: DataFrame, store_products: DataFrame) -> DataFrame:
    """Totals of the stores that hold a whole cart.

    Same rows as ``covers_whole_cart(offer_by_store(cart_offers(..)))``, planned
    for size: a line travels with its cart's size and the stores of its product, so
    incomplete offers are dropped where they are counted and never shuffled. Prices
    are looked up for the complete ones alone, and money is summed in whole cents.
    Both tables are read several times, so they are written once.
    """
    return _full_offers(*_checkout_cuts(carts, store_products))


def _checkout_cuts(carts: DataFrame, store_products: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = carts.select("cart_id", "product_id", "quantity")
    return cut_lineage(lines), cut_lineage(store_products.select("store_id", "product_id", "price"))


def _full_offers(carts: DataFrame, store_products: DataFrame) -> DataFrame:
    cents = store_products.select("store_id", "product_id", (F.col("price").cast("decimal(18,2)") * 100).cast("long").alias("_cents"))
    lines = carts.select("cart_id", "product_id", F.col("quantity").cast("long").alias("_quantity"))
    held = (
        _offers_by_cart(lines.drop("_quantity"), store_products.select("store_id", "product_id"), sized=True)
        .groupBy("cart_id", "_part", "store_id", "_size")
        .agg(F.count(F.lit(1)).alias("n_items"))
        .where("n_items = _size")
    )
    full = cut_lineage(held.select("cart_id", F.col("store_id").alias("_store")))
    asked = lines.join(full.hint("merge"), "cart_id").withColumnRenamed("product_id", "_product")
    same = (F.col("_product") == F.col("product_id")) & F.col("_store").eqNullSafe(F.col("store_id"))
    summed = (
        asked.join(cents.hint("merge"), same)
        .groupBy("cart_id", "store_id")
        .agg(F.sum(F.col("_quantity") * F.col("_cents")).alias("_total"), F.count(F.lit(1)).alias("n_items"))
    )
    return summed.select(
        "cart_id", "store_id", (F.col("_total").cast("decimal(36,0)") / 100).cast(MONEY).alias("total_cost"), "n_items"
    )


def cheapest_single_store(carts: DataFrame, store_products: DataFrame) -> DataFrame:
    return _best(full_offers(carts, store_products), ["total_cost", "store_id"], ["n_items"])


def cheapest_offer(store_products: DataFrame) -> DataFrame:
    """Cheapest store per product; equal prices go to the lower store id."""
    rest = [c for c in store_products.columns if c != "product_id"]
    return (
        store_products.groupBy("product_id")
        .agg(F.min_by(F.struct(*rest), F.struct("price", "store_id")).alias("o"))
        .select("product_id", "o.*")
    )


def cheapest_items(carts: DataFrame, store_products: DataFrame) -> DataFrame:
    """Cart lines at their cheapest store.

    The cheapest store of a product does not depend on the cart, so it is found
    once per product and the carts never fan out over all stores.
    """
    return cart_offers(carts, cheapest_offer(store_products))


def cheapest_per_item(carts: DataFrame, store_products: DataFrame) -> DataFrame:
    return offer_by_store(cheapest_items(carts, store_products))


def distances_from_routes(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distance rows from route payloads, and payloads that cannot be read."""
    keys = [c for c in routes.columns if c != "payload"]
    leg = routes.select(*keys, "payload", first_leg(F.col("payload")).alias("leg"))
    read = leg.select(
        *keys,
        "payload",
        meters_to_km(F.col("leg.distanceMeters")).alias("distance_km"),
        parse_duration_min(F.col("leg.duration")).alias("duration_min"),
    )
    good = read.where("distance_km is not null and duration_min is not null").drop("payload")
    bad = read.where("distance_km is null or duration_min is null").select(*keys, "payload")
    return good, bad


def zip_stores_routes(requests: DataFrame) -> DataFrame:
    """Pair each request's stores with its routes by position."""
    return requests.select("cart_id", F.posexplode(F.arrays_zip("store_ids", "payloads"))).select(
        "cart_id", "pos", F.col("col.store_ids").alias("store_id"), F.col("col.payloads").alias("payload")
    )


def attach_distance(offers: DataFrame, distances: DataFrame, strict: bool = False) -> DataFrame:
    """Add distance columns; offers of stores without one are left out.

    ``strict`` fails the query instead, as soon as such an offer is met.
    """
    keys = [k for k in ("cart_id", "store_id") if k in distances.columns]
    distances = _by_store(distances)
    if not strict:
        return offers.join(distances, keys)
    joined = offers.join(distances, keys, "left")
    checked = F.when(F.col("distance_km").isNull(), F.raise_error(F.lit("store without a distance"))).otherwise(
        F.col("distance_km")
    )
    return joined.withColumn("distance_km", checked)


def offers_without_distance(offers: DataFrame, distances: DataFrame) -> DataFrame:
    keys = [k for k in ("cart_id", "store_id") if k in distances.columns]
    return offers.join(_by_store(distances), keys, "left_anti")


def _best(offers: DataFrame, order: list[str], rest: list[str]) -> DataFrame:
    row = F.struct(*order, *rest)
    best = offers.groupBy("cart_id").agg(F.min_by(row, F.struct(*order)).alias("b"))
    return best.select("cart_id", "b.*")


def cheapest_single_store_with_distance(
    carts: DataFrame, store_products: DataFrame, distances: DataFrame
) -> DataFrame:
    offers = attach_distance(full_offers(carts, store_products), distances)
    return _best(offers, ["total_cost", "distance_km", "duration_min", "store_id"], ["n_items"])


def cheapest_per_item_with_distance(
    carts: DataFrame, store_products: DataFrame, distances: DataFrame
) -> DataFrame:
    return attach_distance(cheapest_per_item(carts, store_products), distances)


def cart_result(carts: DataFrame, store_products: DataFrame, distances: DataFrame) -> DataFrame:
    """The four answers per cart, one row per (cart, answer, store).

    Both kinds of offers feed two answers each, so they are written once, as are the tables they come from.
    """
    carts, store_products = _checkout_cuts(carts, store_products)
    none_km, none_min = F.lit(None).cast("decimal(10,2)"), F.lit(None).cast("int")
    columns = ["cart_id", "answer", "store_id", "total_cost", "n_items", "distance_km", "duration_min"]
    full = cut_lineage(_full_offers(carts, store_products))
    split = cut_lineage(cheapest_per_item(carts, store_products))
    parts = {
        "best_single_store": _best(full, ["total_cost", "store_id"], ["n_items"]),
        "best_per_item_stores": split,
        "best_single_store_with_distance": _best(
            attach_distance(full, distances),
            ["total_cost", "distance_km", "duration_min", "store_id"],
            ["n_items"],
        ),
        "best_per_item_stores_with_distance": attach_distance(split, distances),
    }
    out = None
    for answer, part in parts.items():
        if "distance_km" not in part.columns:
            part = part.withColumn("distance_km", none_km).withColumn("duration_min", none_min)
        part = part.withColumn("answer", F.lit(answer)).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def nest_offers(items: DataFrame, stores: DataFrame) -> DataFrame:
    """Nested offers: store name, total and item list without internal ids."""
    shown = F.struct(
        "product_id",
        *[c for c in ("name", "price", "cart_link") if c in items.columns],
        "quantity",
        "total_price",
    )
    total = F.sum("total_price").cast(MONEY).alias("total_cost")
    lists = nest(items.where("cart_id is not null"), _offer_keys(items), shown, "items", total)
    named = lists.join(_by_store(stores.select("store_id", F.col("name").alias("store_name"))), "store_id")
    return named.select("cart_id", "store_id", "store_name", hide_internal_fields("items").alias("items"), "total_cost")


def hide_internal_fields(items: str) -> Column:
    return F.transform(items, lambda i: i.dropFields("product_id"))
