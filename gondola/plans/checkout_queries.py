"""Checkout queries: carts, store offers and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import routes as R
from gondola.operators import checkout as C
from gondola.plans.registry import Inputs, query

OFFERS = """
offers AS (
  SELECT c.cart_id, s.store_id, CAST(sum(c.quantity * s.price) AS DECIMAL(38,2)) AS total_cost, count(*) AS n_items
  FROM carts c JOIN store_products s ON s.product_id = c.product_id GROUP BY c.cart_id, s.store_id),
sizes AS (SELECT cart_id, count(*) AS n FROM carts GROUP BY cart_id),
full_offers AS (SELECT o.* FROM offers o JOIN sizes z ON z.cart_id = o.cart_id AND z.n = o.n_items)"""

CHEAPEST = """
cheapest AS (
  SELECT store_id, product_id, price FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS rn FROM store_products) x
  WHERE rn = 1),
split_offers AS (
  SELECT c.cart_id, s.store_id, CAST(sum(c.quantity * s.price) AS DECIMAL(38,2)) AS total_cost, count(*) AS n_items
  FROM carts c JOIN cheapest s ON s.product_id = c.product_id GROUP BY c.cart_id, s.store_id)"""

BEST = """
best AS (SELECT cart_id, total_cost, store_id, n_items FROM (
    SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY total_cost, store_id) AS rn FROM full_offers) x
  WHERE rn = 1),
best_near AS (SELECT cart_id, total_cost, distance_km, duration_min, store_id, n_items FROM (
    SELECT o.*, d.distance_km, d.duration_min,
      row_number() OVER (PARTITION BY o.cart_id ORDER BY o.total_cost, d.distance_km, d.duration_min, o.store_id) AS rn
    FROM full_offers o JOIN distances d ON d.store_id = o.store_id) x
  WHERE rn = 1)"""

BASE = ("carts", "store_products")
NEAR = ("carts", "store_products", "distances")


@query("a11_cheapest_single_store", f"+ {OFFERS}, {BEST} SELECT * FROM best", NEAR)
def a11(t: Inputs):
    return C.cheapest_single_store(t.carts, t.store_products)


@query(
    "j7_cart_offers",
    """SELECT c.product_id, c.cart_id, c.quantity, s.store_id, s.price,
         CAST(c.quantity * s.price AS DECIMAL(38,2)) AS total_price
       FROM carts c JOIN store_products s ON s.product_id = c.product_id""",
    BASE,
)
def j7(t: Inputs):
    return C.cart_offers(t.carts, t.store_products)


@query("a9_offer_by_store", f"+ {OFFERS} SELECT * FROM offers", BASE)
def a9(t: Inputs):
    return C.offer_by_store(C.cart_offers(t.carts, t.store_products, by_cart=True))


@query("a10_covers_whole_cart", f"+ {OFFERS} SELECT * FROM full_offers", BASE)
def a10(t: Inputs):
    return C.full_offers(t.carts, t.store_products)


@query("a12_cheapest_per_item", f"+ {CHEAPEST} SELECT * FROM split_offers", BASE)
def a12(t: Inputs):
    return C.cheapest_per_item(t.carts, t.store_products)


@query("a13_cheapest_single_store_with_distance", f"+ {OFFERS}, {BEST} SELECT * FROM best_near", NEAR)
def a13(t: Inputs):
    return C.cheapest_single_store_with_distance(t.carts, t.store_products, t.distances)


@query(
    "a14_cheapest_per_item_with_distance",
    f"""+ {CHEAPEST} SELECT o.*, d.distance_km, d.duration_min
        FROM split_offers o JOIN distances d ON d.store_id = o.store_id""",
    NEAR,
)
def a14(t: Inputs):
    return C.cheapest_per_item_with_distance(t.carts, t.store_products, t.distances)


@query(
    "a15_cart_result",
    f"""+ {OFFERS}, {BEST}, {CHEAPEST}
    SELECT cart_id, 'best_single_store' AS answer, store_id, total_cost, n_items,
           CAST(NULL AS DECIMAL(10,2)) AS distance_km, CAST(NULL AS INT) AS duration_min FROM best
    UNION ALL SELECT cart_id, 'best_per_item_stores', store_id, total_cost, n_items, NULL, NULL FROM split_offers
    UNION ALL SELECT cart_id, 'best_single_store_with_distance', store_id, total_cost, n_items,
           distance_km, duration_min FROM best_near
    UNION ALL SELECT o.cart_id, 'best_per_item_stores_with_distance', o.store_id, o.total_cost, o.n_items,
           d.distance_km, d.duration_min FROM split_offers o JOIN distances d ON d.store_id = o.store_id""",
    NEAR,
)
def a15(t: Inputs):
    return C.cart_result(t.carts, t.store_products, t.distances)


@query(
    "w2_cheapest_offer",
    f"+ {CHEAPEST} SELECT * FROM cheapest",
    BASE,
)
def w2(t: Inputs):
    return C.cheapest_offer(t.store_products)


@query(
    "j8_offers_without_distance",
    f"+ {OFFERS} SELECT * FROM offers o WHERE NOT EXISTS (SELECT 1 FROM distances d WHERE d.store_id = o.store_id)",
    NEAR,
)
def j8_rejects(t: Inputs):
    return C.offers_without_distance(C.offer_by_store(C.cart_offers(t.carts, t.store_products, by_cart=True)), t.distances)


@query(
    "j8_attach_distance",
    f"""+ {OFFERS} SELECT o.*, d.distance_km, d.duration_min FROM offers o
        JOIN distances d ON d.store_id = o.store_id""",
    NEAR,
)
def j8(t: Inputs):
    return C.attach_distance(C.offer_by_store(C.cart_offers(t.carts, t.store_products, by_cart=True)), t.distances)


@query(
    "j6_offers_with_store",
    """SELECT p.store_id, p.product_id, p.price, s.slug, s.name, s.address
       FROM store_products p JOIN stores s ON s.store_id = p.store_id""",
    ("store_products", "stores"),
)
def j6(t: Inputs):
    return C.offers_with_store(t.store_products, t.stores)


@query(
    "p5_offers_for_products",
    "SELECT * FROM store_products WHERE product_id IN (SELECT product_id FROM carts WHERE quantity > 40)",
    BASE,
)
def p5(t: Inputs):
    return C.offers_for_products(t.store_products, t.carts.where("quantity > 40"))


REQUESTS = """
requests AS (
  SELECT o.o_orderkey AS cart_id,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN ' ' ELSE concat('cep ', CAST(o.o_custkey AS VARCHAR(12))) END AS origin,
    CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE 'centro' END AS destination,
    CASE CAST(o.o_orderkey % 6 AS INT) WHEN 0 THEN 'bicycle' WHEN 1 THEN 'Car' WHEN 2 THEN 'motorcycle'
      WHEN 3 THEN 'walking' WHEN 4 THEN 'boat' ELSE NULL END AS travel_mode,
    CAST(o.o_orderkey % 100 AS INT) AS n
  FROM orders o)"""


def _requests(t: Inputs):
    t.orders.createOrReplaceTempView("orders")
    flat = t.spark.sql(f"WITH {REQUESTS} SELECT * FROM requests")
    stores = F.when(F.col("n") % 9 == 0, F.array()).otherwise(
        F.array(
            F.concat(F.lit("supplier-"), F.lpad(F.col("n").cast("string"), 9, "0")),
            F.when(F.col("n") % 7 == 0, F.lit(" ")).otherwise(F.lit("supplier-000000001")),
        )
    )
    return flat.withColumn("stores", stores)


REASON = """
judged AS (
  SELECT r.cart_id, CASE
    WHEN z.cart_id IS NULL THEN 'no products'
    WHEN trim(origin) = '' THEN 'origin'
    WHEN trim(destination) = '' THEN 'destination'
    WHEN travel_mode IS NULL THEN 'travel_mode'
    WHEN n % 9 = 0 OR n % 7 = 0 THEN 'stores' END AS reason, travel_mode
  FROM requests r LEFT JOIN (SELECT DISTINCT cart_id FROM carts) z ON z.cart_id = r.cart_id)"""


@query("p9_validate_cart_rejected", f"+ {REQUESTS}, {REASON} SELECT cart_id, reason FROM judged WHERE reason IS NOT NULL", ("carts",))
def p9_rejected(t: Inputs):
    return C.validate_cart(_requests(t), t.carts)[1].select("cart_id", "reason")


@query(
    "p9_validate_cart_accepted",
    f"""+ {REQUESTS}, {REASON} SELECT cart_id, CASE lower(travel_mode) WHEN 'bicycle' THEN 'BICYCLE'
        WHEN 'car' THEN 'DRIVE' WHEN 'motorcycle' THEN 'TWO_WHEELER' WHEN 'walking' THEN 'WALK' ELSE '' END AS mode
        FROM judged WHERE reason IS NULL""",
    ("carts",),
)
def p9_accepted(t: Inputs):
    good = C.validate_cart(_requests(t), t.carts)[0]
    return good.select("cart_id", R.travel_mode_code(F.col("travel_mode")).alias("mode"))


@query(
    "p6_stores_by_slug",
    f"""+ {REQUESTS}, wanted AS (
          SELECT concat('supplier-', lpad(CAST(n AS VARCHAR), 9, '0')) AS slug FROM requests WHERE n % 9 <> 0
          UNION SELECT 'supplier-000000001' FROM requests WHERE n % 9 <> 0 AND n % 7 <> 0)
        SELECT slug, store_id, name, address FROM stores WHERE slug IN (SELECT slug FROM wanted)""",
    ("stores",),
)
def p6(t: Inputs):
    return C.stores_by_slug(_requests(t), t.stores)


@query(
    "j9_zip_stores_routes",
    """SELECT o.o_orderkey AS cart_id, CAST(k AS INT) AS pos, CAST((o.o_orderkey + k) % 10 AS INT) AS store_id,
         concat('payload ', CAST((o.o_orderkey + k) % 10 AS VARCHAR)) AS payload
       FROM orders o, range(3) g(k)""",
)
def j9(t: Inputs):
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: ((F.col("o_orderkey") + k) % 10).cast("int"))
    requests = t.orders.select(
        F.col("o_orderkey").alias("cart_id"),
        ids.alias("store_ids"),
        F.transform(ids, lambda i: F.concat(F.lit("payload "), i.cast("string"))).alias("payloads"),
    )
    return C.zip_stores_routes(requests)


@query(
    "f36_first_leg",
    """SELECT CAST(s_suppkey AS INT) AS store_id,
         CAST(round(CAST((s_suppkey * 7919) % 50000 AS DECIMAL(18,3)) * 0.001, 2) AS DECIMAL(10,2)) AS distance_km,
         CAST(round_even(((s_suppkey * 31) % 5400) / 60.0, 0) AS INT) AS duration_min FROM supplier""",
)
def f36(t: Inputs):
    return C.distances_from_routes(t.routes)[0]


@query(
    "f34_parse_duration",
    """SELECT event_id, CAST(round_even(CAST(event_id % 600 AS DOUBLE) / 60, 0) AS INT) AS minutes,
         CAST(NULL AS INT) AS bad FROM events""",
)
def f34(t: Inputs):
    seconds = (F.col("event_id") % 600).cast("string")
    return t.events.select(
        "event_id",
        R.parse_duration_min(F.concat(seconds, F.lit("s"))).alias("minutes"),
        R.parse_duration_min(F.concat(seconds, F.lit(".5s"))).alias("bad"),
    )


@query(
    "f35_meters_to_km",
    "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001, 2) AS DECIMAL(10,2)) AS km FROM orders",
)
def f35(t: Inputs):
    return t.orders.select("o_orderkey", R.meters_to_km(F.col("o_totalprice")).alias("km"))


@query(
    "f37_null_if_zero",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem",
)
def f37(t: Inputs):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        R.null_if_zero(F.col("l_discount")).alias("discount"),
        R.null_if_zero(F.col("l_tax")).alias("tax"),
    )


@query(
    "p14_cart_to_request",
    """SELECT cart_id, product_id, quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY pos DESC) AS rn FROM cart_lines) x
       WHERE rn = 1""",
    ("cart_lines",),
)
def p14(t: Inputs):
    return C.cart_to_request(t.cart_lines)


@query(
    "x5_covers",
    """+ need AS (SELECT cart_id, list(product_id) AS wanted FROM carts GROUP BY cart_id),
         have AS (SELECT c.cart_id, s.store_id, list(c.product_id) AS held
                  FROM carts c JOIN store_products s ON s.product_id = c.product_id GROUP BY c.cart_id, s.store_id)
       SELECT h.cart_id, h.store_id FROM have h JOIN need n ON n.cart_id = h.cart_id
       WHERE list_has_all(h.held, n.wanted)""",
    BASE,
)
def x5(t: Inputs):
    return C.full_offers(t.carts, t.store_products).select("cart_id", "store_id")


@query(
    "p11_nested_offers",
    """SELECT cart_id, store_id, store_name, CAST(sum(total_price) AS DECIMAL(38,2)) AS total_cost,
         count(*) AS n_items, string_agg(concat(CAST(quantity AS VARCHAR), 'x', CAST(price AS VARCHAR)), ' '
           ORDER BY product_id) AS items
       FROM (SELECT c.*, s.store_id, s.price, CAST(c.quantity * s.price AS DECIMAL(38,2)) AS total_price, t.name AS store_name
             FROM carts c JOIN store_products s ON s.product_id = c.product_id JOIN stores t ON t.store_id = s.store_id) x
       GROUP BY cart_id, store_id, store_name""",
    ("carts", "store_products", "stores"),
)
def p11(t: Inputs):
    nested = C.nest_offers(C.cart_offers(t.carts, t.store_products, by_cart=True, most=C.NESTED_ROWS), t.stores)
    shown = F.transform(
        "items", lambda i: F.concat(i["quantity"].cast("string"), F.lit("x"), i["price"].cast("string"))
    )
    return nested.select(
        "cart_id", "store_id", "store_name", "total_cost",
        F.size("items").cast("long").alias("n_items"), F.array_join(shown, " ").alias("items"),
    )
