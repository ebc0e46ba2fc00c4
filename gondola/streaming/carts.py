"""Cart state from add, update, remove and clear events.

The state of a (cart, item) after a run of events depends on four positions
only: the last clear of the cart, the last removal of the item, the first add
after both, and the last quantity update after that add. Each is one
aggregation, so a cart or item with any number of events is combined on the map
side and no task replays a cart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "seq bigint, ts timestamp, cart_id bigint, action string, item_key string, quantity int"
STATE_SCHEMA = "cart_id bigint, item_key string, quantity int, added_seq bigint"


def _after(events: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Events after the mark of their key; all of them where there is no mark."""
    joined = events.join(marks, keys, "left")
    return joined.where(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))).drop("_mark")


def cart_state(events: DataFrame) -> DataFrame:
    """(cart_id, item_key, quantity, added_seq) after all events.

    ``seq`` orders the events. An event with action ``seed`` places an item with
    its quantity, which is how a stored cart enters.
    """
    item = ["cart_id", "item_key"]
    events = events.select("seq", *item, "action", "quantity")
    cleared = events.where("action = 'clear'").groupBy("cart_id").agg(F.max("seq").alias("_mark"))
    live = _after(events.where("action <> 'clear'"), cleared, ["cart_id"])
    removed = live.where("action = 'remove'").groupBy(*item).agg(F.max("seq").alias("_mark"))
    live = _after(live.where("action <> 'remove'"), removed, item)
    placed = live.where("action in ('add', 'seed')").groupBy(*item).agg(F.min("seq").alias("_first"))
    present = live.join(placed, item).where("seq >= _first")
    sets = F.col("action").isin("update", "seed")
    last_set = present.where(sets).groupBy(*item).agg(
        F.max("seq").alias("_set"), F.max_by("quantity", "seq").alias("_quantity")
    )
    counted = present.join(last_set, item, "left").where(
        F.col("_set").isNull() | (F.col("seq") >= F.col("_set"))
    )
    return counted.groupBy(*item).agg(
        (F.coalesce(F.max("_quantity"), F.lit(0)) + F.count_if(F.col("action") == "add")).cast("int").alias("quantity"),
        F.min("_first").alias("added_seq"),
    )


def advance(snapshot: DataFrame, clock: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, new clock, late events) after one batch.

    ``clock`` has the highest seq seen per cart. Events at or below it came too
    late and are set aside instead of being applied out of order.
    """
    dated = batch.join(clock.withColumnRenamed("last_seq", "_last"), "cart_id", "left")
    late = dated.where("seq <= _last").drop("_last")
    fresh = dated.where("_last is null or seq > _last").drop("_last")
    touched = fresh.select("cart_id").distinct()
    columns = ["seq", "cart_id", "item_key", "action", "quantity"]
    seeds = snapshot.join(touched, "cart_id", "left_semi").select(
        F.col("added_seq").alias("seq"), "cart_id", "item_key", F.lit("seed").alias("action"), "quantity"
    )
    moved = cart_state(seeds.unionByName(fresh.select(*columns)))
    kept = snapshot.join(touched, "cart_id", "left_anti")
    seen = fresh.groupBy("cart_id").agg(F.max("seq").alias("last_seq"))
    clock = clock.unionByName(seen).groupBy("cart_id").agg(F.max("last_seq").alias("last_seq"))
    return kept.unionByName(moved.select(*kept.columns)), clock, late


#: Every so many batches the whole state is written; the others write the carts they touch.
FULL_EVERY = 16
CLOCK_SCHEMA = "cart_id bigint, last_seq bigint"


def _version(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/version={batch_id:012d}"


def _written(spark: SparkSession, root: str, batch_id: int, part: str, schema: str) -> DataFrame:
    """One part of the versions from the last whole one up to ``batch_id``, with the version of each row."""
    if batch_id < 0:
        return spark.createDataFrame([], f"{schema}, version bigint")
    versions = range(batch_id - batch_id % FULL_EVERY, batch_id + 1)
    paths = [f"{_version(root, v)}/{part}" for v in versions]
    rows = spark.read.schema(f"{schema}, version bigint").option("basePath", root).parquet(*paths)
    return rows.withColumn("version", F.col("version").cast("bigint"))


def _newest(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """The rows of each cart in the version that wrote it last."""
    return rows.join(clock.select("cart_id", "version"), ["cart_id", "version"], "left_semi").drop("version")


def _clock(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """(cart_id, last_seq, version): the highest seq of every cart and the version that wrote it last."""
    rows = _written(spark, root, batch_id, "clock", CLOCK_SCHEMA)
    return rows.groupBy("cart_id").agg(F.max("last_seq").alias("last_seq"), F.max("version").alias("version"))


def read_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The state of all carts after one batch."""
    rows = _written(spark, root, batch_id, "carts", STATE_SCHEMA)
    return _newest(rows, _clock(spark, root, batch_id))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _late_versions(spark: SparkSession, root: str, versions: list[int]) -> set[int]:
    """Those of ``versions`` that set events aside."""
    paths = [f"{_version(root, v)}/late" for v in versions]
    paths = [p for p in paths if (at := _hadoop(spark, p))[0].exists(at[1])]
    if not paths:
        return set()
    rows = spark.read.schema(f"{EVENT_SCHEMA}, version bigint").option("basePath", root).parquet(*paths)
    return {r.version for r in rows.select("version").distinct().collect()}


def _drop_before(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove the carts and clocks of the ``FULL_EVERY`` batches before ``batch_id``; late events stay.

    No later version has the events a batch set aside, so its folder goes only without any.
    """
    versions = list(range(max(0, batch_id - FULL_EVERY), batch_id))
    held = _late_versions(spark, root, versions)
    for old in versions:
        for part in ("/carts", "/clock") if old in held else ("",):
            system, place = _hadoop(spark, _version(root, old) + part)
            system.delete(place, True)


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """All events that came too late, with the version of the batch that set them aside."""
    rows = spark.read.schema(f"{EVENT_SCHEMA}, version bigint").option("basePath", root)
    return rows.parquet(f"{root.rstrip('/')}/version=*/late")


def start_cart_state(
    events: DataFrame, root: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep cart snapshots up to date from a stream of events.

    Every micro-batch writes its own version under ``root``, a folder all executors
    share: the carts it touches, and every ``FULL_EVERY`` batches all of them. What is
    written follows the batch, and reading meets at most ``FULL_EVERY`` versions. A
    batch that is run again overwrites the same version, so the result does not
    change. When the same stream is resumed the versions before are found by the
    batch id. The carts between two whole versions go when a third is complete; events
    that came too late stay with the version that set them aside (``read_late``).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        clock = _clock(session, root, batch_id - 1)
        kept = batch.persist()
        try:
            if batch_id % FULL_EVERY:
                clock = clock.join(kept.select("cart_id").distinct(), "cart_id", "left_semi")
            clock = clock.persist()
            snapshot = _newest(_written(session, root, batch_id - 1, "carts", STATE_SCHEMA), clock)
            parts = dict(zip(("carts", "clock", "late"), advance(snapshot, clock.drop("version"), kept)))
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{_version(root, batch_id)}/{name}")
        finally:
            clock.unpersist()
            kept.unpersist()
        if batch_id % FULL_EVERY == 1 and batch_id > FULL_EVERY:  # the whole version before is committed
            _drop_before(session, root, batch_id - 1 - FULL_EVERY)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cart_item_count(state: DataFrame) -> DataFrame:
    return state.groupBy("cart_id").agg(F.sum("quantity").alias("n_items"))


def distinct_cart_stores(items: DataFrame) -> DataFrame:
    """Distinct (cart_id, store) over the ``stores`` arrays of a cart's items."""
    return items.select("cart_id", F.explode("stores").alias("store")).distinct()
