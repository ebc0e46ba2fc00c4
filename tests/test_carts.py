import random

from pyspark.sql import functions as F

from gondola.streaming import carts as R

COLUMNS = "seq long, ts timestamp, cart_id long, action string, item_key string, quantity int"


def events(n, seed, start=0):
    rng = random.Random(seed)
    # One cart has a third of all events.
    return [
        (start + i, None, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), rng.choices(["add", "update", "remove", "clear"], [6, 3, 2, 1])[0],
         str(rng.randrange(3)), rng.randrange(10))
        for i in range(n)
    ]


def replay(rows):
    carts = {}
    for seq, _, cart, action, key, quantity in sorted(rows):
        items = carts.setdefault(cart, {})
        if action == "add":
            items[key] = (items[key][0] + 1, items[key][1]) if key in items else (1, seq)
        elif action == "update" and key in items:
            items[key] = (quantity, items[key][1])
        elif action == "remove":
            items.pop(key, None)
        elif action == "clear":
            items.clear()
    return {(c, k, *v) for c, items in carts.items() for k, v in items.items()}


def state(df):
    return {(r.cart_id, r.item_key, r.quantity, r.added_seq) for r in df.collect()}


def test_batch_state_equals_replay(spark):
    for seed in (1, 2, 3):
        rows = events(400, seed)
        df = spark.createDataFrame(rows, COLUMNS).repartition(5)
        assert state(R.cart_state(df)) == replay(rows)


def test_stream_of_several_batches_with_late_events(spark, tmp_path):
    landed, root, offsets = (str(tmp_path / p) for p in ("landed", "state", "offsets"))
    rows = []
    for batch in range(3):
        part = events(120, 10 + batch, start=1000 * batch)
        rows += part
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(R.EVENT_SCHEMA).parquet(landed)
        R.start_cart_state(stream, root, offsets).awaitTermination()
        assert state(R.read_state(spark, root, batch)) == replay(rows)
    late = [(5, None, 0, "clear", "0", 0)]
    spark.createDataFrame(late, COLUMNS).coalesce(1).write.mode("append").parquet(landed)
    R.start_cart_state(spark.readStream.schema(R.EVENT_SCHEMA).parquet(landed), root, offsets).awaitTermination()
    assert state(R.read_state(spark, root, 3)) == replay(rows)
    assert spark.read.parquet(f"{root}/version=000000000003/late").count() == 1


def test_whole_versions_and_touched_carts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FULL_EVERY", 3)
    landed, root, offsets = (str(tmp_path / p) for p in ("landed", "state", "offsets"))
    rows = []
    for batch in range(8):
        part = [(s, t, batch % 4 if batch else c, *r) for s, t, c, *r in events(30, 40 + batch, start=100 * batch)]
        rows += part
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(landed)
        R.start_cart_state(spark.readStream.schema(R.EVENT_SCHEMA).parquet(landed), root, offsets).awaitTermination()
        assert state(R.read_state(spark, root, batch)) == replay(rows)
    written = {p.name[-1]: {r.cart_id for r in spark.read.parquet(f"{p}/clock").collect()} for p in (tmp_path / "state").iterdir()}
    assert set(written) == set("34567")  # 0, 1 and 2 went when 6 was committed
    assert written["4"] == {0} and written["7"] == {3} and len(written["6"]) == len({r[2] for r in rows})


def test_late_events_outlive_their_version(spark, tmp_path):
    root = str(tmp_path / "state")
    rows = spark.createDataFrame([(7, None, 1, "clear", "0", 0)], R.EVENT_SCHEMA).coalesce(1)
    for version in range(3):
        for part in ("carts", "clock", "late"):
            held = rows if version != 1 else rows.limit(0)
            held.write.parquet(f"{R._version(root, version)}/{part}")
    for _ in range(2):  # the batch may be run again
        R._drop_before(spark, root, 2)
        left = {f"{p.parent.name[-1]}/{p.name}" for p in (tmp_path / "state").glob("version=*/*")}
        assert left == {"0/late", "2/carts", "2/clock", "2/late"}  # version 1 set nothing aside
    assert [(r.version, r.seq) for r in R.read_late(spark, root).orderBy("version").collect()] == [(0, 7), (2, 7)]


def test_running_a_batch_again_gives_the_same(spark):
    first, second = events(100, 5), events(100, 6, start=500)
    empty = spark.createDataFrame([], R.STATE_SCHEMA), spark.createDataFrame([], "cart_id long, last_seq long")
    s1, c1, _ = R.advance(*empty, spark.createDataFrame(first, COLUMNS))
    batch = spark.createDataFrame(second, COLUMNS)
    one, two = R.advance(s1, c1, batch), R.advance(s1, c1, batch)
    assert state(one[0]) == state(two[0]) == replay(first + second)


def test_counts_and_stores(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, [])], "cart_id long, stores array<string>")
    assert sorted(map(tuple, R.distinct_cart_stores(df).collect())) == [(1, "a"), (1, "b")]
    counts = R.cart_item_count(df.select("cart_id", F.lit(2).alias("quantity")))
    assert {r.cart_id: r.n_items for r in counts.collect()} == {1: 4, 2: 2}
