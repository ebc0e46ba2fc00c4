"""Session set-up, the folder all executors share, and the cut of long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "gondola") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("GONDOLA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may run without that setting, since there the driver
    and the executors share one disk; it gets one folder per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gondola-checkpoint-"))
    return context.getCheckpointDir()


def _hadoop_path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gondola/{name}-{uuid.uuid4().hex}"
    files, place = _hadoop_path(spark, path)
    files.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from there.

    Unlike a checkpoint, which keeps the size estimate of the plan it cuts, the
    result is sized by its files, so that estimates do not multiply from cut to
    cut and joins are planned by what is there. ``rows`` are the rows of a row group
    at most: a reader takes up to 4,096 of one into memory at once, too many of large rows.
    """
    path = shared_path(df.sparkSession, name)
    groups = {"parquet.block.row.count.limit": str(rows)} if rows else {}
    df.write.options(compression="zstd", **groups).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_buckets(df: DataFrame, keys: list[str], name: str = "cut") -> DataFrame:
    """As ``cut_lineage``, one file per bucket of ``keys``: groups and joins by these and more columns need no shuffle."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{path[-32:]}"
    dealt = df.repartition(count, *keys).write.format("parquet").option("compression", "zstd").option("path", path)
    dealt.bucketBy(count, *keys).saveAsTable(table)
    return spark.table(table)


@contextmanager
def joins_by_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join sides that lie in the same buckets where they are, also by more keys than those of the buckets.

    One bucket is one task then, so a bucket key must not hold a large share of the rows.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*cuts: DataFrame | None) -> None:
    """Remove the files of cuts that nothing reads any more; a loop calls it for the rounds behind it."""
    for df in cuts:
        for file in df.inputFiles()[:1] if df is not None else []:
            files, place = _hadoop_path(df.sparkSession, file.rpartition("/")[0])
            files.delete(place, True)
