"""Bronze, silver and gold tables on shared storage, and landed listing pages."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gondola.sources.stores import Store

OFFER_ITEMS = (
    "array<struct<sellers:array<struct<addToCartLink:string,commertialOffer:struct<Price:double,ListPrice:double>>>,"
    "images:array<struct<imageUrl:string>>>>"
)


def layer_path(root: str, layer: str, name: str | None = None) -> str:
    return f"{root.rstrip('/')}/{layer}" + (f"/{name}" if name else "")


def write_layer(df: DataFrame, root: str, layer: str, name: str, partition_by: list[str] | None = None) -> bool:
    """Replace one table of a layer with gzip Parquet.

    An empty result leaves the table of the last run in place; the return value
    says whether anything was written. Rows of a partition are brought together
    first, so that files grow with the partitions, not with partitions times tasks.
    """
    if skip_if_empty(df):
        return False
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(layer_path(root, layer, name))
    return True


def skip_if_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def read_layer(spark: SparkSession, root: str, layer: str, name: str | None = None, schema: str | None = None) -> DataFrame:
    """One table of a layer, or the column union of all its tables."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if name is not None:
        return reader.parquet(layer_path(root, layer, name))
    merged = reader.option("mergeSchema", "true").option("recursiveFileLookup", "true")
    return merged.parquet(layer_path(root, layer))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Concatenation by column name; missing columns are null, repeats stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def listing_schema(store: Store) -> str:
    return (
        "productName string, productId string, brand string, link string, "
        f"`{store.weight_column}` array<string>, `{store.measure_column}` array<string>, "
        f"items {OFFER_ITEMS}, clusterHighlights string, searchableClusters string"
    )


def read_listing_pages(spark: SparkSession, path: str, store: Store, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(listings, rejected values) of landed pages, one JSON array of listings per line.

    Rejected are lines that cannot be read and listings without a product id.

    Pages overlap at their borders; the repeats are kept unless ``distinct``.
    """
    page = ArrayType(StructType.fromDDL(listing_schema(store)))
    parsed = spark.read.text(path).select("value", F.from_json("value", page).alias("page"))
    bad = parsed.where("page is null and trim(value) <> ''").select("value")
    listings = parsed.where("page is not null").select(F.inline("page"))
    unnamed = listings.where("productId is null").select(F.to_json(F.struct("*")).alias("value"))
    bad = bad.unionByName(unnamed)
    listings = listings.where("productId is not null")
    return (listings.dropDuplicates(["productId"]) if distinct else listings), bad


def listing_union(pages: DataFrame, column: str = "listings") -> DataFrame:
    """Listings of every page, one row each."""
    return pages.select(*[c for c in pages.columns if c != column], F.explode(column).alias("listing"))


def read_lookup(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """Key and id columns of a catalogue table."""
    return read_layer(spark, root, "catalogue", table).select(*columns)


PUBLISHED_SCHEMA = "version string, attempt string, at long"


def _published(root: str) -> str:
    return layer_path(root, "catalogue_versions")


def write_catalogue(catalogue, root: str, version: str) -> None:
    """Write the four tables of a catalogue snapshot and then publish them together.

    Every call writes to a folder of its own; one line in the list of published
    versions, written last, makes it the one that is read. A call that ends before
    that leaves what was published as it was.
    """
    attempt = uuid.uuid4().hex
    for name, part in catalogue._asdict().items():
        part.write.parquet(layer_path(root, f"catalogue/{version}/{attempt}", name))
    spark = catalogue.brands.sparkSession
    line = spark.createDataFrame([(version, attempt, time.time_ns())], PUBLISHED_SCHEMA)
    line.coalesce(1).write.mode("append").json(_published(root))


def catalogue_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, attempt, at) of all published snapshots."""
    return spark.read.schema(PUBLISHED_SCHEMA).json(_published(root))


def read_catalogue(spark: SparkSession, root: str, version: str | None = None):
    """The four tables of the snapshot published last, of ``version`` if given."""
    from gondola.operators.catalogue import Catalogue

    known = catalogue_versions(spark, root)
    if version is not None:
        known = known.where(F.col("version") == version)
    last = known.agg(F.max_by(F.struct("version", "attempt"), F.struct("at", "attempt")).alias("last")).first().last
    if last is None:
        raise ValueError(f"no published catalogue {version or ''} in {root}")
    folder = f"catalogue/{last.version}/{last.attempt}"
    return Catalogue(*[read_layer(spark, root, folder, name) for name in Catalogue._fields])
