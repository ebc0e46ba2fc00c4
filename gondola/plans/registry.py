"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gondola.plans.fixtures import view, with_views
from gondola.session import cut_in_buckets

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Lazy access to the views of one data folder: ``t.carts`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str, held: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._dir = sf_dir
        self._held = held or {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self._dir, name, self._held)

    def holding(self, names: list[str], keys: list[str]) -> Inputs:
        """The same views; those named are written once, in buckets of ``keys``, and read by all others."""
        held = dict(self._held)
        for name in names:
            held[name] = cut_in_buckets(view(self.spark, self._dir, name, held), keys, name)
        return Inputs(self.spark, self._dir, held)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a function of ``Inputs`` under ``name``."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, recursive=recursive)
        return build

    return register
