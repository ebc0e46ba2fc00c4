"""Store configuration: one row per store instead of one class per store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Store:
    store_id: int
    slug: str
    name: str
    address: str
    weight_column: str
    measure_column: str
    drops_original: bool = False

    @property
    def columns(self) -> dict[str, str]:
        return {
            "productName": "name",
            "productId": "ref_id",
            self.weight_column: "weight",
            self.measure_column: "measure",
        }


# The three stores, their addresses and their source columns.
STORES = (
    Store(1, "angeloni", "Angeloni", "Av. Centenário, 2699 - Centro, Criciúma - SC, 88802-000",
          "Quantidade da embalagem", "Unidade de medida"),
    Store(2, "bistek", "Bistek", "Av. Centenário, 3420 - Centro, Criciúma - SC, 88802-000",
          "Peso Produto", "Unidade de Medida"),
    Store(3, "giassi", "Giassi", "R. Henrique Lage, 1251 - Santa Barbara, Criciúma - SC, 88804-010",
          "multiplicador", "unidade", drops_original=True),
)

STORE_SCHEMA = "store_id int, slug string, name string, address string"


def store(slug: str) -> Store:
    return next(s for s in STORES if s.slug == slug)


def seed_stores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.store_id, s.slug, s.name, s.address) for s in STORES], STORE_SCHEMA)
