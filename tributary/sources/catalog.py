"""Named tables: Parquet with a declared key, and states of a log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import folds
from tributary.operators.relational import KEY, scan

# The key column of each supplied table; none means all columns.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}


@dataclass
class Catalog:
    spark: SparkSession
    providers: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, key) -> None:
        self.providers[name] = lambda: scan(df, key)

    def register_log(self, name: str, log: DataFrame, schema: str, upto: int | None = None) -> None:
        """A table of the log: its rows' plain-JSON values parsed under a declared schema."""

        def provide() -> DataFrame:
            rows = folds.fold(log, upto).where(folds.table_of(F.col("key")) == name)
            typed = rows.select(folds.pk_of(F.col("key")).alias(KEY), F.from_json("value", schema).alias("r"))
            return typed.select(KEY, *(f"r.{c}" for c in sorted(typed.schema["r"].dataType.names)))

        self.providers[name] = provide

    def table(self, name: str) -> DataFrame:
        """An unknown table is empty."""
        if name not in self.providers:
            return self.spark.createDataFrame([], f"{KEY} string")
        return self.providers[name]()


def parquet_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The supplied tables with their keys; nothing is read before a query runs."""
    catalog = Catalog(spark)
    for name, key in KEYS.items():
        catalog.providers[name] = lambda name=name, key=key: scan(spark.read.parquet(f"{folder}/{name}.parquet"), key)
    every = lambda df: F.to_json(F.struct(*sorted(df.columns)))
    catalog.providers["lineitem"] = lambda: scan(df := spark.read.parquet(f"{folder}/lineitem.parquet"), every(df))
    catalog.providers["conversations"] = lambda: scan(spark.read.parquet(f"{folder}/conversations.parquet"), F.format_string("%d:%d", "conv_id", "turn"))
    return catalog
