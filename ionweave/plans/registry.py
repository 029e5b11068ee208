"""A small registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionweave.sources.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]


class Views:
    """Views of one data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    """``QUERIES`` and ``ORACLES`` of a module; names begin with the operator's number in the inventory."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, make: Callable[[Views], DataFrame], sql: str | None = None, views: str = "") -> None:
        self.queries[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            self.oracles[name] = with_views(views, sql)
