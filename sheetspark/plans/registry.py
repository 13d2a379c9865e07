"""Registry of queries: name -> function(spark, folder), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes; a table is scanned only when used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """New path in the shared checkpoint folder for data a query derives."""
        return scratch_path(self.spark, name)


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(function):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register
