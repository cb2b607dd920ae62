"""Every query of the library by its operator key, with its DuckDB twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def steps(self) -> DataFrame:
        return self.as_steps(self.lineitem)

    def as_steps(self, lines: DataFrame) -> DataFrame:
        """Order lines as the steps of a sequence, in a total order; discount and tax without negative zeros."""
        order = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey")
        plus = lambda c: (F.col(c) + F.lit(0.0)).alias(c)
        return lines.select("l_orderkey", F.row_number().over(order).alias("step"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", plus("l_discount"), plus("l_tax"), "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("l_shipdate"))


STEPS = """steps AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS step,
  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_returnflag, l_linestatus, l_shipdate::DATE AS l_shipdate FROM lineitem)"""


def query(name: str, sql: str | None = None):
    """Register ``run(tables)`` under an operator key."""

    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql:
            SQL[name] = sql.replace("{STEPS}", STEPS)
        return run

    return register


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["pool_slices"](spark, folder)


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"tidemark.queries.{name}")


MODULES = ("scalars", "selections", "windows", "joins", "aggregates", "estimates", "sources", "streams")
