"""Registration of queries: a Spark plan and, where SQL can say it, the same result as ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.session import configure, spread
from foliograph.sources import derived


class Tables:
    """Lazy access to the input tables and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "web_pages":
            return spread(derived.table(self.spark, self.sf_dir, "pages"))
        if name in ("documents", "conversations"):
            return spread(derived.table(self.spark, self.sf_dir, name))
        if name in derived.TABLES:
            return derived.table(self.spark, self.sf_dir, name)
        return derived.relation(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(tables) -> DataFrame`` as a query, with its oracle built on named CTEs."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            from foliograph.catalog.sql import with_ctes

            ORACLES[name] = with_ctes(ctes.split(), sql)
        return fn

    return register
