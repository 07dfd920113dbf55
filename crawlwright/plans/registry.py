"""Registry of named queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy access to the tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Rows over all cores when the input has fewer splits than that; a large input stays as it is.

        For work that costs far more per row than the row's size, such as parsing pages.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    @property
    def html_pages(self) -> DataFrame:
        return self.spread(self.pages, "page_id")

    @property
    def texts(self) -> DataFrame:
        return self.spread(self.documents, "doc_id")


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # time stamps without a zone are read as UTC instants
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""
    def register(build):
        QUERIES[build.__name__] = Query(build.__name__, operators, build, sql)
        return build
    return register
