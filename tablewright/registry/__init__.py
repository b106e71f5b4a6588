"""The checked queries: each operator over the given tables, with the SQL that must agree.

A query is registered with its SQL where plain SQL can say it; the others are checked by
the tests. ``queries()`` and ``oracle_sql()`` are what the driver contract exposes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import configure

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data folder, by attribute; timestamps as session (UTC) timestamps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


    def dealt(self, name: str) -> DataFrame:
        """A table dealt out over the cores if its files make fewer partitions than that.

        Only for scans: asking a plan with shuffles for its partitions would run them.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _load() -> None:
    from tablewright.registry import (  # noqa: F401
        cleaning,
        corruption,
        encoding,
        joins,
        modelling,
        profiles,
        reshaping,
        sources,
        texts,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, folder: build(Tables(configure(spark), folder))

    return {name: bind(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
