"""A book of queries: each has a name, a function of (spark, root), and SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables below one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        self.__dict__[name] = df = table(self.spark, self.root, name)
        return df


class Book:
    def __init__(self) -> None:
        self.entries: dict[str, tuple[Query, str | None]] = {}

    def add(self, name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.entries:
            raise ValueError(f"two queries are called {name}")
        self.entries[name] = (lambda spark, root: make(Tables(spark, root)), sql)
