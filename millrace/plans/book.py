"""A book of queries, each with the SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """``t.lineitem`` is the table of that name in the query's folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register a function of ``Tables`` under its name, with its SQL if SQL can say it."""

        def mark(f: Callable[[Tables], DataFrame]) -> Callable:
            n = name or f.__name__
            if n in self.queries:
                raise ValueError(f"{n} is there already")
            self.queries[n] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[n] = sql
            return f

        return mark

    def columns(self, name: str, source: str, keys: list[str], **items: tuple[Callable[[], Column], str]) -> None:
        """A query of one table's ``keys`` and of items: (builder of a column, SQL expression)."""

        def build(t: Tables) -> DataFrame:
            return getattr(t, source).select(*keys, *(f().alias(n) for n, (f, _) in items.items()))

        sql = f"SELECT {', '.join([*keys, *(f'{s} AS {n}' for n, (_, s) in items.items())])} FROM {source}"
        self.query(sql, name)(build)

    def totals(self, name: str, source: str, keys: list[str], **items: tuple[Callable[[], Column], str]) -> None:
        """The same for aggregates over groups of ``keys``."""

        def build(t: Tables) -> DataFrame:
            return getattr(t, source).groupBy(*keys).agg(*(f().alias(n) for n, (f, _) in items.items()))

        group = f" GROUP BY {', '.join(keys)}" if keys else ""
        sql = f"SELECT {', '.join([*keys, *(f'{s} AS {n}' for n, (_, s) in items.items())])} FROM {source}{group}"
        self.query(sql, name)(build)
