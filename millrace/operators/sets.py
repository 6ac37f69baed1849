"""Set operations and recursion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_by_name(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Columns that one side lacks are null there."""
    out = a.unionByName(b, allowMissingColumns=True)
    return out if all else out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def _written(df: DataFrame) -> DataFrame:
    """Parquet in the shared folder where there is one: a step of a loop doesn't repeat the steps before."""
    spark = df.sparkSession
    path = scratch(spark, "loop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """WITH RECURSIVE ... UNION ALL: ``step`` of the rows that the last round added, until it adds none."""
    found, new = anchor, _written(anchor)
    rounds: list[DataFrame] = [new]
    for _ in range(most):
        new = _written(step(new).select(*anchor.columns))
        if new.isEmpty():
            found = rounds[0]
            for r in rounds[1:]:
                found = found.unionAll(r)
            return found
        rounds.append(new)
        if len(rounds) >= 20:  # the union's plan stays small
            whole = rounds[0]
            for r in rounds[1:]:
                whole = whole.unionAll(r)
            rounds = [_written(whole)]
    raise RecursionError(f"no end after {most} rounds")


class HierarchyCycle(Exception):
    """A row is its own ancestor."""


def connect_by(
    df: DataFrame,
    start: Column,
    child: str,
    parent: str,
    paths: dict[str, str] | None = None,
    separator: str = "/",
    roots: Sequence[str] = (),
    nocycle: bool = False,
    most: int = 10_000,
) -> DataFrame:
    """START WITH ... CONNECT BY PRIOR child = parent.

    Adds LEVEL; ``paths`` maps new columns to columns for SYS_CONNECT_BY_PATH, ``roots`` names columns for
    CONNECT_BY_ROOT (as ``root_<name>``). Each round is an equi-join of the last level's rows with the table,
    which Spark plans; only the level's rows are carried. A cycle raises, or with ``nocycle`` ends the branch.
    """
    paths = paths or {}
    base = df.columns

    def own(level: Column, prior: DataFrame | None) -> list[Column]:
        out = [F.col(f"c.{c}").alias(c) for c in base]
        out.append(level.alias("level"))
        for name, source in paths.items():
            piece = F.concat(F.lit(separator), F.col(f"c.{source}").cast("string"))
            out.append((piece if prior is None else F.concat(F.col(f"p.{name}"), piece)).alias(name))
        for r in roots:
            out.append((F.col(f"c.{r}") if prior is None else F.col(f"p.root_{r}")).alias(f"root_{r}"))
        key = F.col(f"c.{child}").cast("string")
        out.append((F.array(key) if prior is None else F.array_append(F.col("p._seen"), key)).alias("_seen"))
        return out

    first = df.filter(start).alias("c").select(*own(F.lit(1), None))

    def step(level: DataFrame) -> DataFrame:
        met = df.alias("c").join(level.alias("p"), F.col(f"c.{parent}") == F.col(f"p.{child}"))
        again = F.array_contains(F.col("p._seen"), F.col(f"c.{child}").cast("string"))
        if nocycle:
            return met.filter(~again).select(*own(F.col("p.level") + 1, level))
        if not met.filter(again).isEmpty():
            raise HierarchyCycle("the hierarchy has a cycle")
        return met.select(*own(F.col("p.level") + 1, level))

    return recursive(first, step, most).drop("_seen")
