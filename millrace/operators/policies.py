"""Governance: policies rewrite what a reader sees, as filters and projections over a relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_access(df: DataFrame, policy: Column) -> DataFrame:
    """Rows for which the policy is true."""
    return df.filter(F.coalesce(policy, F.lit(False)))


def masked(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Columns as their masks show them."""
    return df.withColumns({c: m.cast(df.schema[c].dataType) for c, m in masks.items()})


def projected(df: DataFrame, refused: Sequence[str]) -> DataFrame:
    """Columns that a projection policy refuses aren't selectable."""
    return df.drop(*refused)


def aggregated(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], min_group_size: int) -> DataFrame:
    """An aggregation policy: groups under the least size are left out."""
    out = df.groupBy(*keys).agg(F.count("*").alias("_size"), *(v.alias(k) for k, v in aggregates.items()))
    return out.filter(F.col("_size") >= min_group_size).drop("_size")


def joined(df: DataFrame, other: DataFrame | None, on: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """A join policy: the relation is only read through a join on allowed columns."""
    if other is None or not set(on) <= set(allowed):
        raise PermissionError(f"a join on {', '.join(allowed)} is required")
    return df.join(other, list(on))


def metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Data metrics of each column in one pass: rows, nulls, blanks, distinct values (estimated), least and greatest."""
    cols = list(columns or df.columns)
    parts = []
    for c in cols:
        s = F.col(c).cast("string")
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"),
                F.count_if(F.trim(s) == "").alias("blank_count"), F.approx_count_distinct(c).alias("unique_estimate"), F.min(s).alias("min"), F.max(s).alias("max"),
            )
        )
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: violations of a unique constraint."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows whose non-null keys have no parent: violations of a foreign key."""
    cond = F.lit(True)
    present = F.lit(True)
    for c, p in keys.items():
        cond = cond & (df[c] == parent[p])
        present = present & df[c].isNotNull()
    return df.filter(present).join(parent, cond, "left_anti")
