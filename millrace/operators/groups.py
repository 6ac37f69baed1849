"""Grouping, pivots and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import scratch


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: dict[str, Column], grouping_id: str | None = None) -> DataFrame:
    """GROUP BY GROUPING SETS: keys that a set leaves out are null."""
    names = list(dict.fromkeys(k for s in sets for k in s))
    extra = [F.grouping_id(*names).alias(grouping_id)] if grouping_id else []
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, names)).agg(*(v.alias(k) for k, v in aggregates.items()), *extra)


def beside(keys: Sequence[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """The aggregates of several groupings by the same keys, a row for each group that all have; null keys are equal."""
    for other in others:
        made = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        first = first.join(made, same).drop(*(f"_k{i}" for i in range(len(keys))))
    return first


def group_by_all(df: DataFrame, keys: dict[str, Column], aggregates: dict[str, Column]) -> DataFrame:
    """GROUP BY ALL: every item that isn't an aggregate is a key."""
    return df.groupBy(*(v.alias(k) for k, v in keys.items())).agg(*(v.alias(k) for k, v in aggregates.items()))


#: More values than this make no pivot: each is a column of the plan.
PIVOT_VALUES = 10_000


def pivot(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    aggregate: Column,
    values: Sequence | DataFrame | None = None,
    default: object = None,
    names: dict | None = None,
) -> DataFrame:
    """PIVOT (aggregate FOR column IN (values)). ``values``: a list, a subquery, or None for ANY ORDER BY column.

    The values of ANY and subqueries are read first; they become columns, so their number is bounded.
    ``default`` replaces nulls; ``names`` renames value columns.
    """
    if values is None or isinstance(values, DataFrame):
        source = df.select(column) if values is None else values.select(F.col(values.columns[0]).alias(column))
        rows = source.filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(PIVOT_VALUES + 1).collect()
        if len(rows) > PIVOT_VALUES:
            raise ValueError(f"a pivot over more than {PIVOT_VALUES} values")
        values = [r[0] for r in rows]
    out = df.groupBy(*keys).pivot(column, list(values)).agg(aggregate)
    made = [c for c in out.columns if c not in keys]
    if default is not None:
        out = out.fillna(default, made)
    return out.withColumnsRenamed({str(k): v for k, v in (names or {}).items()})


def unpivot(df: DataFrame, columns: Sequence[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    """Columns to rows; nulls are left out unless included."""
    ids = [c for c in df.columns if c not in columns]
    out = df.unpivot(ids, list(columns), name, value)
    return out if include_nulls else out.filter(F.col(value).isNotNull())


# --- windows ---------------------------------------------------------------------------------------------


def whole(*partition: str) -> WindowSpec:
    return Window.partitionBy(*partition)


def running(partition: Sequence[str], *keys: Column) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def conditional_true_event(condition: Column, w: WindowSpec) -> Column:
    """How often the condition was true so far."""
    return F.sum(F.when(condition, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def conditional_change_events(df: DataFrame, x: str, partition: Sequence[str], *keys: Column, name: str = "change_event") -> DataFrame:
    """How often x changed so far; nulls neither count as a change nor stand between two values."""
    w = Window.partitionBy(*partition).orderBy(*keys)
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_changed", F.when(F.col(x) != before, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_changed")


def ratio_to_report(x: Column, *partition: str) -> Column:
    """x over its partition's sum; null where that is zero."""
    return F.try_divide(x, F.sum(x).over(Window.partitionBy(*partition)))


def count_distinct_over(x: Column, w: WindowSpec) -> Column:
    """COUNT(DISTINCT x) over any frame."""
    return F.size(F.collect_set(x).over(w))


def last_value(x: Column, partition: Sequence[str], *keys: Column, ignore_nulls: bool = False) -> Column:
    """Over the whole partition, whatever the order."""
    w = Window.partitionBy(*partition).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.last(x, ignorenulls=ignore_nulls).over(w)


def nth_value(x: Column, n: int, partition: Sequence[str], *keys: Column, from_last: bool = False, ignore_nulls: bool = False) -> Column:
    order = [_reversed(k) for k in keys] if from_last else list(keys)
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(x, n, ignore_nulls).over(w)


def _reversed(key: Column) -> Column:
    text = key._jc.toString() if hasattr(key, "_jc") else str(key)
    name = text.split(" ")[0]
    down, first = " DESC" in text, "NULLS FIRST" in text
    c = F.col(name)
    if down:
        return c.asc_nulls_last() if first else c.asc_nulls_first()
    return c.desc_nulls_last() if first else c.desc_nulls_first()


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact percentiles of a numeric column by group: name -> (share, ``cont`` or ``disc``), as PERCENTILE_CONT and _DISC.

    No task holds a group. Values are counted, dealt out in ranges of (keys, value) and written; a group's counts by
    range say where each range begins, and a running count within it finds the ranks that are wanted. Nulls don't
    count; a group of nulls has nulls. For a few small groups the aggregate functions do as well.
    """
    known = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    counts = df.groupBy(*keys, value).agg(F.sum(known).alias("_n")).repartitionByRange(*keys, value).withColumn("_b", F.spark_partition_id())
    path = scratch(df.sparkSession, "ranks")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_sum"))
    by = Window.partitionBy(*keys)
    before = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_at"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(by).alias("_total"),
    )
    on = F.col("_b") == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.join(starts, on).withColumn("_upto", upto)
    last = F.col("_total") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value)))

    made = []
    for name, (share, kind) in wanted.items():
        if kind == "disc":
            made.append(at(F.greatest(F.ceil(F.lit(share) * F.col("_total")) - 1, F.lit(0))).alias(name))
            continue
        place = F.lit(share) * last
        low, high, rest = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        made.append((low + (high - low) * rest).alias(name))
    return rows.groupBy(*keys).agg(*made)
