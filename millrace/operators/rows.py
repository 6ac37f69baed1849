"""Projection, filters, order, limits, samples, star modifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(*keys: str | Column | tuple[str, str] | tuple[str, str, str]) -> list[Column]:
    """Sort keys in the dialect's order: nulls last ascending, first descending.

    A key is a name, a column, or (name, "asc" | "desc"[, "first" | "last"]).
    """
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
            continue
        name, way, *nulls = (k, "asc") if isinstance(k, str) else k
        down = way.lower() == "desc"
        first = nulls[0].lower() == "first" if nulls else down
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def order_by(df: DataFrame, *keys: str | Column | tuple) -> DataFrame:
    return df.orderBy(*order(*keys))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """LIMIT ... OFFSET, FETCH FIRST, TOP."""
    return (df.offset(offset) if offset else df).limit(n)


def qualify(df: DataFrame, condition: Callable[..., Column], **windows: Column) -> DataFrame:
    """Rows for which a condition over window columns holds; the window columns are dropped again."""
    hidden = {f"_q_{k}": v for k, v in windows.items()}
    return df.withColumns(hidden).filter(condition(*(F.col(k) for k in hidden))).drop(*hidden)


def top_k(df: DataFrame, k: int, partition: Sequence[str], *keys: str | Column | tuple) -> DataFrame:
    """The first ``k`` rows of each group: Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order(*keys))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def star(
    df: DataFrame,
    exclude: Sequence[str] = (),
    rename: dict[str, str] | None = None,
    replace: dict[str, Column] | None = None,
    ilike: str | None = None,
) -> DataFrame:
    """``* ILIKE ... EXCLUDE ... REPLACE ... RENAME``; naming a column that isn't there is an error."""
    names = {c.lower(): c for c in df.columns}
    for c in [*exclude, *(rename or {}), *(replace or {})]:
        if c.lower() not in names:
            raise ValueError(f"{c} is no column of *")
    if {c.lower() for c in exclude} & {c.lower() for c in (*(rename or {}), *(replace or {}))}:
        raise ValueError("an excluded column can't be renamed or replaced")
    kept = [c for c in df.columns if c.lower() not in {x.lower() for x in exclude}]
    if ilike is not None:
        pattern = re.compile("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in ilike), re.I | re.S)
        kept = [c for c in kept if pattern.fullmatch(c)]
    low = {k.lower(): v for k, v in (replace or {}).items()}
    new = {k.lower(): v for k, v in (rename or {}).items()}
    return df.select(*(low.get(c.lower(), F.col(f"`{c}`")).alias(new.get(c.lower(), c)) for c in kept))


def position(df: DataFrame, n: int) -> Column:
    """``$n``: a column by its place, from 1."""
    return F.col(f"`{df.columns[n - 1]}`")


def with_aliases(df: DataFrame, **items: Column | str) -> DataFrame:
    """Select-list items that later items, filters and groups may name, added one after the other."""
    for name, value in items.items():
        df = df.withColumn(name, F.expr(value) if isinstance(value, str) else value)
    return df


def row_in(left: Sequence[Column], rows: Sequence[Sequence]) -> Column:
    """``(a, b) IN ((1, 2), ...)``."""
    out = F.lit(False)
    for r in rows:
        same = F.lit(True)
        for c, v in zip(left, r, strict=True):
            same = same & (c == F.lit(v))
        out = out | same
    return out


def any_all(df: DataFrame, column: str, op: str, values: DataFrame, quantifier: str = "ANY") -> DataFrame:
    """``column op ANY | ALL (subquery)``: rows for which it is true.

    The subquery's first column is reduced to its extremes and counts, one row, before it meets the rows.
    """
    v = F.col(values.columns[0])
    one = values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"), F.count("*").alias("_all"), F.count_distinct(v).alias("_d"))
    x, nulls = F.col(column), F.col("_all") > F.col("_n")
    every = quantifier.upper() == "ALL"
    if op in ("<", "<="):
        edge = F.col("_lo") if every else F.col("_hi")
        test = x < edge if op == "<" else x <= edge
    elif op in (">", ">="):
        edge = F.col("_hi") if every else F.col("_lo")
        test = x > edge if op == ">" else x >= edge
    elif op == "=":
        if not every:
            return df.join(values.select(v.alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_semi")
        test = (F.col("_d") == 1) & (x == F.col("_lo"))
    elif op in ("<>", "!="):
        if every:
            ok = df.join(values.select(v.alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_anti").filter(x.isNotNull())
            return ok.join(F.broadcast(one.filter(nulls).select(F.lit(1).alias("_bad"))), F.lit(True), "left_anti")  # one row
        test = ((F.col("_d") > 1) & x.isNotNull()) | (x != F.col("_lo"))
    else:
        raise ValueError(f"{op} isn't a comparison")
    keep = (F.col("_all") == 0) | (test & ~nulls) if every else test
    return df.join(F.broadcast(one), F.lit(True)).filter(keep).select(*df.columns)  # one row


def sample_fraction(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """SAMPLE (p): each row with a chance of p percent."""
    if not 0 <= percent <= 100:
        raise ValueError("a sample has 0 to 100 percent")
    return df.sample(fraction=percent / 100, seed=seed)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """SAMPLE (n ROWS): exactly n rows, or all if there are fewer; each task keeps n at most."""
    if not 0 <= n <= 1_000_000:
        raise ValueError("a sample has 0 to 1,000,000 rows")
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def generator(spark, rowcount: int, name: str = "seq") -> DataFrame:
    """TABLE(GENERATOR(ROWCOUNT => n))."""
    return spark.range(rowcount).withColumnRenamed("id", name)


def values(spark, rows: Sequence[Sequence], schema: str | None = None) -> DataFrame:
    """VALUES: columns column1, column2, ... unless named."""
    names = [f"column{i}" for i in range(1, len(rows[0]) + 1)]
    return spark.createDataFrame([tuple(r) for r in rows], schema or names)


def dual(spark) -> DataFrame:
    return spark.range(1).select(F.lit("X").alias("DUMMY"))
