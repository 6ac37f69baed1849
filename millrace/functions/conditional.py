"""Conditional functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnOrName, col, function, lit, null_if_any


@function("BOOLAND")
def booland(a: ColumnOrName, b: ColumnOrName) -> Column:
    return (col(a) != 0) & (col(b) != 0)


@function("BOOLOR")
def boolor(a: ColumnOrName, b: ColumnOrName) -> Column:
    return (col(a) != 0) | (col(b) != 0)


@function("BOOLXOR")
def boolxor(a: ColumnOrName, b: ColumnOrName) -> Column:
    return (col(a) != 0) != (col(b) != 0)


@function("BOOLNOT")
def boolnot(a: ColumnOrName) -> Column:
    return ~(col(a) != 0)


@function()
def coalesce(*xs: ColumnOrName) -> Column:
    return F.coalesce(*map(col, xs))


@function("IFNULL", "NVL")
def nvl(a: ColumnOrName, b: Any) -> Column:
    return F.coalesce(col(a), lit(b))


ifnull = nvl


@function()
def nvl2(x: ColumnOrName, present: Any, absent: Any) -> Column:
    return F.when(col(x).isNotNull(), lit(present)).otherwise(lit(absent))


@function()
def decode(x: ColumnOrName, *rest: Any) -> Column:
    """value, result, value, result, ..., default; a null value fits a null."""
    x, out = col(x), None
    for value, result in zip(rest[::2], rest[1::2], strict=False):
        fits = x.eqNullSafe(lit(value))
        out = F.when(fits, lit(result)) if out is None else out.when(fits, lit(result))
    return out.otherwise(lit(rest[-1])) if len(rest) % 2 else out


@function()
def equal_null(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a).eqNullSafe(col(b))


@function()
def greatest(*xs: ColumnOrName) -> Column:
    """Null if any argument is null."""
    cs = [col(x) for x in xs]
    return null_if_any(cs, F.greatest(*cs) if len(cs) > 1 else cs[0])


@function()
def least(*xs: ColumnOrName) -> Column:
    """Null if any argument is null."""
    cs = [col(x) for x in xs]
    return null_if_any(cs, F.least(*cs) if len(cs) > 1 else cs[0])


@function()
def greatest_ignore_nulls(*xs: ColumnOrName) -> Column:
    return F.greatest(*map(col, xs))


@function()
def least_ignore_nulls(*xs: ColumnOrName) -> Column:
    return F.least(*map(col, xs))


@function()
def iff(p: ColumnOrName, yes: Any, no: Any) -> Column:
    return F.when(col(p), lit(yes)).otherwise(lit(no))


@function()
def nullif(a: ColumnOrName, b: Any) -> Column:
    return F.nullif(col(a), lit(b))


@function()
def nullifzero(x: ColumnOrName) -> Column:
    return F.nullifzero(col(x))


@function()
def zeroifnull(x: ColumnOrName) -> Column:
    return F.zeroifnull(col(x))


@function()
def regr_valx(y: ColumnOrName, x: ColumnOrName) -> Column:
    return F.when(col(y).isNotNull(), col(x))


@function()
def regr_valy(y: ColumnOrName, x: ColumnOrName) -> Column:
    return F.when(col(x).isNotNull(), col(y))
