"""Helpers that all function modules share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
#: Dialect name -> builder, filled by ``@function``.
REGISTRY: dict[str, Callable[..., Any]] = {}


def function(*names: str) -> Callable:
    """Register a builder under its dialect names (its own upper-cased name if none is given)."""

    def mark(f: Callable) -> Callable:
        for n in names or (f.__name__.rstrip("_").upper(),):
            REGISTRY[n] = f
        return f

    return mark


def col(x: Any) -> Column:
    """A column: names become columns, other Python values literals."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def lit(x: Any) -> Column:
    """A parameter: Python values, strings too, become literals."""
    return x if isinstance(x, Column) else F.lit(x)


def null_if_any(parts: list[Column], value: Column) -> Column:
    """``value``, or null if any of ``parts`` is null."""
    bad = parts[0].isNull()
    for p in parts[1:]:
        bad = bad | p.isNull()
    return F.when(~bad, value)


def must(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok`` is true or null; an error otherwise."""
    return F.when(ok.isNull() | ok, value).otherwise(F.raise_error(F.lit(message)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def batch_udf(type_: str) -> Callable:
    """A pandas UDF that is made when it is first used: its type is parsed by a running session."""

    def wrap(f: Callable) -> Callable:
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, type_)(*columns)

        return call

    return wrap
