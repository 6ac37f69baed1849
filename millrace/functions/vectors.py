"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnOrName, col, function, let


def _doubles(v: ColumnOrName) -> Column:
    return col(v).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def same_dimension(a: ColumnOrName, b: ColumnOrName, value: Column) -> Column:
    """An error where the dimensions differ."""
    ok = F.size(col(a)) == F.size(col(b))
    return F.when(col(a).isNull() | col(b).isNull(), None).when(ok, value).otherwise(F.raise_error(F.lit("vectors of different dimensions")))


@function("VECTOR_INNER_PRODUCT")
def vector_inner_product(a: ColumnOrName, b: ColumnOrName) -> Column:
    return same_dimension(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)))


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


@function("VECTOR_COSINE_SIMILARITY")
def vector_cosine_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return vector_inner_product(a, b) / (norm(a) * norm(b))


@function("VECTOR_L1_DISTANCE")
def vector_l1_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return same_dimension(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y))))


@function("VECTOR_L2_DISTANCE")
def vector_l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return same_dimension(a, b, F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))))


@function("VECTOR_NORMALIZE")
def vector_normalize(v: ColumnOrName) -> Column:
    return let(norm(v), lambda n: F.transform(_doubles(v), lambda x: x / n))


@function("VECTOR_TRUNC")
def vector_trunc(v: ColumnOrName, n: int) -> Column:
    return F.slice(col(v), 1, n)


@function("IS_VECTOR")
def is_vector(v: ColumnOrName) -> Column:
    return F.typeof(col(v)).isin("array<float>", "array<double>", "array<int>")
