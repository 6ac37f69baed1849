"""Session and context functions, sequences and identifiers.

What a cluster session doesn't have (accounts, roles, warehouses) is read from the session's configuration,
``millrace.context.<name>``, and null where it isn't set.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import batch_udf, REGISTRY, ColumnOrName, col, function

#: Names whose value is a setting of the session (fixed values of the dialect).
SETTINGS = (
    "CURRENT_ACCOUNT CURRENT_ACCOUNT_NAME CURRENT_AVAILABLE_ROLES CURRENT_CLIENT CURRENT_IP_ADDRESS CURRENT_ORGANIZATION_NAME "
    "CURRENT_REGION CURRENT_ROLE CURRENT_ROLE_TYPE CURRENT_SECONDARY_ROLES CURRENT_WAREHOUSE CURRENT_TRANSACTION LAST_TRANSACTION "
    "INVOKER_ROLE CURRENT_STATEMENT"
).split()


def _setting(name: str):
    def read() -> Column:
        spark = SparkSession.active()
        return F.lit(spark.conf.get(f"millrace.context.{name.lower()}", None)).cast("string")

    return read


for _name in SETTINGS:
    globals()[_name.lower()] = REGISTRY[_name] = _setting(_name)


@function()
def current_database() -> Column:
    return F.current_catalog()


@function()
def current_schema() -> Column:
    return F.current_schema()


@function()
def current_schemas() -> Column:
    return F.to_json(F.array(F.concat_ws(".", F.current_catalog(), F.current_schema())))


@function()
def current_session() -> Column:
    return F.lit(SparkSession.active().sparkContext.applicationId)


@function()
def current_user() -> Column:
    return F.current_user()


@function()
def current_version() -> Column:
    return F.version()


@function("IS_ROLE_IN_SESSION", "IS_DATABASE_ROLE_IN_SESSION")
def is_role_in_session(role: str) -> Column:
    return F.coalesce(current_role() == role, F.lit(False))  # noqa: F821


@function()
def getvariable(name: str) -> Column:
    """A session variable, by its name in upper case; null if it isn't declared."""
    value = SparkSession.active().conf.get(f"millrace.variable.{name.upper()}", None)
    return F.lit(value).cast("string")


def setvariable(name: str, value: object) -> None:
    SparkSession.active().conf.set(f"millrace.variable.{name.upper()}", str(value))


def unsetvariable(name: str) -> None:
    SparkSession.active().conf.unset(f"millrace.variable.{name.upper()}")


@function()
def last_query_id(n: int = -1) -> Column:
    """Id of an earlier statement of the session's query log."""
    from ..streaming.history import QUERY_LOG

    ids = [q.query_id for q in QUERY_LOG]
    return F.lit(ids[n] if n < 0 and -n <= len(ids) else ids[n - 1] if 0 < n <= len(ids) else None).cast("string")


def _constraint(name: str):
    def build(**options: object) -> Column:
        """The result of a policy body, as a description that ``operators.policies`` applies."""
        import json

        return F.lit(json.dumps({"constraint": name} | options, sort_keys=True))

    return build


for _name in ("AGGREGATION_CONSTRAINT", "JOIN_CONSTRAINT", "NO_AGGREGATION_CONSTRAINT", "PROJECTION_CONSTRAINT"):
    globals()[_name.lower()] = REGISTRY[_name] = _constraint(_name.lower())


def seq(df: DataFrame, name: str, width: int, *order: ColumnOrName) -> DataFrame:
    """``df`` with a column of row ordinals from 0 that wraps at ``width`` bytes.

    Without an order ordinals follow partitions: sizes of partitions are counted first, so no task holds all
    rows. With an order, the rows are range-partitioned by it instead.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    at = rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    base = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, total = [], 0
    for p in sorted(base):
        starts.append((p, total))
        total += base[p]
    table = F.create_map(*(F.lit(x) for s in starts for x in s)) if starts else F.create_map(F.lit(-1), F.lit(0))
    ordinal = F.element_at(table, F.col("_p")).cast("long") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn(name, F.pmod(ordinal, F.lit(1 << min(8 * width - 1, 62)))).drop("_p", "_m")


def _seq(width: int):
    def build(order: ColumnOrName) -> Column:
        """Ordinals in the order of a column, as a window: for small results; ``seq`` is for large ones."""
        return F.pmod(F.row_number().over(Window.orderBy(col(order))) - 1, F.lit(1 << min(8 * width - 1, 30)))

    return build


for _w in (1, 2, 4, 8):
    globals()[f"seq{_w}"] = REGISTRY[f"SEQ{_w}"] = _seq(_w)


class Sequence:
    """NEXTVAL for each row: ordinals of the rows, from where the last statement ended."""

    def __init__(self, start: int = 1, increment: int = 1) -> None:
        self.next, self.increment = start, increment

    def nextval(self, df: DataFrame, name: str = "nextval") -> DataFrame:
        out = seq(df, "_o", 8).withColumn(name, F.col("_o") * self.increment + self.next).drop("_o")
        self.next += df.count() * self.increment
        return out


@batch_udf("string")
def _uuid5(namespace: pd.Series, name: pd.Series) -> pd.Series:
    import uuid

    pairs = zip(namespace, name, strict=True)
    return pd.Series([None if n is None or x is None else str(uuid.uuid5(uuid.UUID(n), x)) for n, x in pairs], dtype=object)


@function()
def uuid_string(namespace: ColumnOrName | None = None, name: ColumnOrName | None = None) -> Column:
    """A random UUID, or version 5 of a namespace and a name."""
    return F.uuid() if namespace is None else _uuid5(col(namespace), col(name))


@function("SYSTEM$TYPEOF")
def system_typeof(x: ColumnOrName) -> Column:
    return F.upper(F.typeof(col(x)))


@function("NEXTVAL")
def nextval(sequence: Sequence, df: DataFrame, name: str = "nextval") -> DataFrame:
    return sequence.nextval(df, name)
