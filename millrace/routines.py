"""User-defined functions, aggregates, table functions and procedures."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose states a task holds before it passes them on.
STATES = 50_000


def sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """CREATE FUNCTION with an expression or query body, which the optimizer inlines; parameters may have defaults."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def sql_table_function(spark: SparkSession, name: str, parameters: str, columns: str, query: str) -> None:
    """CREATE FUNCTION ... RETURNS TABLE (...)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")


def python_function(spark: SparkSession, name: str, f: Callable, returns: str, vectorized: bool = False, strict: bool = False, volatile: bool = False) -> Callable[..., Column]:
    """A scalar function for SQL and DataFrames. vectorized: ``f`` takes and gives pandas series, in Arrow batches.

    strict: null if any argument is null, without a call. volatile: the plan may not fold or move it.
    """
    if vectorized:
        made = F.pandas_udf(f, returns)
    else:
        made = F.udf((lambda *a: None if any(x is None for x in a) else f(*a)) if strict else f, returns, useArrow=True)
    if volatile:
        made = made.asNondeterministic()
    spark.udf.register(name, made)
    return made


def table_function(spark: SparkSession, name: str, handler: type, returns: str) -> Callable[..., DataFrame]:
    """A table function from a class with ``eval`` and, for TABLE arguments by partition, ``terminate``."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made


class Accumulator(Protocol):
    """State of a user-defined aggregate."""

    def accumulate(self, *values: Any) -> None: ...

    def merge(self, other: Any) -> None: ...

    def finish(self) -> Any: ...


def aggregate(df: DataFrame, keys: Sequence[str], accumulator: Callable[[], Accumulator], columns: Sequence[str], result: str, returns: str) -> DataFrame:
    """GROUP BY with a user-defined aggregate: every task accumulates its rows, only pickled states are shuffled."""
    key_fields = [df.schema[k] for k in keys]
    states = T.StructType([*key_fields, T.StructField("_state", T.BinaryType())])
    final = T.StructType([*key_fields, T.StructField(result, T._parse_datatype_string(returns))])
    keys, columns = list(keys), list(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Accumulator] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, pickle.dumps(a)) for k, a in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "_state"])

        for b in batches:
            ks = zip(*(b[k] for k in keys), strict=True) if keys else [()] * len(b)
            for k, row in zip(ks, zip(*(b[c] for c in columns), strict=True), strict=True):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k not in held:
                    held[k] = accumulator()
                held[k].accumulate(*(None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in row))
            if len(held) >= STATES:
                yield out()
        if held:
            yield out()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Accumulator | None = None
        for s in pdf["_state"]:
            a = pickle.loads(s)
            if total is None:
                total = a
            else:
                total.merge(a)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), total.finish()]], columns=final.names)

    parts = df.select(*dict.fromkeys([*keys, *columns])).mapInPandas(partial, states)
    return parts.groupBy(*keys).applyInPandas(merged, final)


#: Procedures by upper-cased name.
PROCEDURES: dict[str, Callable] = {}


def procedure(name: str) -> Callable[[Callable], Callable]:
    """CREATE PROCEDURE: a function of the session and its arguments."""

    def mark(f: Callable) -> Callable:
        PROCEDURES[name.upper()] = f
        return f

    return mark


def call(spark: SparkSession, name: str, *args: Any, **named: Any) -> Any:
    """CALL name(...)."""
    return PROCEDURES[name.upper()](spark, *args, **named)


def script(spark: SparkSession, text: str, **binds: object) -> DataFrame:
    """A scripting block: BEGIN ... END with DECLARE, IF, CASE, FOR, WHILE, REPEAT, LOOP, handlers; its last result."""
    return spark.sql(text, args=binds or None)


def execute_immediate(spark: SparkSession, text: str, *using: object) -> DataFrame:
    """EXECUTE IMMEDIATE text USING (...): ``?`` stand for the values in order."""
    from .dialect import rewrite

    return spark.sql(rewrite(text), args=list(using)) if using else spark.sql(rewrite(text))
