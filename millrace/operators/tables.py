"""Table functions: FLATTEN, SPLIT_TO_TABLE, TO_QUERY and catalog listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, input: str, outer: bool = False, mode: str = "BOTH", path: str | None = None, sql_seq: str | None = None) -> DataFrame:
    """LATERAL FLATTEN of an array, map, struct or variant column: SEQ, KEY, PATH, INDEX, VALUE, THIS.

    SEQ is the column ``sql_seq`` if given (an ordinal of the input rows), else a 64-bit row id.
    """
    kind = df.schema[input].dataType
    source = F.col(input) if path is None else F.variant_get(F.col(input), "$." + path, "variant")
    base = df.withColumn("_in", source).withColumn("SEQ", F.col(sql_seq) if sql_seq else F.monotonically_increasing_id() + 1)
    prefix = path or ""
    if isinstance(kind, T.ArrayType):
        made = base.select("*", (F.posexplode_outer if outer else F.posexplode)("_in").alias("INDEX", "VALUE")).withColumn("KEY", F.lit(None).cast("string"))
    elif isinstance(kind, T.MapType):
        made = base.select("*", (F.explode_outer if outer else F.explode)("_in").alias("KEY", "VALUE")).withColumn("INDEX", F.lit(None).cast("int"))
    elif isinstance(kind, T.StructType):
        entries = F.array(*(F.struct(F.lit(f.name).alias("KEY"), F.col("_in")[f.name].cast("variant").alias("VALUE")) for f in kind))
        made = base.select("*", (F.explode_outer if outer else F.explode)(entries).alias("_e")).select("*", "_e.*").drop("_e").withColumn("INDEX", F.lit(None).cast("int"))
    else:
        names = "variant_explode_outer" if outer else "variant_explode"
        base.createOrReplaceTempView("_flatten_input")
        made = base.sparkSession.sql(f"SELECT i.*, e.pos AS INDEX, e.key AS KEY, e.value AS VALUE FROM _flatten_input i, LATERAL {names}(i._in) e")
        made = made.withColumn("INDEX", F.when(F.col("KEY").isNull(), F.col("INDEX")))
    if mode.upper() == "OBJECT":
        made = made.filter(F.col("KEY").isNotNull() | (F.lit(outer) & F.col("VALUE").isNull()))
    elif mode.upper() == "ARRAY":
        made = made.filter(F.col("INDEX").isNotNull() | (F.lit(outer) & F.col("VALUE").isNull()))
    step = F.when(F.col("INDEX").isNotNull(), F.concat(F.lit("["), F.col("INDEX").cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("." if prefix else ""), F.col("KEY"))
    )
    return made.withColumn("PATH", F.concat(F.lit(prefix), step)).withColumnRenamed("_in", "THIS").select(*df.columns, "SEQ", "KEY", "PATH", "INDEX", "VALUE", "THIS")


def flatten_recursive(df: DataFrame, input: str, key: str, depth: int = 32) -> DataFrame:
    """FLATTEN(..., RECURSIVE => TRUE) of a variant column: every value at every depth, with its path."""
    from .sets import recursive

    first = flatten(df.select(key, input), input).select(key, "PATH", "KEY", "INDEX", "VALUE")

    def step(level: DataFrame) -> DataFrame:
        deep = level.filter(F.schema_of_variant("VALUE").rlike("^(OBJECT|ARRAY)")).select(key, F.col("PATH").alias("_up"), F.col("VALUE").alias("_v"))
        inner = flatten(deep, "_v")
        dot = F.when(F.col("INDEX").isNull(), F.lit(".")).otherwise(F.lit(""))
        return inner.select(key, F.concat(F.col("_up"), dot, F.col("PATH")).alias("PATH"), "KEY", "INDEX", "VALUE")

    return recursive(first, step, depth)


def split_to_table(df: DataFrame, text: str, delimiter: str, seq: str | None = None) -> DataFrame:
    """SEQ, INDEX (from 1), VALUE of the parts of a text, beside the row's columns."""
    from ..functions.strings import split

    return _indexed(df, split(text, delimiter), seq)


def strtok_split_to_table(df: DataFrame, text: str, delimiters: str = " ", seq: str | None = None) -> DataFrame:
    from ..functions.strings import strtok_to_array

    return _indexed(df, strtok_to_array(text, delimiters), seq)


def _indexed(df: DataFrame, parts: Column, seq: str | None) -> DataFrame:
    base = df.withColumn("SEQ", F.col(seq) if seq else F.monotonically_increasing_id() + 1)
    return base.select("*", F.posexplode(parts).alias("INDEX", "VALUE")).withColumn("INDEX", F.col("INDEX") + 1)


def to_query(spark: SparkSession, text: str, **binds: object) -> DataFrame:
    """Rows of a query text with named binds."""
    return spark.sql(text, args=binds or None)


def infer_schema(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """COLUMN_NAME, TYPE, NULLABLE, ORDER_ID of staged files."""
    schema = spark.read.format(format).options(**options).load(path).schema
    rows = [(f.name, f.dataType.simpleString().upper(), f.nullable, i) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "COLUMN_NAME string, TYPE string, NULLABLE boolean, ORDER_ID int")


def information_schema_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.catalog, ".".join(t.namespace or []), t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, IS_TEMPORARY boolean")


def information_schema_columns(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    rows = [(t, c.name, i, c.dataType.upper(), "YES" if c.nullable else "NO") for t in tables for i, c in enumerate(spark.catalog.listColumns(t), 1)]
    return spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE string")


def show(listing: DataFrame, like: str | None = None, starts_with: str | None = None, limit: int | None = None, column: str = "TABLE_NAME") -> DataFrame:
    """SHOW ... LIKE (no regard to case) STARTS WITH ... LIMIT."""
    if like is not None:
        listing = listing.filter(F.ilike(F.col(column), F.lit(like)))
    if starts_with is not None:
        listing = listing.filter(F.startswith(F.col(column), F.lit(starts_with)))
    listing = listing.orderBy(column)
    return listing if limit is None else listing.limit(limit)
