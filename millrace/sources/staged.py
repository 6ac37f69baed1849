"""Staged files: readers, schema inference, COPY INTO in both directions, load history, stage listings."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "xml", "parquet", "avro", "orc")


@dataclass
class FileFormat:
    """CREATE FILE FORMAT: options by their dialect names."""

    type: str = "csv"
    field_delimiter: str = ","
    record_delimiter: str | None = None
    skip_header: int = 0
    parse_header: bool = False
    field_optionally_enclosed_by: str | None = None
    escape: str | None = None
    null_if: tuple[str, ...] = ("\\N",)
    encoding: str = "UTF-8"
    trim_space: bool = False
    compression: str = "auto"
    strip_outer_array: bool = False
    strip_null_values: bool = False
    row_tag: str = "ROW"
    date_format: str | None = None
    timestamp_format: str | None = None

    def read_options(self) -> dict[str, str]:
        if self.type != "csv":
            return {"encoding": self.encoding} if self.type == "json" else {"rowTag": self.row_tag} if self.type == "xml" else {}
        out = {
            "sep": self.field_delimiter, "encoding": self.encoding, "header": str(self.parse_header).lower(), "quote": self.field_optionally_enclosed_by or "\0",
            "ignoreLeadingWhiteSpace": str(self.trim_space).lower(), "ignoreTrailingWhiteSpace": str(self.trim_space).lower(), "multiLine": str(bool(self.field_optionally_enclosed_by)).lower(),
        }
        if self.record_delimiter:
            out["lineSep"] = self.record_delimiter
        if self.escape:
            out["escape"] = self.escape
        elif self.field_optionally_enclosed_by:
            out["escape"] = self.field_optionally_enclosed_by  # a doubled quote stands for one
        return out


class FileError(ValueError):
    """A staged file can't be loaded under ON_ERROR = ABORT_STATEMENT."""


# --- stages ----------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, stage: str, pattern: str | None = None) -> list[tuple[str, int, datetime]]:
    """LIST @stage: path, size and time of change of its files."""
    p, fs = _fs(spark, stage)
    if not fs.exists(p):
        return []
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        path = s.getPath().toString()
        if pattern is None or re.search(pattern, path):
            out.append((path, s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc).replace(tzinfo=None)))
    return sorted(out)


def directory(spark: SparkSession, stage: str) -> DataFrame:
    """A directory table: RELATIVE_PATH, SIZE, LAST_MODIFIED, FILE_URL of a stage's files."""
    rows = [(p[p.find(stage) + len(stage) :].lstrip("/") if stage in p else p, n, t, p) for p, n, t in list_files(spark, stage)]
    return spark.createDataFrame(rows, "RELATIVE_PATH string, SIZE long, LAST_MODIFIED timestamp, FILE_URL string")


def put(spark: SparkSession, local: str, stage: str, overwrite: bool = False) -> None:
    p, fs = _fs(spark, stage)
    fs.mkdirs(p)
    fs.copyFromLocalFile(False, overwrite, spark._jvm.org.apache.hadoop.fs.Path(local), p)


def get(spark: SparkSession, path: str, local: str) -> None:
    p, fs = _fs(spark, path)
    fs.copyToLocalFile(p, spark._jvm.org.apache.hadoop.fs.Path(local))


def remove(spark: SparkSession, stage: str, pattern: str | None = None) -> int:
    found = list_files(spark, stage, pattern)
    for path, _, _ in found:
        p, fs = _fs(spark, path)
        fs.delete(p, False)
    return len(found)


# --- reading ---------------------------------------------------------------------------------------------


def read(spark: SparkSession, paths: str | list[str], fmt: FileFormat, schema: str | T.StructType | None = None, metadata: bool = False) -> DataFrame:
    """Rows of staged files. Without a schema CSV has text columns c1, c2, ...; JSON and XML a variant ``$1``.

    ``metadata`` adds METADATA$FILENAME.
    """
    if fmt.type not in FORMATS:
        raise ValueError(f"{fmt.type} is no file format")
    reader = spark.read.format(fmt.type).options(**fmt.read_options())
    if fmt.type == "csv":
        df = _read_csv(spark, paths, fmt, schema)
    elif fmt.type in ("json", "xml") and schema is None:
        df = _read_variant(spark, paths, fmt)
    else:
        df = (reader.schema(schema) if schema is not None else reader).load(paths)
    return df.withColumn("METADATA$FILENAME", F.col("_metadata.file_path")) if metadata else df


def _read_csv(spark: SparkSession, paths: str | list[str], fmt: FileFormat, schema: str | T.StructType | None) -> DataFrame:
    reader = spark.read.format("csv").options(**fmt.read_options())
    if schema is None:
        df = reader.load(paths)
        if not fmt.parse_header:
            df = df.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(df.columns, 1)})
    else:
        df = reader.schema(schema).load(paths)
    if fmt.skip_header:
        # header lines are those at the beginning of a file
        df = df.withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_f", F.col("_metadata.file_path"))
        from pyspark.sql import Window

        first = df.filter("_at = 0").withColumn("_i", F.monotonically_increasing_id())
        w = Window.partitionBy("_f").orderBy("_i")
        df = first.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") > fmt.skip_header).drop("_i", "_k").unionByName(df.filter("_at > 0")).drop("_at", "_f")
    nulls = list(fmt.null_if)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")) for c in texts}) if nulls and texts else df


def _read_variant(spark: SparkSession, paths: str | list[str], fmt: FileFormat) -> DataFrame:
    if fmt.type == "xml":
        return spark.read.format("xml").options(rowTag=fmt.row_tag, singleVariantColumn="$1").load(paths)
    if not fmt.strip_outer_array:
        df = spark.read.format("json").options(singleVariantColumn="$1").load(paths)
    else:
        whole = spark.read.text(paths, wholetext=True)
        whole.select(F.parse_json("value").alias("v")).createOrReplaceTempView("_outer_array")
        df = spark.sql("SELECT e.value AS `$1` FROM _outer_array, LATERAL variant_explode(v) e")
    if fmt.strip_null_values:
        text = F.regexp_replace(F.to_json(F.col("`$1`")), r'"[^"]*":null,?', "")
        df = df.select(F.parse_json(F.regexp_replace(text, r",\}", "}")).alias("$1"))
    return df


#: From the narrowest type to the widest; a text fits all.
_LATTICE = ["boolean", "bigint", "decimal(38,9)", "double", "date", "timestamp", "string"]


def infer(spark: SparkSession, paths: str | list[str], fmt: FileFormat) -> T.StructType:
    """INFER_SCHEMA: for CSV the narrowest type that all values of a column read as, in one aggregation."""
    if fmt.type != "csv":
        return spark.read.format(fmt.type).options(**fmt.read_options()).load(paths).schema
    df = read(spark, paths, fmt)
    names = df.columns
    tests = {
        "boolean": lambda c: F.lower(c).isin("true", "false"), "bigint": lambda c: c.try_cast("bigint").isNotNull() & ~c.contains("."),
        "decimal(38,9)": lambda c: c.try_cast("decimal(38,9)").isNotNull() & ~c.rlike("[eE]"), "double": lambda c: c.try_cast("double").isNotNull(),
        "date": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), "timestamp": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d") & c.try_cast("timestamp").isNotNull(),
    }
    found = df.agg(*(F.struct(*(F.coalesce(F.bool_and(f(F.col(f"`{n}`"))), F.lit(False)).alias(t.split("(")[0]) for t, f in tests.items())).alias(n) for n in names)).first()
    fields = []
    for n in names:
        kind = next((t for t in _LATTICE[:-1] if found[n][t.split("(")[0]]), "string")
        fields.append(T.StructField(n, T._parse_datatype_string(kind)))
    return T.StructType(fields)


def merge_types(a: str, b: str) -> str:
    """The type of a column in two files: the wider of one family, else text."""
    if a == b:
        return a
    numbers = ["bigint", "decimal(38,9)", "double"]
    times = ["date", "timestamp"]
    for family in (numbers, times):
        if a in family and b in family:
            return family[max(family.index(a), family.index(b))]
    return "string"


# --- loading ---------------------------------------------------------------------------------------------


@dataclass
class Loaded:
    file: str
    table: str
    status: str
    rows_parsed: int
    rows_loaded: int
    errors_seen: int
    first_error: str | None
    when: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))


class LoadHistory:
    """Files loaded into tables; a file is loaded once unless forced."""

    def __init__(self) -> None:
        self.entries: list[Loaded] = []

    def seen(self, table: str) -> set[str]:
        return {e.file for e in self.entries if e.table == table and e.status in ("LOADED", "PARTIALLY_LOADED")}

    def frame(self, spark: SparkSession, table: str | None = None) -> DataFrame:
        """COPY_HISTORY."""
        rows = [(e.file, e.table, e.when, e.status, e.rows_parsed, e.rows_loaded, e.errors_seen, e.first_error) for e in self.entries if table in (None, e.table)]
        names = "FILE_NAME string, TABLE_NAME string, LAST_LOAD_TIME timestamp, STATUS string, ROW_PARSED long, ROW_COUNT long, ERROR_COUNT long, FIRST_ERROR_MESSAGE string"
        return spark.createDataFrame(rows, names)


HISTORY = LoadHistory()


def copy_into(
    spark: SparkSession,
    table: str,
    stage: str,
    fmt: FileFormat,
    schema: str | T.StructType,
    target: str,
    files: list[str] | None = None,
    pattern: str | None = None,
    on_error: str = "ABORT_STATEMENT",
    force: bool = False,
    purge: bool = False,
    match_by_column_name: bool = False,
    truncate_columns: dict[str, int] | None = None,
    validation_mode: bool = False,
    history: LoadHistory = HISTORY,
) -> DataFrame:
    """COPY INTO table: appends the rows of new files to Parquet at ``target``; one row for each file.

    on_error: ABORT_STATEMENT, CONTINUE, SKIP_FILE, SKIP_FILE_n or SKIP_FILE_n%. Errors are rows that the schema
    can't hold. All files are read in one job; counts and the append follow from the same rows, marked by file.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = [p for p, _, _ in list_files(spark, stage, pattern) if files is None or any(fnmatch.fnmatch(p.rsplit("/", 1)[-1], f) for f in files)]
    found = [p for p in found if force or p not in history.seen(table)]
    report = "file string, status string, rows_parsed long, rows_loaded long, errors_seen long, first_error string"
    if not found:
        return spark.createDataFrame([], report)
    bad = "_corrupt_record"
    wide = T.StructType([*struct, T.StructField(bad, T.StringType())])
    if fmt.type in ("csv", "json", "xml"):
        reader = spark.read.format(fmt.type).options(**fmt.read_options(), mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
        if fmt.type == "csv" and (match_by_column_name or fmt.parse_header):
            reader = reader.option("header", "true").option("enforceSchema", str(not match_by_column_name).lower())
        df = reader.schema(wide).load(found)
    else:
        df = spark.read.format(fmt.type).load(found)
        have = {c.lower(): c for c in df.columns}
        df = df.select(*(F.col(have[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in struct))
        df = df.withColumn(bad, F.lit(None).cast("string"))
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    if fmt.type == "csv" and fmt.skip_header and not fmt.parse_header:
        df = _skip(df, fmt.skip_header)
    nulls = list(fmt.null_if)
    texts = [f.name for f in struct if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(~F.col(c).isin(nulls), F.col(c)) for c in texts}) if nulls and texts else df
    df = df.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in (truncate_columns or {}).items()})
    df = df.cache()
    try:
        counts = df.groupBy("_file").agg(F.count("*").alias("n"), F.count(bad).alias("bad"), F.min(bad).alias("first")).collect()  # a row for each file
        if validation_mode:
            return spark.createDataFrame([(r["_file"], "VALIDATED", r["n"], 0, r["bad"], r["first"]) for r in counts], report)
        if on_error == "ABORT_STATEMENT" and any(r["bad"] for r in counts):
            r = next(r for r in counts if r["bad"])
            raise FileError(f"{r['_file']}: {r['first']}")
        skipped = {r["_file"] for r in counts if _over(on_error, r["bad"], r["n"])}
        good = df.filter(F.col(bad).isNull() & ~F.col("_file").isin(list(skipped))) if skipped else df.filter(F.col(bad).isNull())
        good.select(*struct.names).write.mode("append").parquet(target)
        out = []
        for r in counts:
            loaded = 0 if r["_file"] in skipped else r["n"] - r["bad"]
            status = "LOAD_FAILED" if r["_file"] in skipped else "PARTIALLY_LOADED" if r["bad"] else "LOADED"
            out.append((r["_file"], status, r["n"], loaded, r["bad"], r["first"]))
            history.entries.append(Loaded(r["_file"], table, *out[-1][1:]))
        if purge:
            for f in out:
                if f[1] == "LOADED":
                    p, fs = _fs(spark, f[0])
                    fs.delete(p, False)
        return spark.createDataFrame(out, report)
    finally:
        df.unpersist()


def _skip(df: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    marked = df.withColumn("_head", F.col("_metadata.file_block_start") == 0).withColumn("_i", F.monotonically_increasing_id())
    w = Window.partitionBy("_file").orderBy("_i")
    head = marked.filter("_head").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") > n).drop("_k")
    return head.unionByName(marked.filter("NOT _head")).drop("_head", "_i")


def _over(on_error: str, bad: int, n: int) -> bool:
    """Whether a file's errors are beyond what ON_ERROR allows."""
    m = re.fullmatch(r"SKIP_FILE(?:_(\d+)(%?))?", on_error.upper())
    if not m or not bad:
        return False
    if m[1] is None:
        return True
    return bad * 100 >= int(m[1]) * n if m[2] else bad >= int(m[1])


def unload(df: DataFrame, path: str, fmt: FileFormat, partition_by: list[str] | None = None, header: bool = False, single: bool = False, rows_per_file: int | None = None, overwrite: bool = False) -> None:
    """COPY INTO @stage: CSV, JSON, Parquet or ORC files."""
    if fmt.type not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"{fmt.type} files aren't written")
    writer = (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if fmt.compression not in ("auto", "none"):
        writer = writer.option("compression", fmt.compression)
    if fmt.type == "csv":
        writer = writer.options(sep=fmt.field_delimiter, header=str(header).lower(), nullValue=fmt.null_if[0] if fmt.null_if else "", quote=fmt.field_optionally_enclosed_by or '"')
    writer.format(fmt.type).save(path)
