"""Versioned tables over Parquet: DML, time travel, change streams and dynamic tables.

A table is a folder of parts, each a Parquet folder that never changes, and a log with a JSON file for every
version that names its parts. A version appears when its log file is renamed into place. Inserts add a part and
touch nothing else; updates, deletes and merges rewrite only the parts with rows that change. Rows carry an id for
life, so the difference of two versions, read from the parts that they don't share, tells inserts, updates and
deletes apart.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "METADATA$ROW_ID"


class MergeError(ValueError):
    """Several source rows fit one target row."""


@dataclass(frozen=True)
class Version:
    number: int
    time: float
    operation: str
    parts: tuple[str, ...]
    schema: str


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- files ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def log(self) -> list[Version]:
        """All versions, oldest first."""
        p, fs = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        out = []
        for n in names:
            o = json.loads(self._read_text(f"{self.path}/_log/{n}"))
            out.append(Version(o["number"], o["time"], o["operation"], tuple(o["parts"]), o["schema"]))
        return out

    def _commit(self, operation: str, parts: Sequence[str], schema: str, number: int) -> Version:
        v = Version(number, time.time(), operation, tuple(parts), schema)
        temporary, fs = self._fs(f"{self.path}/_log/.{uuid.uuid4().hex}")
        fs.mkdirs(temporary.getParent())
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(v.__dict__).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/_log/{number:010d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {number} was written by another session; run the statement again")
        return v

    # --- reading ---

    def version(self, number: int | None = None) -> Version:
        found = self.log()
        if not found:
            raise ValueError(f"{self.path} is no versioned table")
        return found[-1] if number is None else next(v for v in found if v.number == number)

    def at(self, version: int | None = None, timestamp: float | None = None, offset: float | None = None, before: bool = False) -> Version:
        """AT or BEFORE a version, a time (seconds since 1970) or an offset in seconds from now."""
        if offset is not None:
            timestamp = time.time() + offset
        found = self.log()
        if timestamp is not None:
            fits = [v for v in found if (v.time < timestamp if before else v.time <= timestamp)]
        else:
            fits = [v for v in found if version is None or (v.number < version if before else v.number <= version)]
        if not fits:
            raise ValueError("the table is younger than that")
        return fits[-1]

    def read(self, version: Version | int | None = None, row_id: bool = False, parts: Sequence[str] | None = None) -> DataFrame:
        v = version if isinstance(version, Version) else self.version(version)
        schema = T.StructType.fromJson(json.loads(v.schema))
        wide = T.StructType([*schema, T.StructField(ROW_ID, T.StringType())])
        names = v.parts if parts is None else parts
        paths = [f"{self.path}/{p}" for p in names]
        df = self.spark.read.schema(wide).parquet(*paths) if paths else self.spark.createDataFrame([], wide)
        return df if row_id else df.drop(ROW_ID)

    # --- writing ---

    def _write(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _with_ids(self, df: DataFrame) -> DataFrame:
        # ids of one writer run; a task that runs again writes its part anew, so each id is written once
        run = uuid.uuid4().hex[:12]
        return df.withColumn(ROW_ID, F.concat(F.lit(run + "-"), F.monotonically_increasing_id().cast("string")))

    @classmethod
    def create(cls, df: DataFrame, path: str, operation: str = "CREATE") -> VersionedTable:
        t = cls(df.sparkSession, path)
        if t.log():
            raise ValueError(f"{path} exists")
        t._commit(operation, [t._write(t._with_ids(df))], df.schema.json(), 0)
        return t

    def _next(self) -> tuple[Version, int]:
        v = self.version()
        return v, v.number + 1

    def _fitted(self, df: DataFrame, v: Version) -> DataFrame:
        """Columns by name, in the table's types; missing ones are null."""
        schema = T.StructType.fromJson(json.loads(v.schema))
        have = {c.lower(): c for c in df.columns}
        return df.select(*(F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def insert(self, df: DataFrame, overwrite: bool = False) -> Version:
        v, n = self._next()
        part = self._write(self._with_ids(self._fitted(df, v)))
        return self._commit("INSERT OVERWRITE" if overwrite else "INSERT", [part] if overwrite else [*v.parts, part], v.schema, n)

    def truncate(self) -> Version:
        v, n = self._next()
        return self._commit("TRUNCATE", [], v.schema, n)

    def restore(self, version: int) -> Version:
        """UNDROP, or going back: an earlier version's parts as a new version."""
        v, n = self._next()
        old = self.version(version)
        return self._commit("RESTORE", old.parts, old.schema, n)

    def clone(self, path: str, version: int | None = None) -> VersionedTable:
        """CLONE: its own folder and ids that last; parts are copied as they can't be shared across folders."""
        v = self.version(version)
        t = VersionedTable(self.spark, path)
        t._commit("CLONE", [t._write(self.read(v, row_id=True))], v.schema, 0)
        return t

    def swap(self, other: VersionedTable) -> None:
        """SWAP WITH: both folders change names."""
        a, fs = self._fs(self.path)
        b, _ = self._fs(other.path)
        c, _ = self._fs(f"{self.path}.{uuid.uuid4().hex}")
        fs.rename(a, c)
        fs.rename(b, a)
        fs.rename(c, b)

    def _touched(self, v: Version, hit: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Parts with rows that change."""
        found = hit(self.read(v, row_id=True).withColumn("_file", F.col("_metadata.file_path")))
        names = found.select(F.regexp_extract("_file", r"(part-[0-9a-f]{32})", 1).alias("p")).distinct().collect()  # a row for each part
        return [r["p"] for r in names]

    def _rewrite(self, operation: str, v: Version, n: int, touched: list[str], new: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> Version:
        kept = [p for p in v.parts if p not in touched]
        out = new(self.read(v, row_id=True, parts=touched)) if touched else None
        if out is not None:
            kept.append(self._write(out))
        if more is not None:
            kept.append(self._write(self._with_ids(self._fitted(more, v))))
        return self._commit(operation, kept, v.schema, n)

    def delete(self, condition: Column) -> Version:
        v, n = self._next()
        hit = F.coalesce(condition, F.lit(False))
        touched = self._touched(v, lambda df: df.filter(hit))
        return self._rewrite("DELETE", v, n, touched, lambda df: df.filter(~hit))

    def delete_using(self, source: DataFrame, on: Callable[[DataFrame, DataFrame], Column]) -> Version:
        v, n = self._next()
        semi = lambda df: df.join(source, on(df, source), "left_semi")
        touched = self._touched(v, semi)
        return self._rewrite("DELETE", v, n, touched, lambda df: df.join(source, on(df, source), "left_anti"))

    def update(self, assignments: dict[str, Column], condition: Column | None = None) -> Version:
        v, n = self._next()
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        touched = self._touched(v, lambda df: df.filter(hit))

        def new(df: DataFrame) -> DataFrame:
            # all assignments see the old row
            old = {c: F.when(hit, e.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, e in assignments.items()}
            return df.select(*(old[c].alias(c) if c in old else F.col(f"`{c}`") for c in df.columns))

        return self._rewrite("UPDATE", v, n, touched, new)

    def update_from(self, source: DataFrame, on: Sequence[str], assignments: dict[str, Column]) -> Version:
        """UPDATE ... FROM: expressions name target columns ``t.x`` and source columns ``s.x``.

        Of several source rows that fit a target row the least one, by its other columns, is taken.
        """
        others = [c for c in source.columns if c not in on]
        least = F.min(F.struct(*(F.col(f"`{c}`") for c in others))) if others else F.first(F.lit(None))
        one = source.groupBy(*on).agg(least.alias("_row")).select(*on, *(F.col(f"_row.`{c}`") for c in others))
        return self.merge(one, on, matched_update=assignments)

    def merge(
        self,
        source: DataFrame,
        on: Sequence[str],
        matched_update: dict[str, Column] | None = None,
        matched_delete: Column | None = None,
        matched_if: Column | None = None,
        insert: dict[str, Column] | None = None,
        insert_if: Column | None = None,
    ) -> Version:
        """MERGE INTO: expressions name target columns ``t.x`` and source columns ``s.x``.

        A matched row is deleted where ``matched_delete`` holds, else updated where ``matched_if`` does. Rows of
        the source that match nothing are inserted. Several source rows for one target row raise.
        """
        v, n = self._next()
        target = self.read(v, row_id=True)
        keys = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in on]

        def both(df: DataFrame, how: str) -> DataFrame:
            cond = F.lit(True)
            for k in keys("t", "s"):
                cond = cond & k
            return df.alias("t").join(source.withColumn("_hit", F.lit(True)).alias("s"), cond, how)

        inner = both(target, "inner")
        acts = F.lit(False)
        if matched_delete is not None:
            acts = acts | F.coalesce(matched_delete, F.lit(False))
        if matched_update is not None:
            acts = acts | (F.lit(True) if matched_if is None else F.coalesce(matched_if, F.lit(False)))
        many = inner.filter(acts).groupBy(F.col(f"t.`{ROW_ID}`")).agg(F.count("*").alias("n")).filter("n > 1")
        if not many.isEmpty():
            raise MergeError("several source rows fit one target row")
        touched = self._touched(v, lambda df: both(df, "inner").filter(acts).select("t.*"))

        def new(df: DataFrame) -> DataFrame:
            met = both(df, "left")
            hit = F.coalesce(F.col("s._hit"), F.lit(False))
            gone = hit & F.coalesce(matched_delete, F.lit(False)) if matched_delete is not None else F.lit(False)
            change = hit & ~gone & (F.lit(True) if matched_if is None else F.coalesce(matched_if, F.lit(False)))
            sets = matched_update or {}
            cols = [
                (F.when(change, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(f"t.`{c}`")) if c in sets else F.col(f"t.`{c}`")).alias(c)
                for c in df.columns
            ]
            # a target row that several source rows fit without effect stays once
            return met.filter(~gone).select(*cols).dropDuplicates([ROW_ID])

        more = None
        if insert is not None:
            cond = F.lit(True)
            for k in keys("t", "s"):
                cond = cond & k
            rest = source.alias("s").join(target.alias("t"), cond, "left_anti")
            rest = rest if insert_if is None else rest.filter(insert_if)
            more = rest.select(*(e.alias(c) for c, e in insert.items()))
        return self._rewrite("MERGE", v, n, touched, new, more)

    # --- changes ---

    def changes(self, start: int, end: int | None = None, append_only: bool = False) -> DataFrame:
        """CHANGES (INFORMATION => DEFAULT | APPEND_ONLY): net changes after version ``start`` up to ``end``.

        An update is a DELETE of the old and an INSERT of the new row, both with METADATA$ISUPDATE. Only parts
        that the two versions don't share are read.
        """
        a, b = self.version(start), self.version(end)
        old = self.read(a, row_id=True, parts=[p for p in a.parts if p not in b.parts])
        new = self.read(b, row_id=True, parts=[p for p in b.parts if p not in a.parts])
        names = [c for c in new.columns if c != ROW_ID]
        left = old.select(F.col(f"`{ROW_ID}`").alias("_id"), F.struct(*(c for c in old.columns if c != ROW_ID)).alias("_old"))
        right = new.select(F.col(f"`{ROW_ID}`").alias("_id"), F.struct(*names).alias("_new"))
        met = left.join(right, "_id", "full").filter(F.col("_old").isNull() | F.col("_new").isNull() | ~F.to_json("_old").eqNullSafe(F.to_json("_new")))
        update = F.col("_old").isNotNull() & F.col("_new").isNotNull()
        row = lambda action, side: F.struct(F.lit(action).alias("a"), F.col(side).alias("r"))
        rows = F.array(F.when(F.col("_old").isNotNull(), row("DELETE", "_old")), F.when(F.col("_new").isNotNull(), row("INSERT", "_new")))
        out = met.select("_id", update.alias("_u"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x"))
        out = out.select("x.r.*", F.col("x.a").alias("METADATA$ACTION"), F.col("_u").alias("METADATA$ISUPDATE"), F.col("_id").alias(ROW_ID))
        return out.filter("`METADATA$ACTION` = 'INSERT' AND NOT `METADATA$ISUPDATE`") if append_only else out


class Stream:
    """STREAM ON TABLE: changes since an offset, which moves only when a consumer has committed."""

    def __init__(self, table: VersionedTable, append_only: bool = False, show_initial_rows: bool = False, view: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.table, self.append_only, self.view = table, append_only, view
        self.offset = table.version().number
        self.initial = show_initial_rows

    def read(self, end: int | None = None) -> DataFrame:
        if self.initial:
            rows = self.table.read(end, row_id=True)
            out = rows.withColumn("METADATA$ACTION", F.lit("INSERT")).withColumn("METADATA$ISUPDATE", F.lit(False))
        else:
            out = self.table.changes(self.offset, end, self.append_only)
        return self.view(out) if self.view else out

    def has_data(self) -> bool:
        """SYSTEM$STREAM_HAS_DATA."""
        return self.initial or self.table.version().number > self.offset

    def backlog(self) -> list[Version]:
        """SYSTEM$STREAM_BACKLOG: versions that aren't consumed yet."""
        return [v for v in self.table.log() if v.number > self.offset]

    def consume(self, sink: Callable[[DataFrame], object]) -> None:
        """Give the changes to ``sink``; the offset moves if it doesn't raise."""
        end = self.table.version().number
        sink(self.read(end))
        self.offset, self.initial = end, False


class DynamicTable:
    """A query's result over versioned tables, refreshed in full, or incrementally where rows map one to one."""

    def __init__(self, path: str, source: VersionedTable, query: Callable[[DataFrame], DataFrame], mode: str = "AUTO", incremental: bool = False) -> None:
        self.source, self.query = source, query
        self.mode = "INCREMENTAL" if mode == "INCREMENTAL" or mode == "AUTO" and incremental else "FULL"
        self.at = source.version().number
        self.table = VersionedTable.create(query(source.read(row_id=True)) if self.mode == "INCREMENTAL" else query(source.read()), path)
        self.history: list[tuple[float, str, int]] = [(time.time(), "INITIAL", self.at)]

    def refresh(self) -> str:
        end = self.source.version().number
        if end == self.at:
            action = "NO_DATA"
        elif self.mode == "FULL":
            self.table.insert(self.query(self.source.read(end)), overwrite=True)
            action = "FULL"
        else:
            changed = self.source.changes(self.at, end)
            gone = changed.filter("`METADATA$ACTION` = 'DELETE'").select(F.col(f"`{ROW_ID}`").alias("_gone"))
            new = changed.filter("`METADATA$ACTION` = 'INSERT'").drop("METADATA$ACTION", "METADATA$ISUPDATE")
            self.table.delete_using(gone, lambda t, s: t["source_row_id"] == s["_gone"])
            self.table.insert(self.query(new))
            action = "INCREMENTAL"
        self.at = end
        self.history.append((time.time(), action, end))
        return action


def insert_all(source: DataFrame, branches: Sequence[tuple[Column | None, VersionedTable, Callable[[DataFrame], DataFrame]]], first: bool = False) -> None:
    """INSERT ALL | FIRST: each branch is (WHEN condition or None for ELSE, table, projection).

    With ``first`` a row goes to the first branch whose condition holds. The source is kept while it is written.
    """
    number = F.lit(None).cast("int")
    for i, (cond, _, _) in reversed(list(enumerate(branches))):
        number = F.when(F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)), i).otherwise(number)
    tagged = source.withColumn("_branch", number).persist()
    try:
        any_hit = F.lit(False)
        for cond, _, _ in branches:
            if cond is not None:
                any_hit = any_hit | F.coalesce(cond, F.lit(False))
        for i, (cond, table, project) in enumerate(branches):
            hit = F.col("_branch") == i if first else (~any_hit if cond is None else F.coalesce(cond, F.lit(False)))
            table.insert(project(tagged.filter(hit).drop("_branch")))
    finally:
        tagged.unpersist()
