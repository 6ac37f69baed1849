"""Shared plumbing of the training-data operators: tables, shared scratch space, Arrow mapping."""

from __future__ import annotations

import atexit
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of one Arrow batch.
BATCH_BYTES = 2 << 20
#: Rows that the Parquet reader decodes at once.
READ_ROWS = 512
#: Bytes of text that are gathered from short batches to be worked on at once.
GATHER = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests, a laptop) a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now: Spark does it when the driver's garbage is collected,
    by itself every half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted at exit like what ``materialize`` writes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete_scratch() -> None:
    """Delete what ``materialize`` wrote; called at exit, when no lazy result can still need it."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            return


atexit.register(delete_scratch)


def publish(spark: SparkSession, data: Iterable[bytes], kind: str) -> str:
    """Write a file to the shared folder and have every executor fetch it; the name to map it by (``SparkFiles.get``).

    It goes with the other scratch files.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, kind))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    out = fs.create(path, True)
    for part in data:
        for i in range(0, len(part), 4 << 20):
            out.write(bytearray(part[i : i + (4 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def pack_arrays(arrays: dict[str, np.ndarray]) -> Iterator[bytes]:
    """A file of named arrays that ``map_arrays`` maps: a line that says where they are, then each at a multiple of 8."""
    at, where = 0, {}
    for name, a in arrays.items():
        where[name] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    yield head
    for a in arrays.values():
        yield a.tobytes() + bytes(-a.nbytes % 8)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        head = f.readline()
    base = len(head)
    return {name: data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in json.loads(head).items()}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of tasks over long texts, in the JVM and in Python workers.

    An Arrow batch has ``BATCH_BYTES`` bytes, but for one larger row, and the Parquet reader decodes ``READ_ROWS`` rows
    at a time. The session keeps both, since results are lazy; they change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions of one batch; a dict of columns is turned into a batch of ``schema``."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(f.__module__)
        for b in batches:
            out = f(b)
            if isinstance(out, dict):
                out = to_batch(out, arrow)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(schema: str) -> pa.Schema:
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    return pa.schema([pa.field(n, _TYPES[t.strip()]) for n, t in fields])


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema
    )


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` has ``GATHER`` bytes: what is worked on depends on sizes alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= GATHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def valid(column: pa.Array) -> pa.Array:
    """The column with U+FFFD for bytes that aren't UTF-8."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())
    return column


def joined(words: pa.Array, by: str) -> str:
    """The strings of a column without nulls, joined: much cheaper than a Python string for each."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, by)[0].as_py() or ""


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty, bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw(column)]


def empty_if_void(df: DataFrame, column: str) -> DataFrame:
    """A column of type void (all null) becomes a string column."""
    if isinstance(df.schema[column].dataType, T.NullType):
        df = df.withColumn(column, df[column].cast("string"))
    return df


_caches: dict[str, Callable[[], None]] = {}


def cached(module: str, clear: Callable[[], None]) -> None:
    """Say how to empty the caches of a module; Python workers outlive the operators that filled them."""
    _caches[module] = clear


def forget_others(module: str) -> None:
    """Called where a task of an operator begins: the caches of other operators go, and their memory with them."""
    for name, clear in _caches.items():
        if name != module:
            clear()
    give_back()


def give_back() -> None:
    """Return the freed memory that Arrow and the C allocator keep to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc: memory is kept for later
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, after which the worker gives its memory back: idle workers stay beside the JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def keep_freed_memory() -> None:
    """Have the C allocator of this Python worker keep up to 64 MB of freed memory for the next arrays.

    Otherwise each numpy temporary over 128 KB is mapped and unmapped, and page faults cost more than the sums.
    """
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # no glibc: slower, otherwise alike
        pass
