"""The session's log of statements, with their results for RESULT_SCAN and the flow operator."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dialect
from ..session import scratch


@dataclass
class Statement:
    query_id: str
    text: str
    started: float
    seconds: float
    result: DataFrame | None
    error: str | None = None
    path: str | None = None


QUERY_LOG: list[Statement] = []
#: Statements that the log keeps.
KEPT = 1_000


#: First words of statements whose rows are kept as they were.
QUERIES = ("SELECT", "WITH", "VALUES", "FROM", "TABLE", "(")


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df`` as they are now, written to the shared folder, and where: later changes of tables, random
    values and clocks don't reach them."""
    spark = df.sparkSession
    path = scratch(spark, "result")
    fields = df.schema.fields
    void = [isinstance(f.dataType, T.NullType) for f in fields]
    plain = df.toDF(*(f"c{i}" for i in range(len(fields))))
    plain.select(*(F.col(f"c{i}").cast("string") if v else F.col(f"c{i}") for i, v in enumerate(void))).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select(*((F.lit(None) if v else F.col(f"c{i}")).alias(f.name) for i, (f, v) in enumerate(zip(fields, void, strict=True)))), path


def _results(spark: SparkSession, text: str) -> str:
    """``$1``, ``$2``, ... outside of strings as the results of the statements before."""
    out: list[str] = []
    ts = dialect.tokens(text)
    for k, t in enumerate(ts):
        if out and out[-1] == "$" and t.isdigit() and 0 < int(t) <= len(QUERY_LOG) and (s := QUERY_LOG[-int(t)]).result is not None:
            s.result.createOrReplaceTempView(f"_result_{t}")
            out[-1:] = [f"_result_{t}"]
        else:
            out.append(t)
    return "".join(out)


def run(spark: SparkSession, text: str, **binds: object) -> DataFrame:
    """A statement, logged with its result. ``$1``, ``$2``, ... name the results of the statements before."""
    began = time.time()
    text = _results(spark, text)
    first = next((t for t in dialect.tokens(text) if t.strip() and not t.startswith(("--", "/*"))), "")
    path = None
    try:
        out = spark.sql(text, args=binds or None)
        if first.upper() in QUERIES:
            out, path = kept(out)
    except Exception as e:
        _log(spark, Statement(uuid.uuid4().hex, text, began, time.time() - began, None, str(e)))
        raise
    _log(spark, Statement(uuid.uuid4().hex, text, began, time.time() - began, out, None, path))
    return out


def _log(spark: SparkSession, s: Statement) -> None:
    QUERY_LOG.append(s)
    for old in QUERY_LOG[:-KEPT]:
        if old.path:
            p = spark._jvm.org.apache.hadoop.fs.Path(old.path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del QUERY_LOG[:-KEPT]


def flow(spark: SparkSession, text: str) -> DataFrame:
    """``statement ->> statement ->> ...``: the last result."""
    out = None
    for part in dialect.split(text, "->>"):
        out = run(spark, part.strip())
    return out


def result_scan(query_id: str | int = -1) -> DataFrame:
    """RESULT_SCAN of a statement's id, or of a place in the log."""
    s = QUERY_LOG[query_id] if isinstance(query_id, int) else next(s for s in QUERY_LOG if s.query_id == query_id)
    if s.result is None:
        raise ValueError(f"{s.query_id} has no result")
    return s.result


def query_history(spark: SparkSession) -> DataFrame:
    rows = [(s.query_id, s.text, s.started, s.seconds, "FAILED" if s.error else "SUCCESS", s.error) for s in QUERY_LOG]
    return spark.createDataFrame(rows, "QUERY_ID string, QUERY_TEXT string, START_TIME double, ELAPSED_SECONDS double, STATUS string, ERROR_MESSAGE string")
