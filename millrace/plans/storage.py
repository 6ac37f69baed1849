"""Queries of versioned tables, change streams, staged files, tasks, text and model functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ai, context, files
from ..session import scratch
from ..sources import staged
from ..streaming import history, tasks
from ..streaming.versions import DynamicTable, Stream, VersionedTable, insert_all
from .book import Book, Tables

BOOK = Book()
query = BOOK.query


def _customers(t: Tables) -> VersionedTable:
    return VersionedTable.create(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), scratch(t.spark, "customers"))


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 5")
def dml_update_delete(t: Tables) -> DataFrame:
    v = _customers(t)
    v.update({"c_acctbal": F.col("c_acctbal") + 100}, F.col("c_nationkey") == 3)
    v.delete(F.col("c_nationkey") == 5)
    return v.read()


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def time_travel(t: Tables) -> DataFrame:
    v = _customers(t)
    v.truncate()
    v.insert(t.customer.select("c_custkey", "c_nationkey", F.lit(0.0).alias("c_acctbal")))
    return v.read(v.at(version=1, before=True))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN o.n IS NULL THEN c_acctbal ELSE o.n::DOUBLE END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE coalesce(n, 0) <= 30
UNION ALL SELECT 1000000 + range, 0, 0.0 FROM range(3)""")
def dml_merge(t: Tables) -> DataFrame:
    v = _customers(t)
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    new = t.spark.range(3).select((F.col("id") + 1_000_000).alias("c_custkey"), F.lit(0).cast("long").alias("n"))
    v.merge(
        counts.unionAll(new), ["c_custkey"], matched_update={"c_acctbal": F.col("s.n").cast("double")}, matched_delete=F.col("s.n") > 30,
        insert={"c_custkey": F.col("s.c_custkey"), "c_nationkey": F.lit(0), "c_acctbal": F.lit(0.0)},
    )
    return v.read()


@query(
    "SELECT c_custkey, c_nationkey, coalesce(o.least, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS least FROM orders GROUP BY 1) o ON o_custkey = c_custkey"
)
def dml_update_from(t: Tables) -> DataFrame:
    """Of a customer's orders the one with the least price is taken."""
    v = _customers(t)
    v.update_from(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), ["c_custkey"], {"c_acctbal": F.col("s.o_totalprice")})
    return v.read()


@query("""SELECT c_custkey, c_acctbal + 1 AS c_acctbal, 'INSERT' AS action, true AS is_update FROM customer WHERE c_nationkey = 7
UNION ALL SELECT c_custkey, c_acctbal, 'DELETE', true FROM customer WHERE c_nationkey = 7 UNION ALL SELECT c_custkey, c_acctbal, 'DELETE', false FROM customer WHERE c_nationkey = 8
UNION ALL SELECT 5000000, 1.5, 'INSERT', false""")
def stream_changes(t: Tables) -> DataFrame:
    v = _customers(t)
    stream = Stream(v)
    v.update({"c_acctbal": F.col("c_acctbal") + 1}, F.col("c_nationkey") == 7)
    v.delete(F.col("c_nationkey") == 8)
    v.insert(t.spark.range(1).select(F.lit(5_000_000).cast("long").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal")))
    out = stream.read()
    return out.select("c_custkey", "c_acctbal", F.col("METADATA$ACTION").alias("action"), F.col("METADATA$ISUPDATE").alias("is_update"))


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT 1) GROUP BY c_nationkey")
def dynamic_table(t: Tables) -> DataFrame:
    v = _customers(t)
    d = DynamicTable(scratch(t.spark, "dynamic"), v, lambda df: df.groupBy("c_nationkey").agg(F.count("*").alias("n")))
    v.insert(t.spark.range(1).select(F.lit(6_000_000).cast("long").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal")))
    d.refresh()
    return d.table.read()


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1")
def insert_first(t: Tables) -> DataFrame:
    made = {b: VersionedTable.create(t.customer.limit(0).select("c_custkey", F.lit("").alias("band")), scratch(t.spark, b)) for b in ("low", "mid", "high")}
    to = lambda b: lambda df: df.select("c_custkey", F.lit(b).alias("band"))
    insert_all(t.customer, [(F.col("c_acctbal") < 0, made["low"], to("low")), (F.col("c_acctbal") < 5000, made["mid"], to("mid")), (None, made["high"], to("high"))], first=True)
    out = made["low"].read().unionAll(made["mid"].read()).unionAll(made["high"].read())
    return out.groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def unload_and_copy(t: Tables) -> DataFrame:
    stage, target = scratch(t.spark, "stage"), scratch(t.spark, "loaded")
    fmt = staged.FileFormat(type="csv", field_optionally_enclosed_by='"')
    staged.unload(t.nation, stage, fmt)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    log = staged.LoadHistory()
    staged.copy_into(t.spark, "nation", stage, fmt, schema, target, pattern=r"\.csv$", history=log)
    staged.copy_into(t.spark, "nation", stage, fmt, schema, target, pattern=r"\.csv$", history=log)  # nothing new
    return t.spark.read.schema(schema).parquet(target)


@query("SELECT * FROM (VALUES ('c1', 'BIGINT'), ('c2', 'STRING'), ('c3', 'BIGINT')) v(COLUMN_NAME, TYPE)")
def infer_schema(t: Tables) -> DataFrame:
    stage = scratch(t.spark, "stage")
    staged.unload(t.nation, stage, staged.FileFormat())
    found = staged.infer(t.spark, stage, staged.FileFormat())
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString().upper()) for f in found], "COLUMN_NAME string, TYPE string")


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS seq FROM nation")
def row_ordinals(t: Tables) -> DataFrame:
    return context.seq(t.nation, "seq", 8, "n_name").select("n_name", "seq")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def flow_and_result_scan(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    history.flow(t.spark, "SELECT * FROM nation WHERE n_regionkey = 2 ->> SELECT n_name FROM $1")
    return history.result_scan(-1)


@query("SELECT 'load' AS NAME, 'SUCCEEDED' AS STATE UNION ALL SELECT 'check', 'SUCCEEDED' UNION ALL SELECT 'never', 'SKIPPED'")
def task_graph(t: Tables) -> DataFrame:
    g = tasks.TaskGraph()
    g.add(tasks.Task("load", lambda: None))
    g.add(tasks.Task("check", lambda: None, after=("load",)))
    g.add(tasks.Task("never", lambda: None, after=("check",), when=lambda: False))
    g.run()
    return g.history(t.spark).select("NAME", "STATE")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def pipe_ingest(t: Tables) -> DataFrame:
    """A file stream that runs until it has read all that is there."""
    stage, target = scratch(t.spark, "arrivals"), scratch(t.spark, "piped")
    e = t.events.select("event_id", "event_type")
    e.write.parquet(stage)
    tasks.pipe(t.spark, stage, "parquet", e.schema, target, scratch(t.spark, "offsets")).awaitTermination()
    return t.spark.read.schema(e.schema).parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS BIGINT) AS n FROM conversations")
def count_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", ai.count_tokens("text").cast("long").alias("n"))


@query()
def split_text(t: Tables) -> DataFrame:
    chunks = ai.split_text_recursive_character("text", "none", 500, 50)
    return t.documents.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query()
def model_functions(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", ai.sentiment("text").alias("sentiment"), ai.summarize("text").alias("summary"), ai.classify_text("text", ["question", "answer"]).alias("label"),
    )


@query()
def embedding_search(t: Tables) -> DataFrame:
    """The ten documents most similar to a query text."""
    from ..functions.vectors import vector_inner_product

    asked = F.array(*(F.lit(float(x)) for x in ai.embed("of the thing that", 768)))
    scored = t.documents.select("doc_id", vector_inner_product(ai.embed_text_768("text"), asked).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT p_partkey, p_name || '.pdf' AS path, 'document' AS kind FROM part")
def file_values(t: Tables) -> DataFrame:
    f = files.to_file("parts", F.concat("p_name", F.lit(".pdf")))
    return t.part.select("p_partkey", files.REGISTRY["FL_GET_RELATIVE_PATH"](f).alias("path"), files.fl_get_file_type(f).alias("kind"))
