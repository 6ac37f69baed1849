"""Operators on small tables with expected rows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import groups, joins, patterns, policies, rows, sets, tables
from millrace.session import scratch
from millrace.sources import staged
from millrace.streaming import tasks
from millrace.streaming.versions import DynamicTable, MergeError, Stream, VersionedTable


def values(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_order_puts_nulls_last_ascending_first_descending(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in rows.order_by(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in rows.order_by(df, ("x", "desc")).collect()] == [None, 2, 1]
    assert [r.x for r in rows.order_by(df, ("x", "desc", "last")).collect()] == [2, 1, None]


def test_star_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        rows.star(spark.range(1), exclude=["nope"])


def test_quantified_comparisons_are_three_valued(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    some = spark.createDataFrame([(1,), (None,)], "v int")
    assert values(rows.any_all(df, "x", "=", some, "ANY")) == [(1,)]
    assert values(rows.any_all(df, "x", "<>", some, "ALL")) == []
    assert values(rows.any_all(df, "x", "<>", some.filter("v = 1"), "ALL")) == [(2,)]
    assert len(values(rows.any_all(df, "x", ">", some.limit(0), "ALL"))) == 3


def test_exact_row_sample(spark):
    assert rows.sample_rows(spark.range(50), 7).count() == 7 and rows.sample_rows(spark.range(5), 7).count() == 5


def test_asof_boundaries(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("a", t(10), 1), ("a", t(20), 2), ("b", t(5), 3), ("a", None, 4), (None, t(10), 5)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", t(10), 100), ("a", t(15), 150), ("b", t(6), 60)], "k string, rt timestamp, v int")
    got = lambda op, size=86400: dict(values(joins.asof(left, right, "ts", "rt", op, ["k"], size).select("id", "v")))
    for size in (86400, 3):  # one bucket, or matches found in buckets before
        assert got(">=", size) == {1: 100, 2: 150, 3: None, 4: None, 5: None}
        assert got(">", size) == {1: None, 2: 150, 3: None, 4: None, 5: None}
        assert got("<=", size) == {1: 100, 2: None, 3: 60, 4: None, 5: None}
        assert got("<", size) == {1: 150, 2: None, 3: 60, 4: None, 5: None}


def test_connect_by_cycles(spark):
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "child int, parent int")
    with pytest.raises(sets.HierarchyCycle):
        sets.connect_by(ring, F.col("child") == 1, "child", "parent")
    out = sets.connect_by(ring, F.col("child") == 1, "child", "parent", {"path": "child"}, nocycle=True)
    assert values(out.select("child", "level", "path")) == [(1, 1, "/1"), (2, 2, "/1/2"), (3, 3, "/1/2/3")]


def test_deep_chains(spark):
    chain = spark.range(1, 26).select(F.col("id").alias("c"), (F.col("id") - 1).alias("p"))
    assert sets.connect_by(chain, F.col("c") == 1, "c", "p").agg(F.max("level")).first()[0] == 25


def test_match_recognize_modes(spark):
    prices = [90, 80, 70, 75, 85, 80, 60, 65]
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate(prices)], "s string, i int, p int")
    w = Window.partitionBy("s").orderBy("i")
    define = {"DOWN": F.col("p") < F.lag("p").over(w), "UP": F.col("p") > F.lag("p").over(w)}
    v = lambda **k: values(patterns.match_recognize(df, ["s"], [F.col("i")], "DOWN+ UP+", define, {"first": ("first", "DOWN", "i"), "last": ("last", "UP", "i"), "n": ("count", "", "i"), "m": ("match_number",)}, **k))
    assert v() == [("x", 1, 4, 4, 1), ("x", 5, 7, 3, 2)]
    assert v(skip="TO NEXT ROW") == [("x", 1, 4, 4, 1), ("x", 2, 4, 3, 2), ("x", 5, 7, 3, 3), ("x", 6, 7, 2, 4)]
    every = patterns.match_recognize(df, ["s"], [F.col("i")], "DOWN {- UP -}", define, {"c": ("classifier",)}, rows="ALL ROWS PER MATCH")
    assert values(every.select("i", "c")) == [(2, "DOWN"), (6, "DOWN")]
    spare = patterns.match_recognize(df, ["s"], [F.col("i")], "^ ANY_ DOWN", define, {"m": ("match_number",)}, rows="ALL ROWS PER MATCH WITH UNMATCHED ROWS")
    assert values(spare.select("i", "m"))[:3] == [(0, 1), (1, 1), (2, None)] and spare.count() == 8
    both = patterns.match_recognize(df, ["s"], [F.col("i")], "PERMUTE(UP, DOWN)", define, {"a": ("first", "", "i")})
    assert values(both) == [("x", 2), ("x", 4), ("x", 6)]


def test_flatten_modes(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": 2}], "c": null}'), (2, "[]")], "id int, s string").select("id", F.parse_json("s").alias("v"))
    got = tables.flatten(df, "v", sql_seq="id").select("id", "KEY", "PATH")
    assert values(got) == [(1, "a", "a"), (1, "c", "c")]
    assert tables.flatten(df, "v", outer=True, sql_seq="id").filter("id = 2").count() == 1
    deep = tables.flatten_recursive(df, "v", "id")
    assert [r[0] for r in values(deep.select("PATH"))] == ["a", "a[0]", "a[1]", "a[1].b", "c"]


def test_pivot_default_and_unpivot(spark):
    df = spark.createDataFrame([("e", "jan", 1), ("e", "feb", 2), ("f", "jan", 3)], "emp string, mon string, amt int")
    assert values(groups.pivot(df, ["emp"], "mon", F.sum("amt"), default=0)) == [("e", 2, 1), ("f", 0, 3)]
    wide = spark.createDataFrame([(1, 5, None)], "id int, a int, b int")
    assert values(groups.unpivot(wide, ["a", "b"], "k", "v")) == [(1, "a", 5)]
    assert groups.unpivot(wide, ["a", "b"], "k", "v", include_nulls=True).count() == 2


def test_policies(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    with pytest.raises(PermissionError):
        policies.joined(df, None, [], ["id"])
    assert policies.orphans(df, df.select(F.col("id").alias("pid")).filter("pid = 1"), {"id": "pid"}).count() == 1


# --- versions --------------------------------------------------------------------------------------------


@pytest.fixture
def versioned(spark):
    return VersionedTable.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"), scratch(spark, "t"))


def test_versions_and_parts(spark, versioned):
    t = versioned
    first = t.version()
    t.insert(spark.createDataFrame([(4, "d")], "id int, v string"))
    assert set(first.parts) < set(t.version().parts)  # the old part isn't written again
    t.delete(F.col("id") == 4)
    assert set(first.parts) <= set(t.version().parts)
    t.update({"v": F.concat("v", F.lit("!")), "id": F.col("id") * 10}, F.col("id") > 1)
    assert values(t.read()) == [(1, "a"), (20, "b!"), (30, "c!")]
    assert values(t.read(0)) == [(1, "a"), (2, "b"), (3, "c")]
    assert values(t.read(t.at(timestamp=first.time))) == values(t.read(0))
    t.restore(0)
    assert t.read().count() == 3
    other = t.clone(scratch(spark, "clone"))
    t.truncate()
    assert t.read().count() == 0 and other.read().count() == 3
    t.swap(other)
    assert t.read().count() == 3


def test_merge_rules(spark, versioned):
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    with pytest.raises(MergeError):
        versioned.merge(twice, ["id"], matched_update={"v": F.col("s.v")})
    assert versioned.version().number == 0
    source = spark.createDataFrame([(1, "x"), (3, "gone"), (9, "new")], "id int, v string")
    versioned.merge(source, ["id"], matched_update={"v": F.col("s.v")}, matched_delete=F.col("s.v") == "gone", insert={"id": F.col("s.id"), "v": F.col("s.v")})
    assert values(versioned.read()) == [(1, "x"), (2, "b"), (9, "new")]


def test_streams_are_net_and_move_on_commit(spark, versioned):
    s, appends = Stream(versioned), Stream(versioned, append_only=True)
    versioned.insert(spark.createDataFrame([(4, "d"), (5, "e")], "id int, v string"))
    versioned.delete(F.col("id").isin(5, 1))
    versioned.update({"v": F.lit("B")}, F.col("id") == 2)
    shown = lambda x: values(x.read().select("id", "v", "METADATA$ACTION", "METADATA$ISUPDATE"))
    want = [(1, "a", "DELETE", False), (2, "B", "INSERT", True), (2, "b", "DELETE", True), (4, "d", "INSERT", False)]
    assert shown(s) == want and s.has_data() and len(s.backlog()) == 3
    assert shown(appends) == [(4, "d", "INSERT", False)]

    def fails(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        s.consume(fails)
    assert shown(s) == want
    s.consume(lambda df: df.collect())
    assert shown(s) == [] and not s.has_data()


def test_incremental_dynamic_table(spark, versioned):
    from millrace.streaming.versions import ROW_ID

    query = lambda df: df.select(F.upper("v").alias("u"), F.col(f"`{ROW_ID}`").alias("source_row_id"))
    d = DynamicTable(scratch(spark, "d"), versioned, query, mode="INCREMENTAL")
    versioned.update({"v": F.lit("z")}, F.col("id") == 1)
    versioned.delete(F.col("id") == 2)
    assert d.refresh() == "INCREMENTAL" and d.refresh() == "NO_DATA"
    assert values(d.table.read().select("u")) == [("C",), ("Z",)]


# --- staged files ----------------------------------------------------------------------------------------


def test_copy_rules(spark, tmp_path):
    stage = tmp_path / "stage"
    stage.mkdir()
    (stage / "a.csv").write_text("id,name\n1,x\n2,\\N\n")
    (stage / "b.csv").write_text("id,name\n3,y\noops,z\n")
    fmt = staged.FileFormat(skip_header=1)
    path = f"file://{stage}"
    log = staged.LoadHistory()
    copy = lambda target, **k: staged.copy_into(spark, "t", path, fmt, "id int, name string", f"file://{tmp_path}/{target}", history=log, **k)
    with pytest.raises(staged.FileError):
        copy("one")
    out = {r.file.rsplit("/", 1)[-1]: r for r in copy("two", on_error="SKIP_FILE").collect()}
    assert (out["a.csv"].status, out["a.csv"].rows_loaded, out["b.csv"].status, out["b.csv"].errors_seen) == ("LOADED", 2, "LOAD_FAILED", 1)
    assert values(spark.read.parquet(f"{tmp_path}/two")) == [(1, "x"), (2, None)]
    again = {r.file.rsplit("/", 1)[-1]: r.status for r in copy("two", on_error="CONTINUE").collect()}
    assert again == {"b.csv": "PARTIALLY_LOADED"}
    assert copy("two").count() == 0 and log.frame(spark).count() == 3
    assert staged.directory(spark, path).count() == 2
    assert staged.remove(spark, path, r"a\.csv$") == 1


def test_inference_and_formats(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,1.5,true,2024-01-01,abc\n2,2,false,2024-02-01,\n")
    kinds = [f.dataType.simpleString() for f in staged.infer(spark, f"file://{tmp_path}/x.csv", staged.FileFormat())]
    assert kinds == ["bigint", "decimal(38,9)", "boolean", "date", "string"]
    (tmp_path / "y.json").write_text('[{"a": 1}, {"a": null}]')
    df = staged.read(spark, f"file://{tmp_path}/y.json", staged.FileFormat(type="json", strip_outer_array=True))
    assert df.columns == ["$1"] and df.count() == 2
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    for kind in ("csv", "json", "parquet", "orc"):
        staged.unload(df, f"file://{tmp_path}/{kind}", staged.FileFormat(type=kind))
        back = staged.read(spark, f"file://{tmp_path}/{kind}", staged.FileFormat(type=kind, field_optionally_enclosed_by='"' if kind == "csv" else None), schema="id int, s string")
        assert values(back) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValueError):
        staged.unload(df, f"file://{tmp_path}/z", staged.FileFormat(type="avro"))
    assert staged.merge_types("bigint", "double") == "double" and staged.merge_types("bigint", "date") == "string"


def test_task_graph_skips_after_failure(spark):
    g = tasks.TaskGraph()
    g.add(tasks.Task("a", lambda: 1 / 0))
    g.add(tasks.Task("b", lambda: None, after=("a",)))
    assert g.run() == ["a: FAILED", "b: SKIPPED"] and g.dependents("a") == ["a", "b"]


def test_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stage = scratch(spark, "events")
    events.write.parquet(stage)
    batch = tasks.windowed_counts(events, "ts", ["event_type"], "1 day")
    stream = tasks.windowed_counts(spark.readStream.schema(events.schema).parquet(stage), "ts", ["event_type"], "1 day")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("counts")) == values(batch)


def test_percentiles_by_rank(spark):
    """Against the aggregate functions: ties, nulls, a group of nulls, a null key, one value; and no rows."""
    from pyspark.sql import functions as F

    from millrace.functions import aggregates as A
    from millrace.operators import groups

    rows = [("a", float(i % 7)) for i in range(100)] + [("a", None)] * 5 + [("b", 3.5)] + [("c", None)] * 2 + [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: tuple(r)[1:] for r in groups.percentiles(df, ["k"], "v", {"m": (0.5, "cont"), "h": (0.9, "cont"), "d": (0.25, "disc"), "z": (0.0, "disc")}).collect()}
    want = df.groupBy("k").agg(A.percentile_cont("v", 0.5).alias("m"), A.percentile_cont("v", 0.9).alias("h"), A.percentile_disc("v", 0.25).alias("d"), F.min("v").alias("z"))
    assert {k: tuple(x if x is None else round(float(x), 9) for x in v) for k, v in got.items()} == {r.k: tuple(x if x is None else round(float(x), 9) for x in tuple(r)[1:]) for r in want.collect()}
    assert groups.percentiles(df.limit(0), ["k"], "v", {"m": (0.5, "cont")}).count() == 0
    assert groups.percentiles(df, [], "v", {"m": (1.0, "cont")}).first().m == 9.0
