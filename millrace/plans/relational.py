"""Queries of scans, filters, joins, grouping, windows, order, sets and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import groups, joins, patterns, policies, rows, sets, tables
from .book import Book, Tables

BOOK = Book()
query = BOOK.query
D = lambda c, n=2: F.round(c.cast("double"), n)


@query("""
SELECT n_name, yr, p_name, revenue FROM (
  SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS yr, p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
         row_number() OVER (PARTITION BY n_name, year(o_orderdate) ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, p_partkey) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY n_name, year(o_orderdate), p_partkey, p_name) WHERE rn <= 3
""")
def top_parts_by_nation_year(t: Tables) -> DataFrame:
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    # parts are named after the aggregation, by key
    sold = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("yr"), "l_partkey").agg(revenue.alias("r"))
    )
    best = rows.top_k(sold, 3, ["c_nationkey", "yr"], ("r", "desc"), "l_partkey")
    named = best.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return named.select("n_name", "yr", "p_name", F.round("r", 2).alias("revenue"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F') AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def filter_in_between(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))
    return t.orders.filter((F.col("o_totalprice") > 100000) & F.col("o_orderstatus").isin("O", "F") & day).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CAST(c_acctbal > 0 AS BOOLEAN) AS positive, c_name FROM customer")
def star_modifiers(t: Tables) -> DataFrame:
    out = rows.star(t.customer, exclude=["c_nationkey", "c_mktsegment"], replace={"c_acctbal": F.col("c_acctbal") > 0}, rename={"c_acctbal": "positive"})
    return out.select("c_custkey", "positive", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def star_ilike(t: Tables) -> DataFrame:
    return rows.star(t.customer, ilike="C_%K%").drop("c_nationkey")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size * 2 > 50")
def where_alias(t: Tables) -> DataFrame:
    return rows.with_aliases(t.part, twice="p_size * 2").filter("twice > 50").select("p_partkey", "twice")


@query("SELECT r_regionkey AS a, r_name AS b FROM region")
def positional_columns(t: Tables) -> DataFrame:
    return t.region.select(rows.position(t.region, 1).alias("a"), rows.position(t.region, 2).alias("b"))


@query("SELECT * FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) v(column1, column2)")
def values_relation(t: Tables) -> DataFrame:
    return rows.values(t.spark, [(1, "x"), (2, None), (3, "z")], "column1 int, column2 string")


@query("SELECT range AS seq, range % 7 AS m FROM range(1000)")
def generator_rows(t: Tables) -> DataFrame:
    return rows.generator(t.spark, 1000).withColumn("m", F.col("seq") % 7)


@query("SELECT 'X' AS DUMMY")
def dual(t: Tables) -> DataFrame:
    return rows.dual(t.spark)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%'")
def like_any(t: Tables) -> DataFrame:
    from ..functions import strings

    return t.orders.filter(strings.like_any("o_orderpriority", "1-%", None, "2-%")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F')) AND l_quantity > 45")
def row_constructor_in(t: Tables) -> DataFrame:
    hit = rows.row_in([F.col("l_returnflag"), F.col("l_linestatus")], [("A", "F"), ("R", "F")])
    return t.lineitem.filter(hit & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 1)")
def quantified_all(t: Tables) -> DataFrame:
    return rows.any_all(t.part, "p_retailprice", ">", t.part.filter("p_size = 1").select("p_retailprice"), "ALL").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = ANY (SELECT CAST(l_quantity AS INT) FROM lineitem WHERE l_tax > 0.07 AND l_discount = 0)")
def quantified_any(t: Tables) -> DataFrame:
    some = t.lineitem.filter("l_tax > 0.07 AND l_discount = 0").select(F.col("l_quantity").cast("int"))
    return rows.any_all(t.part, "p_size", "=", some).select("p_partkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def exists_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def not_exists_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def not_in(t: Tables) -> DataFrame:
    t.supplier.createOrReplaceTempView("_s")
    t.nation.createOrReplaceTempView("_n")
    return t.spark.sql("SELECT s_suppkey FROM _s WHERE s_nationkey NOT IN (SELECT n_nationkey FROM _n WHERE n_regionkey = 1)")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(t: Tables) -> DataFrame:
    limit = t.orders.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("edge"))
    return t.orders.join(limit, "o_custkey").filter("o_totalprice > edge").select("o_orderkey", "o_totalprice")


@query("""SELECT n_name, r_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name, r_name""")
def left_join_count(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 9000")
    base = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return base.join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("n"))


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def full_join(t: Tables) -> DataFrame:
    on = (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))
    return t.supplier.join(t.customer, on, "full").select("s_suppkey", "c_custkey")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
def comma_join(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).filter("r_regionkey = n_regionkey").select("r_name", "n_name")


@query("SELECT k, a, b FROM (SELECT r_regionkey AS k, r_name AS a FROM region) NATURAL JOIN (SELECT n_regionkey AS k, n_name AS b FROM nation)")
def natural_join(t: Tables) -> DataFrame:
    return joins.natural(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a")), t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("b")))


@query("SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def plus_outer_join(t: Tables) -> DataFrame:
    return joins.plus_outer(t.nation, t.supplier, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_suppkey")


_LATE = "(SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events))"
_EARLY = "(SELECT user_id, ts AS ts2, max(value) AS value FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id, ts)"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events
    edge = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    left = e.join(F.broadcast(edge), F.col("event_type") == F.col("lo")).select("user_id", "ts", "event_id")
    right = e.join(F.broadcast(edge), F.col("event_type") == F.col("hi")).groupBy("user_id", F.col("ts").alias("ts2")).agg(F.max("value").alias("value"))
    return left, right


@query(f"SELECT a.event_id, b.ts2, b.value FROM {_LATE} a ASOF LEFT JOIN {_EARLY} b ON a.user_id = b.user_id AND a.ts >= b.ts2")
def asof_join(t: Tables) -> DataFrame:
    left, right = _sides(t)
    return joins.asof(left, right, "ts", "ts2", ">=", ["user_id"]).select("event_id", "ts2", "value")


@query(f"SELECT a.event_id, b.ts2, b.value FROM {_LATE} a ASOF LEFT JOIN {_EARLY} b ON a.user_id = b.user_id AND a.ts < b.ts2")
def asof_join_forward(t: Tables) -> DataFrame:
    left, right = _sides(t)
    return joins.asof(left, right, "ts", "ts2", "<", ["user_id"]).select("event_id", "ts2", "value")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT range * 100.0 + 900 AS lo, range * 100.0 + 1050 AS hi FROM range(12)) ON p_retailprice >= lo AND p_retailprice < hi")
def interval_join(t: Tables) -> DataFrame:
    bands = t.spark.range(12).select((F.col("id") * 100.0 + 900).alias("lo"), (F.col("id") * 100.0 + 1050).alias("hi"))
    return joins.interval_join(t.part, bands, "p_retailprice", "lo", "hi", 150.0).select("p_partkey", "lo")


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def salted_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.salted(lines, t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 4).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_name, w FROM nation, unnest(string_split(n_name, 'A')) AS u(w)")
def lateral_items(t: Tables) -> DataFrame:
    return joins.lateral(t.nation, F.split("n_name", "A", -1), "w").select("n_name", "w")


@query("SELECT c_custkey, o.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o")
def lateral_subquery(t: Tables) -> DataFrame:
    best = rows.top_k(t.orders, 1, ["o_custkey"], ("o_totalprice", "desc"), "o_orderkey")
    return t.customer.join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


# --- grouping --------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(t: Tables) -> DataFrame:
    charge = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
        .agg(D(F.sum("l_quantity")).alias("sum_qty"), D(charge, 1).alias("sum_charge"), D(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, CAST(grouping(c_mktsegment, c_nationkey) AS BIGINT) AS g FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(t: Tables) -> DataFrame:
    out = groups.grouping_sets(t.customer, [["c_mktsegment"], ["c_nationkey"], []], {"n": F.count("*"), "total": D(F.sum("c_acctbal"))}, "g")
    return out.withColumn("g", F.col("g").cast("long"))


@query("SELECT c_mktsegment, CAST(c_nationkey % 3 AS INT) AS m, count(*) AS n FROM customer GROUP BY ALL")
def group_by_all(t: Tables) -> DataFrame:
    return groups.group_by_all(t.customer, {"c_mktsegment": F.col("c_mktsegment"), "m": F.col("c_nationkey") % 3}, {"n": F.count("*")})


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND avg(l_quantity) > 25")
def having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q")).filter("n > 20 AND q > 25").drop("q")


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS P FROM orders GROUP BY o_custkey")
def pivot_list(t: Tables) -> DataFrame:
    return groups.pivot(t.orders, ["o_custkey"], "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"], default=0)


@query("SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_acctbal END) AS AUTOMOBILE, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS BUILDING FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING') GROUP BY c_nationkey")
def pivot_any(t: Tables) -> DataFrame:
    return groups.pivot(t.customer.filter(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")), ["c_nationkey"], "c_mktsegment", F.max("c_acctbal"))


@query("SELECT s_suppkey, name, value FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS pos, CASE WHEN s_acctbal <= 0 THEN s_acctbal END AS neg, CAST(s_nationkey AS DOUBLE) AS nat FROM supplier) UNPIVOT (value FOR name IN (pos, neg, nat))")
def unpivot(t: Tables) -> DataFrame:
    base = t.supplier.select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("pos"), F.when(F.col("s_acctbal") <= 0, F.col("s_acctbal")).alias("neg"), F.col("s_nationkey").cast("double").alias("nat")
    )
    return groups.unpivot(base, ["pos", "neg", "nat"], "name", "value")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


# --- windows ---------------------------------------------------------------------------------------------

_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"""SELECT o_orderkey, CAST(row_number() {_OVER} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk,
CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr, round(percent_rank() {_OVER}, 8) AS pr, round(cume_dist() {_OVER}, 8) AS cd, CAST(ntile(4) {_OVER} AS BIGINT) AS nt FROM orders""")
def window_ranking(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c, n: c.cast("long").alias(n)
    return t.orders.select(
        "o_orderkey", long(F.row_number().over(w), "rn"), long(F.rank().over(s), "rk"), long(F.dense_rank().over(s), "dr"),
        F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"), long(F.ntile(4).over(w), "nt"),
    )


@query(f"""SELECT o_orderkey, lag(o_totalprice) {_OVER} AS before, lead(o_totalprice, 2, 0.0) {_OVER} AS after, first_value(o_orderkey) {_OVER} AS fv,
last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nv FROM orders""")
def window_navigation(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    keys = (F.col("o_orderdate"), F.col("o_orderkey"))
    return t.orders.select(
        "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, 0.0).over(w).alias("after"), F.first("o_orderkey").over(w).alias("fv"),
        groups.last_value(F.col("o_orderkey"), ["o_custkey"], *keys).alias("lv"), groups.nth_value(F.col("o_orderkey"), 2, ["o_custkey"], *keys).alias("nv"),
    )


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS sliding,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour,
max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM events""")
def window_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-9, 0)), 6).alias("sliding"),
        F.count("*").over(micros).alias("last_hour"), F.max("value").over(w.rowsBetween(1, 3)).alias("ahead"),
    )


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.qualify(t.orders, lambda rn: rn == 1, rn=F.row_number().over(w)).select("o_custkey", "o_orderkey")


@query("SELECT event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events")
def conditional_true_event(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", groups.conditional_true_event(F.col("value") > 50, w).alias("n"))


@query("""SELECT event_id, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM (
SELECT event_id, user_id, ts, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events)""")
def conditional_change_event(t: Tables) -> DataFrame:
    return groups.conditional_change_events(t.events, "event_type", ["user_id"], F.col("ts"), F.col("event_id"), name="n").select("event_id", "n")


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier")
def ratio_to_report(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(groups.ratio_to_report(F.col("s_acctbal"), "s_nationkey"), 8).alias("share"))


@query("SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS kinds FROM events")
def count_distinct_over(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", groups.count_distinct_over(F.col("event_type"), w).cast("long").alias("kinds"))


@query("SELECT o_custkey, yr, n, CAST(rank() OVER (PARTITION BY yr ORDER BY n DESC) AS BIGINT) AS rk FROM (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n FROM orders GROUP BY 1, 2)")
def window_over_groups(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n"))
    return per.withColumn("rk", F.rank().over(Window.partitionBy("yr").orderBy(F.desc("n"))).cast("long"))


# --- order, sets, recursion ------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25 OFFSET 10")
def order_limit_offset(t: Tables) -> DataFrame:
    return rows.limit(rows.order_by(t.customer, ("c_acctbal", "desc"), "c_custkey"), 25, 10).select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return sets.union(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL BY NAME SELECT s_acctbal AS bal, s_suppkey AS id FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("double").alias("bal"))
    return sets.union_by_name(a, t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id")), all=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables) -> DataFrame:
    return sets.intersect(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def minus(t: Tables) -> DataFrame:
    return sets.minus(t.nation.select(F.col("n_nationkey").alias("k")), t.supplier.filter("s_acctbal > 5000").select("s_nationkey"))


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT per.* FROM per WHERE n > 1")
def cte(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 150000")
    return big.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")


def _edges(t: Tables) -> DataFrame:
    a = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    b = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return a.unionAll(b).unionAll(c)


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
h AS (SELECT id, 1 AS level, '/' || id AS path, id AS root_id FROM e WHERE parent IS NULL UNION ALL SELECT e.id, h.level + 1, h.path || '/' || e.id, h.root_id FROM e JOIN h ON e.parent = h.id)
SELECT id, CAST(level AS BIGINT) AS level, path, root_id FROM h""")
def connect_by(t: Tables) -> DataFrame:
    out = sets.connect_by(_edges(t), F.col("parent").isNull(), "id", "parent", {"path": "id"}, roots=["id"])
    return out.select("id", F.col("level").cast("long").alias("level"), "path", "root_id")


_RISE = """
WITH s AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS up FROM events),
g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM s)
SELECT user_id, min(event_id) FILTER (WHERE k = 1) AS first_event, count(*) - 1 AS rises FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY rn) AS k FROM g) GROUP BY user_id, run HAVING count(*) >= 4
"""


@query(_RISE)
def match_recognize(t: Tables) -> DataFrame:
    """Runs of at least three rises in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = patterns.match_recognize(
        t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "S UP{3,}", {"UP": F.col("value") > F.lag("value").over(w)},
        {"first_event": ("first", "S", "event_id"), "rises": ("count", "UP", "event_id")},
    )
    return out


@query()
def sample_rows(t: Tables) -> DataFrame:
    return rows.sample_rows(t.orders, 100, seed=5).select("o_orderkey")


@query()
def sample_percent(t: Tables) -> DataFrame:
    return rows.sample_fraction(t.lineitem, 10, seed=5).select("l_orderkey", "l_linenumber")


# --- table functions and policies ------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(i AS INT) AS INDEX, string_split(p_name, ' ')[i] AS VALUE FROM part, range(1, 20) r(i) WHERE i <= len(string_split(p_name, ' '))")
def split_to_table(t: Tables) -> DataFrame:
    return tables.split_to_table(t.part, "p_name", " ", "p_partkey").select("p_partkey", "INDEX", "VALUE")


@query("SELECT event_id, j.key AS KEY, CAST(j.value AS BIGINT) AS v FROM events, json_each(props) j")
def flatten_variant(t: Tables) -> DataFrame:
    out = tables.flatten(t.events.select("event_id", F.parse_json("props").alias("p")), "p")
    return out.select("event_id", "KEY", F.col("VALUE").cast("bigint").alias("v"))


@query("SELECT vec_id, CAST(i - 1 AS INT) AS INDEX, e AS VALUE FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def flatten_array(t: Tables) -> DataFrame:
    return tables.flatten(t.embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", "INDEX", "VALUE")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey < 5")
def row_access_and_masking(t: Tables) -> DataFrame:
    seen = policies.row_access(t.customer, F.col("c_nationkey") < 5)
    return policies.masked(seen, {"c_acctbal": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))}).select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 50")
def aggregation_policy(t: Tables) -> DataFrame:
    return policies.aggregated(t.customer, ["c_nationkey"], {"n": F.count("*")}, 50)


@query("SELECT 'o_custkey' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE o_custkey IS NULL) AS null_count, 0::BIGINT AS blank_count FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (WHERE o_orderstatus IS NULL), count(*) FILTER (WHERE trim(o_orderstatus) = '') FROM orders")
def data_metrics(t: Tables) -> DataFrame:
    return policies.metrics(t.orders, ["o_custkey", "o_orderstatus"]).select("column_name", "row_count", "null_count", "blank_count")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return policies.duplicates(t.lineitem, ["l_orderkey"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def time_windows(t: Tables) -> DataFrame:
    from ..streaming.tasks import windowed_counts

    return windowed_counts(t.events, "ts", ["event_type"], "1 hour").drop("window_end")
