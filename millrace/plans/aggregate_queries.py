"""Queries of aggregate functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import REGISTRY
from ..functions import aggregates as A
from ..operators import groups
from .book import Book, Tables

BOOK = Book()
fn = REGISTRY


def r(f, n: int = 4):
    return lambda: F.round(f(), n)


BOOK.totals(
    "aggregates_basic", "lineitem", ["l_returnflag", "l_linestatus"],
    n=(lambda: A.count(), "count(*)"), s=(r(lambda: fn["SUM"]("l_quantity"), 2), "round(sum(l_quantity), 2)"), mn=(lambda: fn["MIN"]("l_shipdate"), "min(l_shipdate)"), mx=(lambda: fn["MAX"]("l_extendedprice"), "max(l_extendedprice)"), av=(r(lambda: A.avg("l_quantity")), "round(avg(l_quantity), 4)"),
    cd=(lambda: A.count_distinct("l_suppkey"), "count(DISTINCT l_suppkey)"), c2=(lambda: A.count_distinct("l_suppkey", "l_partkey"), "count(DISTINCT (l_suppkey, l_partkey))"), ci=(lambda: A.count_if(F.col("l_quantity") > 30), "count_if(l_quantity > 30)::BIGINT"),
    sd=(r(lambda: fn["STDDEV"]("l_quantity")), "round(stddev_samp(l_quantity), 4)"), sp=(r(lambda: fn["STDDEV_POP"]("l_quantity")), "round(stddev_pop(l_quantity), 4)"), vs=(r(lambda: fn["VARIANCE"]("l_quantity")), "round(var_samp(l_quantity), 4)"), vp=(r(lambda: fn["VAR_POP"]("l_quantity")), "round(var_pop(l_quantity), 4)"),
    ba=(lambda: A.bitand_agg("l_orderkey"), "bit_and(l_orderkey)"), bo=(lambda: A.bitor_agg("l_orderkey"), "bit_or(l_orderkey)"), bx=(lambda: A.bitxor_agg("l_orderkey"), "bit_xor(l_orderkey)"), la=(lambda: A.booland_agg(F.col("l_quantity") > 0), "bool_and(l_quantity > 0)"), lo=(lambda: A.boolor_agg(F.col("l_quantity") > 49), "bool_or(l_quantity > 49)"),
    lx=(lambda: A.boolxor_agg(F.col("l_orderkey") == 1), "count_if(l_orderkey = 1) = 1"),
)

BOOK.totals(
    "aggregates_statistics", "lineitem", ["l_returnflag"],
    co=(r(lambda: fn["CORR"]("l_extendedprice", "l_quantity"), 6), "round(corr(l_extendedprice, l_quantity), 6)"), cp=(r(lambda: fn["COVAR_POP"]("l_extendedprice", "l_quantity"), 1), "round(covar_pop(l_extendedprice, l_quantity), 1)"), cs=(r(lambda: fn["COVAR_SAMP"]("l_extendedprice", "l_quantity"), 1), "round(covar_samp(l_extendedprice, l_quantity), 1)"),
    ra=(r(lambda: fn["REGR_AVGX"]("l_extendedprice", "l_quantity")), "round(regr_avgx(l_extendedprice, l_quantity), 4)"), rb=(r(lambda: fn["REGR_AVGY"]("l_extendedprice", "l_quantity"), 2), "round(regr_avgy(l_extendedprice, l_quantity), 2)"), rc=(lambda: fn["REGR_COUNT"]("l_extendedprice", "l_quantity"), "regr_count(l_extendedprice, l_quantity)::BIGINT"),
    ri=(r(lambda: fn["REGR_INTERCEPT"]("l_extendedprice", "l_quantity"), 2), "round(regr_intercept(l_extendedprice, l_quantity), 2)"), rr=(r(lambda: fn["REGR_R2"]("l_extendedprice", "l_quantity"), 6), "round(regr_r2(l_extendedprice, l_quantity), 6)"), rs=(r(lambda: fn["REGR_SLOPE"]("l_extendedprice", "l_quantity"), 3), "round(regr_slope(l_extendedprice, l_quantity), 3)"),
    sx=(r(lambda: fn["REGR_SXX"]("l_extendedprice", "l_quantity"), 0), "round(regr_sxx(l_extendedprice, l_quantity), 0)"), ku=(r(lambda: A.kurtosis("l_extendedprice")), "round(kurtosis(l_extendedprice), 4)"), sk=(r(lambda: A.skew("l_extendedprice")), "round(skewness(l_extendedprice), 4)"),
)

BOOK.totals(
    "aggregate_percentiles", "customer", ["c_nationkey"],
    me=(r(lambda: A.median("c_acctbal")), "round(median(c_acctbal), 4)"), pc=(r(lambda: A.percentile_cont("c_acctbal", 0.9)), "round(quantile_cont(c_acctbal, 0.9), 4)"), pd=(lambda: A.percentile_disc("c_acctbal", 0.25), "quantile_disc(c_acctbal, 0.25)"),
)


@BOOK.query(
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS high, quantile_disc(l_extendedprice, 0.25) AS low "
    "FROM lineitem GROUP BY l_returnflag"
)
def percentiles_by_rank(t: Tables) -> DataFrame:
    """Three groups hold all rows: ranks are found range by range."""
    found = groups.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"middle": (0.5, "cont"), "high": (0.9, "cont"), "low": (0.25, "disc")})
    return found.select("l_returnflag", F.round("middle", 4).alias("middle"), F.round("high", 4).alias("high"), "low")


BOOK.totals(
    "aggregates_collections", "customer", ["c_nationkey"],
    la=(lambda: A.listagg("c_mktsegment", ",", distinct=True), "string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment)"), ls=(lambda: A.listagg("c_name", "|", order_by="c_custkey"), "string_agg(c_name, '|' ORDER BY c_custkey)"), ar=(lambda: F.array_join(A.array_agg("c_custkey", order_by="c_custkey", desc=True).cast("array<string>"), ","), "string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey DESC)"),
    uq=(lambda: F.array_join(A.array_unique_agg("c_mktsegment"), ","), "string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment)"), mb=(lambda: A.max_by("c_name", F.struct("c_acctbal", "c_custkey")), "arg_max(c_name, (c_acctbal, c_custkey))"), nb=(lambda: A.min_by("c_name", F.struct("c_acctbal", "c_custkey")), "arg_min(c_name, (c_acctbal, c_custkey))"),
    m3=(lambda: F.array_join(A.max_by("c_name", F.struct("c_acctbal", "c_custkey"), 3), ","), "array_to_string(arg_max(c_name, (c_acctbal, c_custkey), 3), ',')"), an=(lambda: A.any_value("c_nationkey"), "any_value(c_nationkey)"), oa=(lambda: F.size(A.object_agg(F.col("c_custkey").cast("string"), "c_name")).cast("long"), "count(*)"),
)


@BOOK.query("SELECT c_nationkey, min(c_mktsegment) AS m FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE k = 1 GROUP BY c_nationkey")
def aggregate_mode(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(A.mode("c_mktsegment").alias("m"))


@BOOK.query(
    "SELECT label, i - 1 AS dimension, round(sum(e::DOUBLE), 3) AS s, round(avg(e::DOUBLE), 4) AS a, min(e::DOUBLE) AS m, max(e::DOUBLE) AS x "
    "FROM (SELECT label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i"
)
def aggregate_vectors(t: Tables) -> DataFrame:
    v, n = F.col("embedding"), 64
    out = t.embeddings.groupBy("label").agg(A.vector_sum(v, n).alias("s"), A.vector_avg(v, n).alias("a"), A.vector_min(v, n).alias("m"), A.vector_max(v, n).alias("x"))
    by = out.select("label", F.posexplode(F.arrays_zip("s", "a", "m", "x")).alias("dimension", "v"))
    return by.select("label", F.col("dimension").cast("long").alias("dimension"), F.round("v.s", 3).alias("s"), F.round("v.a", 4).alias("a"), "v.m", "v.x")


@BOOK.query(
    "SELECT event_type, count(DISTINCT user_id) AS kept, count(DISTINCT user_id) AS direct, round(quantile_cont(value, 0.5), 6) AS middle FROM events GROUP BY event_type"
)
def aggregate_sketches(t: Tables) -> DataFrame:
    """An estimate within 10 percent of the exact value shows as that, any other as it is."""
    by = t.events.groupBy("event_type")
    exact = by.agg(F.count_distinct("user_id").alias("e"), F.percentile("value", 0.5).alias("m"))
    sketch = by.agg(A.hll_accumulate("user_id").alias("s"), A.approx_count_distinct("user_id").alias("a"), A.approx_percentile_accumulate("value").alias("k"))
    per = groups.beside(["event_type"], exact, sketch)
    near = lambda x, y: F.when(F.abs(x - y) <= 0.1 * F.abs(y) + 2, y).otherwise(x)
    return per.select(
        "event_type", near(A.hll_estimate("s"), F.col("e")).cast("long").alias("kept"), near(F.col("a"), F.col("e")).cast("long").alias("direct"),
        F.round(near(A.approx_percentile_estimate("k", 0.5), F.col("m")), 6).alias("middle"),
    )


@BOOK.query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2")
def aggregate_top_k(t: Tables) -> DataFrame:
    top = t.events.agg(A.approx_top_k("event_type", 2).alias("t"))
    return top.select(F.inline("t").alias("value", "n"))
