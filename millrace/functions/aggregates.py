"""Aggregate functions; most are valid over windows too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import REGISTRY, ColumnOrName, col, function


def _all_set(xs: tuple) -> Column:
    ok = col(xs[0]).isNotNull()
    for x in xs[1:]:
        ok = ok & col(x).isNotNull()
    return ok


@function()
def any_value(x: ColumnOrName) -> Column:
    return F.any_value(col(x), ignoreNulls=True)


@function("COUNT")
def count(*xs: ColumnOrName) -> Column:
    """COUNT(*) without arguments; else rows in which no argument is null."""
    return F.count(F.lit(1)) if not xs else F.count(F.when(_all_set(xs), 1))


@function("COUNT_DISTINCT")
def count_distinct(*xs: ColumnOrName) -> Column:
    return F.count_distinct(*map(col, xs))


@function()
def count_if(p: ColumnOrName) -> Column:
    return F.count_if(col(p))


#: Standard error of 16,384 registers. Spark's own default has 512, an error of 0.05: some groups are off by more than 0.1.
RSD = 0.0087


@function("APPROX_COUNT_DISTINCT", "HLL")
def approx_count_distinct(*xs: ColumnOrName, rsd: float = RSD) -> Column:
    """Distinct tuples, rows with a null left out. A group holds its registers, 13 KB at the default; a larger ``rsd`` takes less.
    Beside an aggregate of distinct values Spark holds them for each such value, so make that one apart."""
    one = col(xs[0]) if len(xs) == 1 else F.when(_all_set(xs), F.struct(*map(col, xs)))
    return F.approx_count_distinct(one, rsd)


@function()
def approx_percentile(x: ColumnOrName, p: float, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(col(x), p, accuracy).cast("double")


@function()
def approx_percentile_accumulate(x: ColumnOrName) -> Column:
    return F.call_function("kll_sketch_agg_double", col(x).cast("double"))


@function()
def approx_percentile_combine(state: ColumnOrName) -> Column:
    return F.call_function("kll_merge_agg_double", col(state))


@function()
def approx_percentile_estimate(state: ColumnOrName, p: float) -> Column:
    """Null for a state without values."""
    known = F.call_function("kll_sketch_get_n_double", col(state)) > 0
    return F.when(known, F.call_function("kll_sketch_get_quantile_double", col(state), F.lit(float(p))))


def _pairs(top: Column, value: str) -> Column:
    return F.transform(top, lambda s: F.struct(s[value].alias("value"), s["count"].alias("count")))


@function()
def approx_top_k(x: ColumnOrName, k: int = 1, counters: int = 10_000) -> Column:
    return _pairs(F.call_function("approx_top_k", col(x), F.lit(k), F.lit(max(k, counters))), "item")


@function()
def approx_top_k_accumulate(x: ColumnOrName, counters: int = 10_000) -> Column:
    return F.call_function("approx_top_k_accumulate", col(x), F.lit(counters))


@function()
def approx_top_k_combine(state: ColumnOrName, counters: int = 10_000) -> Column:
    return F.call_function("approx_top_k_combine", col(state), F.lit(counters))


@function()
def approx_top_k_estimate(state: ColumnOrName, k: int = 1) -> Column:
    return _pairs(F.call_function("approx_top_k_estimate", col(state), F.lit(k)), "item")


@function()
def array_agg(x: ColumnOrName, distinct: bool = False, order_by: ColumnOrName | None = None, desc: bool = False) -> Column:
    """Non-null values, empty array without any; ordered by ``order_by`` within the group if given."""
    x = col(x)
    if order_by is not None:
        pairs = F.collect_list(F.when(x.isNotNull(), F.struct(col(order_by).alias("k"), x.alias("v"))))
        out = F.transform(F.sort_array(pairs, asc=not desc), lambda s: s["v"])
        return F.array_distinct(out) if distinct else out
    return F.array_sort(F.collect_set(x)) if distinct else F.collect_list(x)


@function()
def array_union_agg(a: ColumnOrName) -> Column:
    """Union of multisets: a value as often as in the array that has it most often."""
    a = col(a)
    numbered = F.transform(a, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y.eqNullSafe(x))).alias("n")))
    return F.transform(F.array_distinct(F.flatten(F.collect_set(numbered))), lambda p: p["x"])


@function()
def array_unique_agg(x: ColumnOrName) -> Column:
    return F.array_sort(F.collect_set(col(x)))


@function()
def avg(x: ColumnOrName, scale: int | None = None) -> Column:
    """For exact input give its scale: the result has six digits more, rounded half up."""
    if scale is None:
        return F.avg(col(x))
    return (F.sum(col(x)).cast(f"decimal(38,{min(scale + 7, 18)})") / F.count(col(x))).cast(f"decimal(38,{scale + 6})")


@function("BITAND_AGG")
def bitand_agg(x: ColumnOrName) -> Column:
    return F.bit_and(col(x))


@function("BITOR_AGG")
def bitor_agg(x: ColumnOrName) -> Column:
    return F.bit_or(col(x))


@function("BITXOR_AGG")
def bitxor_agg(x: ColumnOrName) -> Column:
    return F.bit_xor(col(x))


@function()
def booland_agg(x: ColumnOrName) -> Column:
    return F.bool_and(col(x).cast("boolean"))


@function()
def boolor_agg(x: ColumnOrName) -> Column:
    return F.bool_or(col(x).cast("boolean"))


@function()
def boolxor_agg(x: ColumnOrName) -> Column:
    """True if exactly one value is true; null without values."""
    b = col(x).cast("boolean")
    return F.when(F.count(b) > 0, F.count_if(b) == 1)


for _name in ("corr", "covar_pop", "covar_samp", "regr_avgx", "regr_avgy", "regr_count", "regr_intercept", "regr_r2", "regr_slope", "regr_sxx", "regr_sxy", "regr_syy"):

    def _pair(y: ColumnOrName, x: ColumnOrName, _f=getattr(F, _name)) -> Column:
        return _f(col(y), col(x))

    globals()[_name] = REGISTRY[_name.upper()] = _pair

for _names, _f in (
    (("MAX",), F.max), (("MIN",), F.min), (("STDDEV", "STDDEV_SAMP"), F.stddev_samp), (("STDDEV_POP",), F.stddev_pop),
    (("VAR_POP", "VARIANCE_POP"), F.var_pop), (("VAR_SAMP", "VARIANCE", "VARIANCE_SAMP"), F.var_samp), (("SUM",), F.sum),
):

    def _single(x: ColumnOrName, _f=_f) -> Column:
        return _f(col(x))

    for _n in _names:
        globals()[_n.lower() if _n not in ("MAX", "MIN", "SUM") else _n.lower() + "_"] = REGISTRY[_n] = _single


@function()
def hash_agg(*xs: ColumnOrName) -> Column:
    """An order-independent signed 64-bit hash of all rows."""
    return F.coalesce(F.bit_xor(F.xxhash64(*map(col, xs))), F.lit(0).cast("long"))


@function()
def hll_accumulate(x: ColumnOrName) -> Column:
    return F.hll_sketch_agg(col(x), F.lit(12))


@function()
def hll_combine(state: ColumnOrName) -> Column:
    return F.hll_union_agg(col(state))


@function()
def hll_estimate(state: ColumnOrName) -> Column:
    return F.hll_sketch_estimate(col(state))


@function()
def hll_export(state: ColumnOrName) -> Column:
    return F.to_json(F.struct(F.base64(col(state)).alias("sketch")))


@function()
def hll_import(exported: ColumnOrName) -> Column:
    return F.unbase64(F.get_json_object(col(exported), "$.sketch"))


@function()
def kurtosis(x: ColumnOrName) -> Column:
    """Bias-corrected sample excess kurtosis; null under four values."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 4, (n - 1) / F.when(n >= 4, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6))


@function()
def skew(x: ColumnOrName) -> Column:
    """Bias-corrected sample skewness; null under three values."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2) * F.skewness(col(x)))


@function()
def listagg(x: ColumnOrName, delimiter: str = "", distinct: bool = False, order_by: ColumnOrName | None = None, desc: bool = False) -> Column:
    """Empty string for an empty group."""
    return F.array_join(array_agg(col(x).cast("string"), distinct, order_by, desc), delimiter)


@function()
def max_by(value: ColumnOrName, key: ColumnOrName, n: int | None = None) -> Column:
    return _by(value, key, n, False)


@function()
def min_by(value: ColumnOrName, key: ColumnOrName, n: int | None = None) -> Column:
    return _by(value, key, n, True)


def _by(value: ColumnOrName, key: ColumnOrName, n: int | None, asc: bool) -> Column:
    v, k = col(value), col(key)
    if n is None:
        return (F.min_by if asc else F.max_by)(v, k)
    pairs = F.collect_list(F.when(k.isNotNull(), F.struct(k.alias("k"), v.alias("v"))))
    return F.transform(F.slice(F.sort_array(pairs, asc=asc), 1, n), lambda s: s["v"])


@function()
def median(x: ColumnOrName, scale: int | None = None) -> Column:
    out = F.median(col(x))
    return out if scale is None else out.cast(f"decimal(38,{scale + 3})")


@function()
def percentile_cont(x: ColumnOrName, p: float, scale: int | None = None) -> Column:
    out = F.percentile(col(x), p)
    return out if scale is None else out.cast(f"decimal(38,{scale + 3})")


@function()
def percentile_disc(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY {x})")


@function()
def mode(x: ColumnOrName) -> Column:
    """The most frequent value; of equally frequent ones the least, as rows have no order on a cluster."""
    return F.mode(col(x), True)


@function()
def object_agg(key: ColumnOrName, value: ColumnOrName) -> Column:
    """A map sorted by key; entries with a null key or value are left out."""
    k, v = col(key), col(value)
    pairs = F.collect_list(F.when(k.isNotNull() & v.isNotNull(), F.struct(k.alias("key"), v.alias("value"))))
    return F.map_from_entries(F.array_sort(pairs))


def _by_dimension(v: ColumnOrName, n: int, f) -> Column:
    return F.array(*(f(F.get(col(v), F.lit(i)).cast("double")) for i in range(n)))


@function()
def vector_sum(v: ColumnOrName, n: int) -> Column:
    """Sum by dimension of vectors of ``n`` dimensions: a partial aggregate on each task."""
    return _by_dimension(v, n, F.sum)


@function()
def vector_avg(v: ColumnOrName, n: int) -> Column:
    return _by_dimension(v, n, F.avg)


@function()
def vector_min(v: ColumnOrName, n: int) -> Column:
    return _by_dimension(v, n, F.min)


@function()
def vector_max(v: ColumnOrName, n: int) -> Column:
    return _by_dimension(v, n, F.max)


@function()
def grouping(x: ColumnOrName) -> Column:
    return F.grouping(col(x))


@function()
def grouping_id(*xs: ColumnOrName) -> Column:
    return F.grouping_id(*map(col, xs))


__all__ = [n for n in dir() if not n.startswith("_")]
