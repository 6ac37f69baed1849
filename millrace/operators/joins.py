"""Joins that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is sent to all executors only if its measured size, in estimated bytes, is below this.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 200, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most // row_bytes + 1).count() <= most // row_bytes else df


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: equal names are keys and appear once, before the rest."""
    low = {c.lower() for c in right.columns}
    keys = [c for c in left.columns if c.lower() in low]
    return left.join(right, keys, how) if keys else left.join(right, F.lit(True), how)


def plus_outer(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """The legacy ``(+)`` on the right side's columns: a left outer join."""
    return left.join(right, on, "left")


def lateral(df: DataFrame, items: Column, name: str, outer: bool = False) -> DataFrame:
    """LATERAL over an array expression of each row; ``outer`` keeps rows without items."""
    return df.select("*", (F.explode_outer if outer else F.explode)(items).alias(name))


_OPS = {">=": (False, True), ">": (False, False), "<=": (True, True), "<": (True, False)}


def asof(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    op: str = ">=",
    on: Sequence[str] = (),
    bucket_seconds: int = 86_400,
    prefix: str = "",
) -> DataFrame:
    """ASOF JOIN ... MATCH_CONDITION (left.ts op right.ts): the closest fitting right row, or nulls.

    Both sides are dealt by key *and* time bucket, so that a key with a third of all rows spreads over as many
    tasks as it has buckets. Within a bucket one sorted pass fills in the last right row; where a bucket has
    none yet, the last of the buckets before comes from a table with one row for each key and bucket. Of right
    rows with equal times the one with the greatest other columns is taken. Rows with a null time match nothing.
    Right columns get ``prefix``; keys appear once.
    """
    forward, inclusive = _OPS[op]
    keys, flip = list(on), -1 if forward else 1
    payload = [c for c in right.columns if c not in keys]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * flip
    size = bucket_seconds * 1_000_000
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, micros(right_ts).alias("_t"), F.struct(*(F.col(c).alias(f"p{i}") for i, c in enumerate(payload))).alias("_p")
    )
    r = r.groupBy(*keys, "_t").agg(F.max("_p").alias("_p")).withColumn("_b", F.floor(F.col("_t") / size))
    tagged = left.withColumn("_row", F.struct(*left.columns)).select(*keys, micros(left_ts).alias("_t"), "_row")
    tagged = tagged.withColumn("_b", F.floor(F.col("_t") / size))
    # at equal times a right row stands before the left ones where equality fits, else behind
    both = tagged.select(*keys, "_b", "_t", F.lit(1 if inclusive else 0).alias("_o"), "_row", F.lit(None).cast(r.schema["_p"].dataType).alias("_p")).unionAll(
        r.select(*keys, "_b", "_t", F.lit(0 if inclusive else 1).alias("_o"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), "_p")
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_m", F.last("_p", ignorenulls=True).over(w)).filter(F.col("_row").isNotNull())
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_e"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_cb"), F.last("_e", ignorenulls=True).over(before).alias("_c"))
    same = F.col("_b") == F.col("_cb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = filled.join(carried, same, "left").withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce("_m", "_c")))
    return out.select("_row.*", *(F.col(f"_m.p{i}").alias(prefix + c) for i, c in enumerate(payload)))


def interval_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``start <= point < end``: points and intervals are dealt to buckets of ``width``, and only
    pairs of one bucket are compared. Choose a width near a typical interval's length."""
    lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    spread = right.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    placed = left.withColumn("_b", F.floor(F.col(point) / width).cast("long"))
    found = placed.join(spread, ["_b", *on]).filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    return found.drop("_b")


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """A join whose hot keys spread over ``salts`` tasks: left rows get a salt, right rows are dealt to all."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join is inner, left, semi or anti")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
