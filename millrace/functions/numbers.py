"""Mathematical functions. Arguments outside of a function's domain raise, as in the dialect."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import REGISTRY, ColumnOrName, col, function, lit, must

for _names, _f in (
    (("ABS",), F.abs), (("ASINH",), F.asinh), (("ATAN",), F.atan), (("BITCOUNT",), F.bit_count), (("BITNOT",), F.bitwise_not),
    (("CBRT",), F.cbrt), (("COS",), F.cos), (("COSH",), F.cosh), (("COT",), F.cot), (("DEGREES",), F.degrees), (("EXP",), F.exp),
    (("FACTORIAL",), F.factorial), (("NEGATE",), F.negative), (("RADIANS",), F.radians), (("SIN",), F.sin), (("SINH",), F.sinh),
    (("TAN",), F.tan), (("TANH",), F.tanh),
):

    def _single(x: ColumnOrName, _f=_f) -> Column:
        return _f(col(x))

    for _n in _names:
        globals()[_n.lower()] = REGISTRY[_n] = _single


def _guarded(name: str, f, ok, message: str):
    def build(x: ColumnOrName) -> Column:
        x = col(x).cast("double")
        return must(ok(x), f(x), f"{name}: {message}")

    return function(name)(build)


acos = _guarded("ACOS", F.acos, lambda x: x.between(-1, 1), "argument outside of [-1, 1]")
asin = _guarded("ASIN", F.asin, lambda x: x.between(-1, 1), "argument outside of [-1, 1]")
acosh = _guarded("ACOSH", F.acosh, lambda x: x >= 1, "argument below 1")
atanh = _guarded("ATANH", F.atanh, lambda x: (x > -1) & (x < 1), "argument outside of (-1, 1)")
ln = _guarded("LN", F.ln, lambda x: x > 0, "argument isn't positive")
sqrt = _guarded("SQRT", F.sqrt, lambda x: x >= 0, "negative argument")


@function()
def log(base: ColumnOrName | float, x: ColumnOrName) -> Column:
    b, x = col(base).cast("double"), col(x).cast("double")
    return must((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b), "LOG: argument or base outside of the domain")


@function()
def atan2(y: ColumnOrName, x: ColumnOrName) -> Column:
    return F.atan2(col(y), col(x))


@function("BITSHIFTLEFT")
def bitshiftleft(x: ColumnOrName, n: int) -> Column:
    return F.shiftleft(col(x), n)


@function("BITSHIFTRIGHT")
def bitshiftright(x: ColumnOrName, n: int) -> Column:
    return F.shiftright(col(x), n)


@function("BITAND")
def bitand(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a).bitwiseAND(col(b))


@function("BITOR")
def bitor(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a).bitwiseOR(col(b))


@function("BITXOR")
def bitxor(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a).bitwiseXOR(col(b))


@function("GETBIT")
def getbit(x: ColumnOrName, n: int | Column) -> Column:
    return F.getbit(col(x), lit(n))


@function()
def ceil(x: ColumnOrName, scale: int | None = None) -> Column:
    return F.ceil(col(x)) if scale is None else F.ceil(col(x), F.lit(scale))


@function()
def floor(x: ColumnOrName, scale: int | None = None) -> Column:
    return F.floor(col(x)) if scale is None else F.floor(col(x), F.lit(scale))


@function("DIV0")
def div0(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 where the divisor is 0; null stays null."""
    a, b = col(a), col(b)
    return F.when((b == 0) & a.isNotNull(), F.lit(0)).otherwise(F.try_divide(a, b))


@function("DIV0NULL")
def div0null(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 where the divisor is 0 or null."""
    a, b = col(a), col(b)
    return F.when(((b == 0) | b.isNull()) & a.isNotNull(), F.lit(0)).otherwise(F.try_divide(a, b))


@function()
def divide(a: ColumnOrName, b: ColumnOrName, scale: int) -> Column:
    """Exact division: ``scale`` is the dividend's, the result has six digits more, rounded half up."""
    return (col(a).cast(f"decimal(38,{scale})") / col(b).cast("decimal(20,6)")).cast(f"decimal(38,{scale + 6})")


@function()
def haversine(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Kilometres along the sphere."""
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


@function()
def mod(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Sign of the dividend."""
    return col(a) % col(b)


@function()
def normal(mean: float, deviation: float, seed: int | None = None) -> Column:
    return F.randn(seed) * deviation + mean


@function()
def pi() -> Column:
    return F.pi()


@function("POWER", "POW")
def power(b: ColumnOrName, e: ColumnOrName | float) -> Column:
    return F.pow(col(b), col(e))


@function()
def random(seed: int | None = None) -> Column:
    """Signed 64-bit integers."""
    return ((F.rand(seed) - 0.5) * 2.0**64).cast("long")


@function()
def round(x: ColumnOrName, scale: int = 0, mode: str = "HALF_AWAY_FROM_ZERO") -> Column:
    return (F.bround if mode.upper() == "HALF_TO_EVEN" else F.round)(col(x), scale)


@function()
def sign(x: ColumnOrName) -> Column:
    return F.signum(col(x))


@function()
def square(x: ColumnOrName) -> Column:
    return col(x) * col(x)


@function("TRUNC", "TRUNCATE")
def trunc(x: ColumnOrName, scale: int | str = 0) -> Column:
    """Towards zero at a scale; with a date part, the beginning of that part."""
    if isinstance(scale, str):
        from .dates import unit

        return F.trunc(col(x), unit(scale))
    p = float(10**scale) if scale >= 0 else 10.0**scale
    return F.signum(col(x)) * F.floor(F.abs(col(x)) * p) / p


@function()
def uniform(low: float, high: float, seed: int | None = None) -> Column:
    """Both bounds are possible if they are integers."""
    if isinstance(low, int) and isinstance(high, int):
        return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")
    return F.rand(seed) * (high - low) + low


@function()
def width_bucket(x: ColumnOrName, low: float, high: float, n: int) -> Column:
    return F.width_bucket(col(x), F.lit(float(low)), F.lit(float(high)), F.lit(n))


@function()
def zipf(s: float, n: int, seed: int | None = None) -> Column:
    """Draws 1 to ``n`` with weights 1 / k ** s: the place of a uniform draw in the cumulative weights."""
    weights = [k**-s for k in range(1, n + 1)]
    total, sums = math.fsum(weights), []
    for w in weights:
        sums.append((sums[-1] if sums else 0.0) + w / total)
    u = F.transform(F.array(F.rand(seed)), lambda r: F.size(F.filter(F.array(*map(F.lit, sums[:-1])), lambda c: c < r)) + 1)
    return F.element_at(u, 1)
