"""Conversions. TRY forms give null where the plain form raises."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnOrName, col, function, must
from .dates import time_of

#: Words that read as a boolean (fixed values of the dialect).
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
#: Elements of date and time formats with their Spark patterns (fixed values).
FORMAT_ELEMENTS = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MON": "MMM", "MM": "MM", "DD": "dd", "DY": "EEE", "HH24": "HH", "HH12": "hh",
    "AM": "a", "PM": "a", "MI": "mm", "SS": "ss", "FF9": "SSSSSSSSS", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSS",
    "TZH:TZM": "XXX", "TZHTZM": "XX", "TZH": "X", "HH": "HH",
}
_ELEMENT = re.compile("|".join(sorted(map(re.escape, FORMAT_ELEMENTS), key=len, reverse=True)) + r"|\"[^\"]*\"|[A-Za-z]+", re.I)
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def pattern(fmt: str) -> str:
    """A dialect format as a Spark date pattern."""

    def element(m: re.Match) -> str:
        e = m[0]
        if e.upper() in FORMAT_ELEMENTS:
            return FORMAT_ELEMENTS[e.upper()]
        return "'" + e.strip('"') + "'"

    return _ELEMENT.sub(element, fmt)


@function()
def binary_as_string(b: ColumnOrName) -> Column:
    return F.decode(col(b), "UTF-8")


@function()
def string_as_binary(s: ColumnOrName) -> Column:
    return F.encode(col(s), "UTF-8")


@function("CAST")
def cast(x: ColumnOrName, type_: str) -> Column:
    return col(x).cast(type_)


@function("TRY_CAST")
def try_cast(x: ColumnOrName, type_: str) -> Column:
    return col(x).try_cast(type_)


@function()
def to_binary(s: ColumnOrName, kind: str = "HEX") -> Column:
    return F.to_binary(col(s), F.lit(kind.lower()))


@function()
def try_to_binary(s: ColumnOrName, kind: str = "HEX") -> Column:
    return F.try_to_binary(col(s), F.lit(kind.lower()))


def _boolean(x: ColumnOrName) -> Column:
    word = F.lower(F.trim(col(x).cast("string")))
    number = word.try_cast("double")
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0)


@function()
def to_boolean(x: ColumnOrName) -> Column:
    b = _boolean(x)
    return must(col(x).isNull() | b.isNotNull(), b, "TO_BOOLEAN: not a boolean")


@function()
def try_to_boolean(x: ColumnOrName) -> Column:
    return _boolean(x)


@function("TO_CHAR", "TO_VARCHAR")
def to_char(x: ColumnOrName, fmt: str | None = None) -> Column:
    """Numbers by Spark's number model (9, 0, D, G, S, $), dates and times by date elements."""
    if fmt is None:
        return col(x).cast("string")
    if re.fullmatch(r"[SMIXBDG90.,$\-+ ]*", fmt, re.I) and re.search(r"[09]", fmt):
        return F.to_char(col(x), F.lit(fmt))
    return F.date_format(col(x), pattern(fmt))


to_varchar = to_char


@function("TO_DATE", "DATE")
def to_date(x: ColumnOrName, fmt: str | None = None) -> Column:
    return F.to_date(col(x)) if fmt is None else F.to_date(col(x), pattern(fmt))


@function()
def try_to_date(x: ColumnOrName, fmt: str | None = None) -> Column:
    return F.try_to_date(col(x)) if fmt is None else F.try_to_date(col(x), pattern(fmt))


@function("TO_NUMBER", "TO_DECIMAL", "TO_NUMERIC")
def to_number(x: ColumnOrName, p: int = 38, s: int = 0) -> Column:
    return col(x).cast(f"decimal({p},{s})")


@function("TRY_TO_NUMBER", "TRY_TO_DECIMAL", "TRY_TO_NUMERIC")
def try_to_number(x: ColumnOrName, p: int = 38, s: int = 0) -> Column:
    return F.trim(col(x).cast("string")).try_cast(f"decimal({p},{s})")


@function()
def to_decfloat(x: ColumnOrName) -> Column:
    """38 digits with 18 after the point: Spark has no decimal type with an exponent."""
    return col(x).cast("decimal(38,18)")


@function()
def try_to_decfloat(x: ColumnOrName) -> Column:
    return col(x).cast("string").try_cast("decimal(38,18)")


@function()
def to_double(x: ColumnOrName) -> Column:
    return col(x).cast("double")


@function()
def try_to_double(x: ColumnOrName) -> Column:
    return col(x).cast("string").try_cast("double")


def _time(x: ColumnOrName, fmt: str | None) -> Column:
    s = col(x).cast("string")
    if fmt is not None:
        return time_of(F.try_to_timestamp(s, F.lit(pattern(fmt))))
    m = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*$"
    part = lambda i: F.regexp_extract(s, m, i)
    h, mi, sec = (F.nullif(part(i), F.lit("")).cast("long") for i in (1, 2, 3))
    ns = F.coalesce(F.nullif(F.rpad(part(4), 9, "0"), F.lit("000000000")).cast("long"), F.lit(0))
    total = ((h * 60 + mi) * 60 + F.coalesce(sec, F.lit(0))) * 1_000_000_000 + ns
    return F.when((h < 24) & (mi < 60) & (F.coalesce(sec, F.lit(0)) < 60), total)


@function("TO_TIME", "TIME")
def to_time(x: ColumnOrName, fmt: str | None = None) -> Column:
    """Nanoseconds of the day."""
    t = _time(x, fmt)
    return must(col(x).isNull() | t.isNotNull(), t, "TO_TIME: not a time")


@function()
def try_to_time(x: ColumnOrName, fmt: str | None = None) -> Column:
    return _time(x, fmt)


def _epoch(n: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, by magnitude."""
    size = F.abs(n)
    return (
        F.when(size < 31_536_000_000, F.timestamp_seconds(n)).when(size < 31_536_000_000_000, F.timestamp_millis(n))
        .when(size < 31_536_000_000_000_000, F.timestamp_micros(n)).otherwise(F.timestamp_micros(F.floor(n / 1000).cast("long")))
    )


@function("TO_TIMESTAMP", "TO_TIMESTAMP_LTZ")
def to_timestamp(x: ColumnOrName, fmt: str | None = None, numeric: bool = False) -> Column:
    """``numeric``: x counts from the epoch in a unit told by its magnitude."""
    if numeric:
        return _epoch(col(x).cast("long"))
    return F.to_timestamp(col(x)) if fmt is None else F.to_timestamp(col(x), pattern(fmt))


@function("TO_TIMESTAMP_NTZ")
def to_timestamp_ntz(x: ColumnOrName, fmt: str | None = None, numeric: bool = False) -> Column:
    return to_timestamp(x, fmt, numeric).cast("timestamp_ntz")


@function("TO_TIMESTAMP_TZ")
def to_timestamp_tz(x: ColumnOrName, fmt: str | None = None) -> Column:
    """The instant and the offset in minutes that the text names (0 if none)."""
    s = col(x).cast("string")
    sign = F.when(F.regexp_extract(s, r"([+-])\d{2}:?\d{2}\s*$", 1) == "-", -1).otherwise(1)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, r"[+-](\d{2}):?(\d{2})\s*$", i), F.lit("")).cast("int"), F.lit(0))
    offset = F.when(s.rlike(r":\d{2}.*[+-]\d{2}:?\d{2}\s*$"), sign * (part(1) * 60 + part(2))).otherwise(0)
    return F.struct(to_timestamp(s, fmt).alias("ts"), offset.alias("offset_min"))


@function("TRY_TO_TIMESTAMP", "TRY_TO_TIMESTAMP_LTZ")
def try_to_timestamp(x: ColumnOrName, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(col(x)) if fmt is None else F.try_to_timestamp(col(x), F.lit(pattern(fmt)))


@function("TRY_TO_TIMESTAMP_NTZ")
def try_to_timestamp_ntz(x: ColumnOrName, fmt: str | None = None) -> Column:
    return try_to_timestamp(x, fmt).cast("timestamp_ntz")


@function("TRY_TO_TIMESTAMP_TZ")
def try_to_timestamp_tz(x: ColumnOrName, fmt: str | None = None) -> Column:
    return F.when(try_to_timestamp(x, fmt).isNotNull(), F.struct(try_to_timestamp(x, fmt).alias("ts"), F.lit(0).alias("offset_min")))


@function()
def try_to_uuid(s: ColumnOrName) -> Column:
    return F.when(F.rlike(F.trim(col(s)), F.lit(_UUID)), F.lower(F.trim(col(s))))


@function()
def to_uuid(s: ColumnOrName) -> Column:
    u = try_to_uuid(s)
    return must(col(s).isNull() | u.isNotNull(), u, "TO_UUID: not a UUID")
