"""Date and time functions. Weeks start on Monday; DAYOFWEEK counts from Sunday = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnOrName, col, function, lit, must

#: Spellings of units (fixed values of the dialect).
UNITS = {
    "year": "y yy yyy yyyy yr years yrs", "quarter": "q qtr qtrs quarters", "month": "mm mon mons months", "week": "w wk weekofyear woy wy weeks",
    "day": "d dd days dayofmonth", "hour": "h hh hr hours hrs", "minute": "m mi min minutes mins", "second": "s sec seconds secs",
    "millisecond": "ms msec milliseconds", "microsecond": "us usec microseconds", "nanosecond": "ns nsec nanosec nsecond nanoseconds nanosecs nseconds",
}
_UNIT = {alias: unit for unit, names in UNITS.items() for alias in (unit, *names.split())}
_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}


def unit(name: str) -> str:
    try:
        return _UNIT[name.lower()]
    except KeyError:
        raise ValueError(f"{name} is no date or time part") from None


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


@function()
def add_months(d: ColumnOrName, n: int | Column) -> Column:
    """The last day of a month stays the last day."""
    d = col(d)
    moved = F.add_months(d, lit(n))
    return F.when(d.cast("date") == F.last_day(d), F.last_day(moved)).otherwise(moved)


@function()
def convert_timezone(*args: str | ColumnOrName) -> Column:
    """(source, target, timestamp without zone), or (target, timestamp)."""
    if len(args) == 3:
        return F.convert_timezone(lit(args[0]), lit(args[1]), col(args[2]).cast("timestamp_ntz"))
    return F.convert_timezone(F.current_timezone(), lit(args[0]), col(args[1]).cast("timestamp_ntz"))


@function("DATEADD", "TIMESTAMPADD", "TIMEADD")
def dateadd(part: str, n: int | Column, value: ColumnOrName, is_date: bool = False) -> Column:
    """With ``is_date`` days and longer units keep a date."""
    u, v, n = unit(part), col(value), lit(n)
    if is_date and u in ("year", "quarter", "month"):
        return F.add_months(v, n * {"year": 12, "quarter": 3, "month": 1}[u])
    if is_date and u in ("week", "day"):
        return F.date_add(v, (n * (7 if u == "week" else 1)).cast("int"))
    if u == "nanosecond":
        return F.timestamp_add("MICROSECOND", F.floor(n / 1000).cast("int"), v)
    return F.timestamp_add(u.upper(), n.cast("int"), v)


@function("DATEDIFF", "TIMESTAMPDIFF", "TIMEDIFF")
def datediff(part: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Boundaries of the unit between both, not whole units elapsed."""
    u, a, b = unit(part), col(start), col(end)
    if u == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if u == "quarter":
        return ((F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)).cast("long")
    if u == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")
    if u == "week":
        return (F.datediff(F.trunc(b, "week"), F.trunc(a, "week")) / 7).cast("long")
    if u == "day":
        return F.datediff(b.cast("date"), a.cast("date")).cast("long")
    if u == "nanosecond":
        return (_micros(b) - _micros(a)) * 1000
    size = _MICROS[u]
    return F.floor(_micros(b) / size).cast("long") - F.floor(_micros(a) / size).cast("long") if size > 1 else _micros(b) - _micros(a)


@function("DATE_FROM_PARTS", "DATEFROMPARTS")
def date_from_parts(y: ColumnOrName, m: ColumnOrName, d: ColumnOrName) -> Column:
    """Months and days beyond their range carry over."""
    return F.date_add(F.add_months(F.make_date(col(y), F.lit(1), F.lit(1)), (col(m) - 1).cast("int")), (col(d) - 1).cast("int"))


@function("DATE_PART", "EXTRACT")
def date_part(part: str, value: ColumnOrName) -> Column:
    p, v = part.lower(), col(value)
    epochs = {"epoch_second": 1_000_000, "epoch": 1_000_000, "epoch_millisecond": 1_000, "epoch_microsecond": 1}
    if p in epochs:
        return F.floor(_micros(v) / epochs[p]).cast("long")
    if p == "epoch_nanosecond":
        return _micros(v) * 1000
    own = {
        "dayofweek": dayofweek, "dow": dayofweek, "dw": dayofweek, "weekday": dayofweek, "dayofweekiso": dayofweekiso, "dow_iso": dayofweekiso,
        "dayofyear": dayofyear, "doy": dayofyear, "yearday": dayofyear, "weekiso": week, "week_iso": week, "yearofweek": yearofweek, "yearofweekiso": yearofweek,
    }
    if p in own:
        return own[p](v)
    by = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    u = unit(p)
    if u == "nanosecond":
        return (F.pmod(_micros(v), F.lit(1_000_000)) * 1000).cast("long")
    return by[u](v)


@function()
def date_trunc(part: str, value: ColumnOrName, is_date: bool = False) -> Column:
    out = F.date_trunc(unit(part), col(value))
    return out.cast("date") if is_date else out


def _simple(name: str, f):
    def build(value: ColumnOrName) -> Column:
        return f(col(value))

    build.__name__ = name
    return build


year = function("YEAR")(_simple("year", F.year))
quarter = function("QUARTER")(_simple("quarter", F.quarter))
month = function("MONTH")(_simple("month", F.month))
week = function("WEEK", "WEEKISO", "WEEKOFYEAR")(_simple("week", F.weekofyear))
day = function("DAY", "DAYOFMONTH")(_simple("day", F.dayofmonth))
hour = function("HOUR")(_simple("hour", F.hour))
minute = function("MINUTE")(_simple("minute", F.minute))
second = function("SECOND")(_simple("second", F.second))
dayname = function("DAYNAME")(_simple("dayname", F.dayname))
monthname = function("MONTHNAME")(_simple("monthname", F.monthname))
dayofyear = function("DAYOFYEAR")(_simple("dayofyear", F.dayofyear))
dayofweek = function("DAYOFWEEK")(_simple("dayofweek", lambda d: F.dayofweek(d) - 1))
dayofweekiso = function("DAYOFWEEKISO")(_simple("dayofweekiso", lambda d: F.weekday(d) + 1))
yearofweek = function("YEAROFWEEK", "YEAROFWEEKISO")(_simple("yearofweek", lambda d: F.extract(F.lit("YEAROFWEEK"), d)))


@function("GETDATE", "SYSTIMESTAMP", "NOW", "CURRENT_TIMESTAMP")
def getdate() -> Column:
    return F.current_timestamp()


@function("LOCALTIMESTAMP")
def localtimestamp() -> Column:
    return F.localtimestamp()


@function("SYSDATE")
def sysdate() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


@function("CURRENT_DATE")
def current_date() -> Column:
    return F.current_date()


@function("CURRENT_TIME", "LOCALTIME")
def current_time() -> Column:
    """Nanoseconds of the day."""
    return time_of(F.localtimestamp())


def time_of(ts: ColumnOrName) -> Column:
    """The carrier of TIME: nanoseconds of the day."""
    t = col(ts)
    return (F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000)) * 1000).cast("long")


@function()
def last_day(d: ColumnOrName, part: str = "month") -> Column:
    d, u = col(d).cast("date"), unit(part)
    if u == "month":
        return F.last_day(d)
    if u == "week":
        return F.date_add(F.trunc(d, "week"), 6)
    months = {"quarter": 3, "year": 12}[u]
    return F.date_sub(F.add_months(F.trunc(d, u), months), 1)


@function()
def months_between(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.months_between(col(a), col(b), False).cast("decimal(27,6)")


@function()
def next_day(d: ColumnOrName, weekday: str) -> Column:
    return F.next_day(col(d), weekday[:2])


@function()
def previous_day(d: ColumnOrName, weekday: str) -> Column:
    return F.date_sub(F.next_day(F.date_sub(col(d), 1), weekday[:2]), 7)


@function("TIME_FROM_PARTS", "TIMEFROMPARTS")
def time_from_parts(h: ColumnOrName, m: ColumnOrName, s: ColumnOrName, ns: ColumnOrName | int = 0) -> Column:
    """Nanoseconds of the day; parts beyond their range carry over and wrap at midnight."""
    total = ((col(h).cast("long") * 60 + col(m)) * 60 + col(s)) * 1_000_000_000 + lit(ns)
    return F.pmod(total.cast("long"), F.lit(86_400_000_000_000))


@function()
def time_slice(t: ColumnOrName, n: int, part: str, side: str = "START") -> Column:
    """The start or end of the bucket of ``n`` units, counted from 1970-01-01, that holds ``t``."""
    t, u = col(t), unit(part)
    end = n if side.upper() == "END" else 0
    if u in ("year", "quarter", "month"):
        size = n * {"year": 12, "quarter": 3, "month": 1}[u]
        months = (F.year(t) - 1970) * 12 + F.month(t) - 1
        first = F.floor(months / size) * size + (size if end else 0)
        return F.add_months(F.lit("1970-01-01").cast("date"), first.cast("int")).cast("timestamp")
    if u in ("week", "day"):
        size = n * (7 if u == "week" else 1)
        # weeks are counted from Monday, 1969-12-29
        shift = 3 if u == "week" else 0
        days = F.floor((F.unix_date(t.cast("date")) + shift) / size) * size - shift + (size if end else 0)
        return F.date_from_unix_date(days.cast("int")).cast("timestamp")
    size = n * _MICROS[u]
    return F.timestamp_micros((F.floor(_micros(t) / size) * size + (size if end else 0)).cast("long"))


def _timestamp_parts(parts: tuple, made) -> Column:
    if len(parts) == 2:  # a date and a time of day
        d, ns = map(col, parts)
        return made(F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + F.floor(ns / 1000).cast("long")))
    y, mo, d, h, mi, s = (col(p) for p in parts[:6])
    ns = col(parts[6]) if len(parts) > 6 else F.lit(0)
    seconds = (h.cast("long") * 60 + mi) * 60 + s
    days = F.unix_date(date_from_parts(y, mo, d))
    return made(F.timestamp_micros(days.cast("long") * 86_400_000_000 + seconds * 1_000_000 + F.floor(ns / 1000).cast("long")))


@function("TIMESTAMP_NTZ_FROM_PARTS", "TIMESTAMP_FROM_PARTS", "TIMESTAMPNTZFROMPARTS")
def timestamp_ntz_from_parts(*parts: ColumnOrName) -> Column:
    return _timestamp_parts(parts, lambda x: F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.cast("timestamp_ntz")))


@function("TIMESTAMP_LTZ_FROM_PARTS", "TIMESTAMPLTZFROMPARTS")
def timestamp_ltz_from_parts(*parts: ColumnOrName) -> Column:
    return timestamp_ntz_from_parts(*parts).cast("timestamp")


@function("TIMESTAMP_TZ_FROM_PARTS", "TIMESTAMPTZFROMPARTS")
def timestamp_tz_from_parts(*parts: ColumnOrName, zone: str = "UTC") -> Column:
    """The instant and its offset in minutes."""
    local = timestamp_ntz_from_parts(*parts)
    instant = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    offset = (F.unix_micros(local.cast("timestamp")) - F.unix_micros(instant.cast("timestamp"))) / 60_000_000
    return F.struct(instant.alias("ts"), offset.cast("int").alias("offset_min"))


def check_unit_of(part: str, allowed: set[str]) -> str:
    u = unit(part)
    if u not in allowed:
        raise ValueError(f"{part} isn't allowed here")
    return u


def date_of_range(d: ColumnOrName) -> Column:
    """A date within years 0001 to 9999, or an error."""
    d = col(d)
    return must(F.year(d).between(1, 9999), d, "date out of range")
