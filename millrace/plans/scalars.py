"""Queries of scalar functions, by family, over the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conditional as C
from ..functions import conversion as V
from ..functions import crypto as H
from ..functions import dates as D
from ..functions import geo as G
from ..functions import numbers as N
from ..functions import semistructured as S
from ..functions import strings as T
from ..functions import vectors as E
from .book import Book, Tables

BOOK = Book()


def r(f, n: int = 6):
    return lambda: F.round(f(), n)


def long(f):
    return lambda: f().cast("long")


BOOK.columns(
    "strings_basic", "part", ["p_partkey"],
    up=(lambda: T.upper("p_name"), "upper(p_name)"), low=(lambda: T.lower("p_brand"), "lower(p_brand)"), n=(long(lambda: T.length("p_name")), "CAST(length(p_name) AS BIGINT)"),
    l3=(lambda: T.left("p_name", 3), "left(p_name, 3)"), r3=(lambda: T.right("p_name", 3), "right(p_name, 3)"), rev=(lambda: T.reverse("p_name"), "reverse(p_name)"),
    lp=(lambda: T.lpad(F.col("p_size").cast("string"), 5, "0"), "lpad(CAST(p_size AS VARCHAR), 5, '0')"), rp=(lambda: T.rpad(F.col("p_size").cast("string"), 5, "*"), "rpad(CAST(p_size AS VARCHAR), 5, '*')"),
    rep=(lambda: T.repeat("p_brand", 2), "repeat(p_brand, 2)"), repl=(lambda: T.replace("p_brand", "Brand", "B"), "replace(p_brand, 'Brand', 'B')"), tr=(lambda: T.translate("p_name", "aeiou", "AEIOU"), "translate(p_name, 'aeiou', 'AEIOU')"),
    cc=(lambda: T.concat("p_brand", F.lit("/"), "p_size"), "p_brand || '/' || CAST(p_size AS VARCHAR)"), cw=(lambda: T.concat_ws("-", "p_brand", "p_type"), "p_brand || '-' || p_type"),
    sub=(lambda: T.substring("p_name", 3, 4), "substr(p_name, 3, 4)"), sub0=(lambda: T.substring("p_name", -4), "right(p_name, 4)"), sp=(lambda: T.space(3), "'   '"),
)

BOOK.columns(
    "strings_search", "part", ["p_partkey"],
    pos=(long(lambda: T.charindex("a", "p_name")), "CAST(instr(p_name, 'a') AS BIGINT)"), has=(lambda: T.contains("p_name", "an"), "contains(p_name, 'an')"), st=(lambda: T.startswith("p_type", "S"), "starts_with(p_type, 'S')"),
    en=(lambda: T.endswith("p_type", "L"), "suffix(p_type, 'L')"), lk=(lambda: T.like("p_name", "%a_%"), "p_name LIKE '%a_%'"), il=(lambda: T.ilike("p_name", "%A%"), "p_name ILIKE '%A%'"),
    p1=(lambda: T.split_part("p_name", " ", 1), "split_part(p_name, ' ', 1)"), p0=(lambda: T.split_part("p_name", " ", 0), "split_part(p_name, ' ', 1)"), p9=(lambda: T.split_part("p_name", " ", 9), "split_part(p_name, ' ', 9)"),
    pl=(lambda: T.split_part("p_name", " ", -1), "split_part(p_name, ' ', -1)"), ed=(long(lambda: T.editdistance("p_name", "p_type")), "CAST(levenshtein(p_name, p_type) AS BIGINT)"),
    asc=(long(lambda: T.ascii("p_name")), "CAST(ascii(p_name) AS BIGINT)"), ch=(lambda: T.chr_(F.col("p_size") + 64), "chr(p_size + 64)"), bl=(long(lambda: T.bit_length("p_name")), "CAST(bit_length(p_name) AS BIGINT)"),
    ol=(long(lambda: T.octet_length("p_name")), "CAST(strlen(p_name) AS BIGINT)"), tm=(lambda: T.trim(F.concat(F.lit("xx"), "p_brand", F.lit("x")), "x"), "trim('xx' || p_brand || 'x', 'x')"),
    lt=(lambda: T.ltrim(F.concat(F.lit("  "), "p_brand")), "ltrim('  ' || p_brand)"), rt=(long(lambda: T.rtrimmed_length(F.concat("p_brand", F.lit("  ")))), "CAST(length(p_brand) AS BIGINT)"),
    ic=(lambda: T.initcap(F.lit("foo-bar bAZ")), "'Foo-Bar Baz'"), ins=(lambda: T.insert("p_brand", 1, 5, "X"), "'X' || substr(p_brand, 6)"),
)

BOOK.columns(
    "strings_regexp", "part", ["p_partkey"],
    lk=(lambda: T.regexp_like("p_brand", "Brand#[1-3].*"), "regexp_full_match(p_brand, 'Brand#[1-3].*')"), part_=(lambda: T.regexp_like("p_brand", "Brand"), "regexp_full_match(p_brand, 'Brand')"),
    n=(long(lambda: T.regexp_count("p_name", "[aeiou]")), "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT)"), s=(lambda: T.regexp_substr("p_name", "[a-z]+", 1, 1), "nullif(regexp_extract(p_name, '[a-z]+'), '')"),
    s2=(lambda: T.regexp_substr("p_name", "[a-z]+", 1, 2), "regexp_extract_all(p_name, '[a-z]+')[2]"), al=(lambda: F.array_join(T.regexp_substr_all("p_name", "[A-Za-z]+"), "|"), "array_to_string(regexp_extract_all(p_name, '[A-Za-z]+'), '|')"),
    rp=(lambda: T.regexp_replace("p_name", "([aeiou])", r"<\1>"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')"), r1=(lambda: T.regexp_replace("p_name", "[aeiou]", "_", 1, 1), "regexp_replace(p_name, '[aeiou]', '_')"),
    at=(long(lambda: T.regexp_instr("p_name", "[aeiou]")), "CAST(CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) + 1 ELSE 0 END AS BIGINT)"),
    tk=(lambda: F.array_join(T.strtok_to_array("p_type", " #"), "|"), "array_to_string(list_filter(regexp_split_to_array(p_type, '[ #]+'), lambda x: x <> ''), '|')"),
)

BOOK.columns(
    "numbers_basic", "lineitem", ["l_orderkey", "l_linenumber"],
    ab=(r(lambda: N.abs(F.col("l_quantity") - 25)), "round(abs(l_quantity - 25), 6)"), ce=(long(lambda: N.ceil("l_extendedprice")), "CAST(ceil(l_extendedprice) AS BIGINT)"), fl=(long(lambda: N.floor("l_extendedprice")), "CAST(floor(l_extendedprice) AS BIGINT)"),
    md=(r(lambda: N.mod("l_extendedprice", F.lit(7.0)), 4), "round(l_extendedprice % 7.0, 4)"), sg=(long(lambda: N.sign(F.col("l_quantity") - 25)), "CAST(sign(l_quantity - 25) AS BIGINT)"), sq=(r(lambda: N.sqrt("l_quantity")), "round(sqrt(l_quantity), 6)"),
    cb=(r(lambda: N.cbrt("l_quantity")), "round(cbrt(l_quantity), 6)"), ex=(r(lambda: N.exp("l_discount")), "round(exp(l_discount), 6)"), ln_=(r(lambda: N.ln("l_quantity")), "round(ln(l_quantity), 6)"), lg=(r(lambda: N.log(10, "l_quantity")), "round(log10(l_quantity), 6)"),
    pw=(r(lambda: N.power("l_quantity", 2)), "round(pow(l_quantity, 2), 6)"), s2=(r(lambda: N.square("l_quantity")), "round(l_quantity * l_quantity, 6)"), d0=(r(lambda: N.div0("l_quantity", F.col("l_linenumber") - 1)), "round(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity / (l_linenumber - 1) END, 6)"),
    wb=(long(lambda: N.width_bucket("l_quantity", 0, 50, 10)), "CAST(least(greatest(floor(l_quantity / 5), -1), 10) + 1 AS BIGINT)"), gb=(long(lambda: N.getbit("l_linenumber", 0)), "CAST(l_linenumber & 1 AS BIGINT)"),
    ba=(long(lambda: N.bitand("l_linenumber", F.lit(6))), "CAST(l_linenumber & 6 AS BIGINT)"), bo=(long(lambda: N.bitor("l_linenumber", F.lit(8))), "CAST(l_linenumber | 8 AS BIGINT)"), bx=(long(lambda: N.bitxor("l_linenumber", F.lit(5))), "CAST(xor(l_linenumber, 5) AS BIGINT)"),
    sl=(long(lambda: N.bitshiftleft("l_orderkey", 2)), "l_orderkey * 4"), sr=(long(lambda: N.bitshiftright("l_orderkey", 1)), "l_orderkey // 2"), bc=(long(lambda: N.bitcount("l_orderkey")), "CAST(bit_count(l_orderkey) AS BIGINT)"),
    tz=(r(lambda: N.trunc("l_extendedprice", 1), 4), "round(trunc(l_extendedprice * 10) / 10, 4)"), fa=(long(lambda: N.factorial("l_linenumber")), "CAST(factorial(l_linenumber) AS BIGINT)"),
)

BOOK.columns(
    "numbers_trigonometry", "lineitem", ["l_orderkey", "l_linenumber"],
    si=(r(lambda: N.sin("l_quantity")), "round(sin(l_quantity), 6)"), co=(r(lambda: N.cos("l_quantity")), "round(cos(l_quantity), 6)"), ta=(r(lambda: N.tan("l_discount")), "round(tan(l_discount), 6)"), ct=(r(lambda: N.cot("l_quantity"), 4), "round(cot(l_quantity), 4)"),
    sa=(r(lambda: N.asin("l_discount")), "round(asin(l_discount), 6)"), ca=(r(lambda: N.acos("l_discount")), "round(acos(l_discount), 6)"), at=(r(lambda: N.atan("l_quantity")), "round(atan(l_quantity), 6)"), a2=(r(lambda: N.atan2("l_quantity", "l_tax")), "round(atan2(l_quantity, l_tax), 6)"),
    sh=(r(lambda: N.sinh("l_discount")), "round(sinh(l_discount), 6)"), ch=(r(lambda: N.cosh("l_discount")), "round(cosh(l_discount), 6)"), th=(r(lambda: N.tanh("l_discount")), "round(tanh(l_discount), 6)"), ash=(r(lambda: N.asinh("l_quantity")), "round(asinh(l_quantity), 6)"),
    ach=(r(lambda: N.acosh("l_quantity")), "round(acosh(l_quantity), 6)"), ath=(r(lambda: N.atanh("l_discount")), "round(atanh(l_discount), 6)"), de=(r(lambda: N.degrees("l_discount")), "round(degrees(l_discount), 6)"), ra=(r(lambda: N.radians("l_quantity")), "round(radians(l_quantity), 6)"),
    pi=(r(N.pi), "round(pi(), 6)"), hv=(r(lambda: N.haversine("l_quantity", "l_tax", "l_discount", "l_quantity"), 3), "round(2 * 6371.0 * asin(sqrt(pow(sin(radians(l_discount - l_quantity) / 2), 2) + cos(radians(l_quantity)) * cos(radians(l_discount)) * pow(sin(radians(l_quantity - l_tax) / 2), 2))), 3)"),
)

_d = "o_orderdate"
BOOK.columns(
    "dates_parts", "orders", ["o_orderkey"],
    y=(long(lambda: D.year(_d)), "year(o_orderdate)"), q=(long(lambda: D.quarter(_d)), "quarter(o_orderdate)"), mo=(long(lambda: D.month(_d)), "month(o_orderdate)"), w=(long(lambda: D.week(_d)), "weekofyear(o_orderdate)"), d=(long(lambda: D.day(_d)), "day(o_orderdate)"),
    dw=(long(lambda: D.dayofweek(_d)), "dayofweek(o_orderdate)"), di=(long(lambda: D.dayofweekiso(_d)), "isodow(o_orderdate)"), dy=(long(lambda: D.dayofyear(_d)), "dayofyear(o_orderdate)"), h=(long(lambda: D.hour(_d)), "hour(o_orderdate)"), mi=(long(lambda: D.minute(_d)), "minute(o_orderdate)"),
    dn=(lambda: D.dayname(_d), "left(dayname(o_orderdate), 3)"), mn=(lambda: D.monthname(_d), "left(monthname(o_orderdate), 3)"), ep=(long(lambda: D.date_part("epoch_second", _d)), "CAST(epoch(o_orderdate) AS BIGINT)"), iy=(long(lambda: D.yearofweek(_d)), "isoyear(o_orderdate)"),
    tm=(lambda: D.date_trunc("month", _d).cast("date"), "CAST(date_trunc('month', o_orderdate) AS DATE)"), tw=(lambda: D.date_trunc("week", _d).cast("date"), "CAST(date_trunc('week', o_orderdate) AS DATE)"), ld=(lambda: D.last_day(_d), "last_day(o_orderdate)"),
    ly=(lambda: D.last_day(_d, "year"), "CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)"),
)

_b = "TIMESTAMP '1995-06-15 12:34:56'"


def _base():
    return F.lit("1995-06-15 12:34:56").cast("timestamp_ntz")


BOOK.columns(
    "dates_arithmetic", "orders", ["o_orderkey"],
    yy=(lambda: D.datediff("year", _base(), _d), f"datediff('year', {_b}, o_orderdate)"), qq=(lambda: D.datediff("quarter", _base(), _d), f"datediff('quarter', {_b}, o_orderdate)"), mm=(lambda: D.datediff("month", _base(), _d), f"datediff('month', {_b}, o_orderdate)"),
    ww=(lambda: D.datediff("week", _base(), _d), f"(CAST(date_trunc('week', o_orderdate) AS DATE) - CAST(date_trunc('week', {_b}) AS DATE)) // 7"), dd=(lambda: D.datediff("day", _base(), _d), f"datediff('day', {_b}, o_orderdate)"), hh=(lambda: D.datediff("hour", _base(), _d), f"datediff('hour', {_b}, o_orderdate)"),
    mi=(lambda: D.datediff("minute", _base(), _d), f"datediff('minute', {_b}, o_orderdate)"), ss=(lambda: D.datediff("second", _base(), _d), f"datediff('second', {_b}, o_orderdate)"),
    am=(lambda: D.dateadd("month", 3, F.col(_d).cast("date"), is_date=True), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE)"), ad=(lambda: D.dateadd("week", -2, F.col(_d).cast("date"), is_date=True), "CAST(CAST(o_orderdate AS DATE) - INTERVAL 14 DAY AS DATE)"),
    ah=(lambda: D.dateadd("hour", 30, _d), "o_orderdate + INTERVAL 30 HOUR"), me=(lambda: D.add_months(F.col(_d).cast("date"), 1), "CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) END"),
    fp=(lambda: D.date_from_parts(D.year(_d), F.lit(14), F.lit(-3)), "CAST(make_date(CAST(year(o_orderdate) AS INT) + 1, 2, 1) - INTERVAL 4 DAY AS DATE)"),
    ts=(lambda: D.time_slice(_d, 15, "minute").cast("timestamp_ntz"), "time_bucket(INTERVAL 15 MINUTE, o_orderdate, TIMESTAMP '1970-01-01')"), nx=(lambda: D.next_day(F.col(_d).cast("date"), "friday"), "CAST(CAST(o_orderdate AS DATE) + CAST((5 - isodow(o_orderdate) + 6) % 7 + 1 AS INT) AS DATE)"),
    pv=(lambda: D.previous_day(F.col(_d).cast("date"), "friday"), "CAST(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 5 + 6) % 7 + 1 AS INT) AS DATE)"),
)

BOOK.columns(
    "conditionals", "orders", ["o_orderkey"],
    iff=(lambda: C.iff(F.col("o_totalprice") > 100000, "big", "small"), "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"), dec=(lambda: C.decode("o_orderstatus", "F", "done", "O", "open", "other"), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END"),
    gn=(lambda: C.greatest("o_orderkey", "o_custkey", F.lit(None).cast("long")), "CAST(NULL AS BIGINT)"), gi=(lambda: C.greatest_ignore_nulls("o_orderkey", "o_custkey"), "greatest(o_orderkey, o_custkey)"), le=(lambda: C.least("o_orderkey", "o_custkey"), "least(o_orderkey, o_custkey)"),
    nv=(lambda: C.nvl(C.nullif("o_orderstatus", "P"), "none"), "coalesce(nullif(o_orderstatus, 'P'), 'none')"), n2=(lambda: C.nvl2(C.nullif("o_orderstatus", "P"), "set", "unset"), "CASE WHEN nullif(o_orderstatus, 'P') IS NOT NULL THEN 'set' ELSE 'unset' END"),
    en=(lambda: C.equal_null("o_orderstatus", F.lit(None)), "o_orderstatus IS NOT DISTINCT FROM NULL"), zn=(lambda: C.zeroifnull(C.nullifzero(F.col("o_orderkey") % 3)), "coalesce(nullif(o_orderkey % 3, 0), 0)"),
    bx=(lambda: C.boolxor(F.col("o_orderkey") % 2, F.col("o_custkey") % 2), "(o_orderkey % 2 <> 0) <> (o_custkey % 2 <> 0)"), ba=(lambda: C.booland(F.col("o_orderkey") % 2, F.col("o_custkey") % 2), "(o_orderkey % 2 <> 0) AND (o_custkey % 2 <> 0)"),
)

BOOK.columns(
    "conversions", "orders", ["o_orderkey"],
    tc=(lambda: V.to_char(_d, "YYYY-MM-DD HH24:MI:SS"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), td=(lambda: V.to_date(F.lit("03/15/2024"), "MM/DD/YYYY"), "DATE '2024-03-15'"), nn=(lambda: V.try_to_number(F.lit("abc")).cast("long"), "CAST(NULL AS BIGINT)"),
    n2=(lambda: V.to_number("o_totalprice", 20, 1).cast("double"), "round(CAST(o_totalprice AS DECIMAL(20, 4)), 1)::DOUBLE"), tb=(lambda: V.to_boolean(F.lit("yes")), "true"), bn=(lambda: V.try_to_boolean(F.lit("maybe")), "CAST(NULL AS BOOLEAN)"),
    dd=(lambda: V.try_to_double(F.lit("1.5e3")), "1500.0::DOUBLE"), te=(lambda: V.to_timestamp(F.lit(1700000000), numeric=True).cast("timestamp_ntz"), "TIMESTAMP '2023-11-14 22:13:20'"), tm=(lambda: V.to_time(F.lit("12:34:56.5")), "45296500000000::BIGINT"),
    tn=(lambda: V.try_to_date(F.lit("nope")), "CAST(NULL AS DATE)"), bs=(lambda: V.binary_as_string(V.string_as_binary("o_orderstatus")), "o_orderstatus"), uu=(lambda: V.try_to_uuid(F.lit("A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11")), "'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'"),
    hx=(lambda: F.hex(V.to_binary(F.lit("48656C6C6F"))), "'48656C6C6F'"),
)

_arr = "string_split(p_name, ' ')"


def _a():
    return F.split("p_name", " ")


BOOK.columns(
    "arrays", "part", ["p_partkey"],
    n=(long(lambda: S.array_size(_a())), f"CAST(len({_arr}) AS BIGINT)"), ap=(lambda: F.array_join(S.array_append(_a(), "z"), "|"), f"array_to_string(list_append({_arr}, 'z'), '|')"), pp=(lambda: F.array_join(S.array_prepend(_a(), "z"), "|"), f"array_to_string(list_prepend('z', {_arr}), '|')"),
    ct=(lambda: F.array_join(S.array_cat(_a(), _a()), "|"), f"array_to_string(list_concat({_arr}, {_arr}), '|')"), ps=(long(lambda: S.array_position(F.get(_a(), F.lit(1)), _a())), f"CAST(list_position({_arr}, {_arr}[2]) - 1 AS BIGINT)"), rv=(lambda: F.array_join(S.array_reverse(_a()), "|"), f"array_to_string(list_reverse({_arr}), '|')"),
    sl=(lambda: F.array_join(S.array_slice(_a(), 0, 1), "|"), f"{_arr}[1]"), so=(lambda: F.array_join(S.array_sort(_a()), "|"), f"array_to_string(list_sort({_arr}), '|')"), mx=(lambda: S.array_max(_a()), f"list_max({_arr})"), mi=(lambda: S.array_min(_a()), f"list_min({_arr})"),
    ts=(lambda: S.array_to_string(_a(), "+"), f"array_to_string({_arr}, '+')"), ov=(lambda: S.arrays_overlap(_a(), F.split("p_type", " ")), f"list_has_any({_arr}, string_split(p_type, ' '))"), ra=(lambda: F.array_join(S.array_remove_at(_a(), 0), "|"), f"coalesce(array_to_string({_arr}[2:], '|'), '')"),
    ge=(lambda: F.array_join(S.array_generate_range(0, F.col("p_size"), 10).cast("array<string>"), "|"), "coalesce(array_to_string(range(0, p_size, 10), '|'), '')"), ex=(lambda: F.array_join(S.array_except(F.array(*map(F.lit, [1, 1, 2])), F.array(F.lit(1))).cast("array<string>"), "|"), "'1|2'"),
    it=(lambda: F.array_join(S.array_intersection(F.array(*map(F.lit, [1, 1, 2, 3])), F.array(*map(F.lit, [1, 1, 3, 5]))).cast("array<string>"), "|"), "'1|1|3'"),
    hf=(lambda: S.reduce(S.transform(S.filter(F.sequence(F.lit(1), F.lit(10)), lambda x: x % 2 == 0), lambda x: x * x), 0, lambda a, x: a + x).cast("long"), "220::BIGINT"), fl=(lambda: F.array_join(S.array_flatten(F.array(_a(), _a())), "|"), f"array_to_string(flatten([{_arr}, {_arr}]), '|')"),
)

BOOK.columns(
    "variants", "events", ["event_id"],
    k=(lambda: S.get_path(S.parse_json("props"), "k", "bigint"), "CAST(json_extract(props, '$.k') AS BIGINT)"), ty=(lambda: S.typeof(S.parse_json("props")), "'OBJECT'"), ob=(lambda: S.is_object(S.parse_json("props")), "true"), ar=(lambda: S.is_array(S.parse_json("props")), "false"),
    ms=(lambda: S.get_path(S.parse_json("props"), "missing", "string"), "CAST(NULL AS VARCHAR)"), tx=(lambda: S.json_extract_path_text("props", "k"), "json_extract_string(props, '$.k')"), bad=(lambda: S.try_parse_json(F.lit("{oops")).isNull(), "true"), ck=(lambda: S.check_json("props").isNull(), "true"),
    nn=(lambda: S.is_null_value(S.parse_json(F.lit("null"))), "true"), it=(lambda: S.as_integer(S.get_path(S.parse_json("props"), "k")), "CAST(json_extract(props, '$.k') AS BIGINT)"), vc=(lambda: S.as_varchar(S.get_path(S.parse_json("props"), "k")), "CAST(NULL AS VARCHAR)"),
    oc=(lambda: S.get_path(S.object_construct("a", F.col("event_id"), "b", F.lit(None)), "a", "bigint"), "event_id"), jt=(lambda: S.to_json(S.object_construct("b", F.lit(2), "a", F.lit(1))), "'{\"a\":1,\"b\":2}'"),
)

BOOK.columns(
    "maps", "customer", ["c_custkey"],
    sz=(long(lambda: S.map_size(S.map_construct("a", F.col("c_custkey"), "b", F.lit(1).cast("long")))), "2::BIGINT"), ck=(lambda: S.map_contains_key("a", S.map_construct("a", F.col("c_custkey"))), "true"), ks=(lambda: F.array_join(S.map_keys(S.map_construct("b", 1, "a", 2)), "|"), "'a|b'"),
    ct=(long(lambda: F.element_at(S.map_cat(S.map_construct("a", 1), S.map_construct("a", 2)), F.lit("a"))), "2::BIGINT"), de=(long(lambda: S.map_size(S.map_delete(S.map_construct("a", 1, "b", 2), "a"))), "1::BIGINT"), pk=(long(lambda: S.map_size(S.map_pick(S.map_construct("a", 1, "b", 2), "a", "z"))), "1::BIGINT"),
    mi=(long(lambda: S.map_size(S.map_insert(S.map_construct("a", 1), "b", 2))), "2::BIGINT"), ic=(long(lambda: S.get_ignore_case(S.map_construct("Key", 7), "kEY")), "7::BIGINT"),
)

BOOK.columns(
    "hashes", "customer", ["c_custkey"],
    m=(lambda: H.md5("c_name"), "md5(c_name)"), s1=(lambda: H.sha1("c_name"), "sha1(c_name)"), s2=(lambda: H.sha2("c_name"), "sha256(c_name)"), b6=(lambda: H.base64_encode("c_name"), "base64(encode(c_name))"), bd=(lambda: H.base64_decode_string(H.base64_encode("c_name")), "c_name"),
    hx=(lambda: H.hex_encode("c_name"), "hex(c_name)"), hd=(lambda: H.hex_decode_string(H.hex_encode("c_name")), "c_name"), tb=(lambda: H.try_hex_decode_string(F.lit("zz")), "CAST(NULL AS VARCHAR)"), cz=(lambda: H.decompress_string(H.compress("c_name", "zlib"), "zlib"), "c_name"), cs=(lambda: H.decompress_string(H.compress("c_name", "zstd(3)"), "zstd"), "c_name"),
    en=(lambda: H.decrypt(H.encrypt("c_name", "secret"), "secret").cast("string"), "c_name"), tr=(lambda: H.try_decrypt(H.encrypt("c_name", "secret"), "other").cast("string"), "CAST(NULL AS VARCHAR)"), mb=(lambda: F.lower(F.hex(H.md5_binary("c_name"))), "md5(c_name)"),
)


@BOOK.query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cs, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS ip,
round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS l2, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 4) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vectors(t: Tables) -> DataFrame:
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select(
        "a", "b", F.round(E.vector_cosine_similarity("x", "y"), 5).alias("cs"), F.round(E.vector_inner_product("x", "y"), 4).alias("ip"),
        F.round(E.vector_l2_distance("x", "y"), 4).alias("l2"), F.round(E.vector_l1_distance("x", "y"), 4).alias("l1"),
    )


@BOOK.query()
def geography(t: Tables) -> DataFrame:
    p = t.supplier.select("s_suppkey", G.st_makepoint(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 80).cast("double")).alias("p"))
    box = F.lit("POLYGON((0 0, 12 0, 12 40, 0 40, 0 0))")
    return p.select(
        "s_suppkey", G.st_x("p").alias("x"), G.st_y("p").alias("y"), G.st_within("p", box).alias("inside"),
        F.round(G.st_distance("p", F.lit("POINT(0 0)")), 2).alias("metres"), G.st_astext("p").alias("text"), F.round(G.st_area(box, sphere=False), 3).alias("area"),
    )
