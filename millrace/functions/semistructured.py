"""Arrays, objects, maps and variants. Array indexes count from 0."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import batch_udf, REGISTRY, ColumnOrName, col, function, lit, must

# --- arrays ----------------------------------------------------------------------------------------------


@function()
def array_append(a: ColumnOrName, x: Any) -> Column:
    return F.array_append(col(a), lit(x))


@function()
def array_prepend(a: ColumnOrName, x: Any) -> Column:
    return F.array_prepend(col(a), lit(x))


@function()
def array_cat(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.concat(col(a), col(b))


@function()
def array_compact(a: ColumnOrName) -> Column:
    return F.array_compact(col(a))


@function()
def array_construct(*xs: Any) -> Column:
    return F.array(*map(lit, xs))


@function()
def array_construct_compact(*xs: Any) -> Column:
    return F.array_compact(F.array(*map(lit, xs)))


@function()
def array_contains(x: Any, a: ColumnOrName) -> Column:
    """The value comes first."""
    return F.array_contains(col(a), lit(x))


@function()
def array_distinct(a: ColumnOrName) -> Column:
    return F.array_distinct(col(a))


def _earlier_equal(a: Column, x: Column, i: Column) -> Column:
    return F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y.eqNullSafe(x)))


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y.eqNullSafe(x)))


@function()
def array_except(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Multiset difference: each element of ``b`` takes one equal element of ``a``, from the front."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.filter(a, lambda x, i: _earlier_equal(a, x, i) >= _count(b, x)))


@function()
def array_intersection(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Multiset intersection in the order of ``a``."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.filter(a, lambda x, i: _earlier_equal(a, x, i) < _count(b, x)))


@function()
def array_flatten(a: ColumnOrName) -> Column:
    return F.flatten(col(a))


@function()
def array_generate_range(start: Any, stop: Any, step: int = 1) -> Column:
    """``stop`` is left out."""
    a, b = lit(start), lit(stop)
    last = b - (1 if step > 0 else -1)
    some = (a < b) if step > 0 else (a > b)
    return F.when(some, F.sequence(a, F.when(some, last).otherwise(a), F.lit(step))).otherwise(F.slice(F.array(a), 1, 0))


@function()
def array_insert(a: ColumnOrName, i: int, x: Any) -> Column:
    return F.array_insert(col(a), F.lit(i + 1 if i >= 0 else i - 1), lit(x))


@function()
def array_max(a: ColumnOrName) -> Column:
    return F.array_max(col(a))


@function()
def array_min(a: ColumnOrName) -> Column:
    return F.array_min(col(a))


@function()
def array_position(x: Any, a: ColumnOrName) -> Column:
    """From 0; null if absent."""
    return F.nullif(F.array_position(col(a), lit(x)), F.lit(0).cast("long")) - 1


@function()
def array_remove(a: ColumnOrName, x: Any) -> Column:
    return F.array_remove(col(a), lit(x))


@function()
def array_remove_at(a: ColumnOrName, i: int) -> Column:
    a = col(a)
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.filter(a, lambda _, k: k != at)


@function()
def array_repeat(x: Any, n: int) -> Column:
    return F.array_repeat(lit(x), n)


@function()
def array_reverse(a: ColumnOrName) -> Column:
    return F.reverse(col(a))


@function()
def array_size(a: ColumnOrName) -> Column:
    return F.array_size(col(a))


@function()
def array_slice(a: ColumnOrName, start: int, stop: int) -> Column:
    """From ``start`` to before ``stop``; negative places count from the end."""
    a = col(a)
    n = F.size(a)
    place = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
    return F.slice(a, place(start) + 1, F.greatest(place(stop) - place(start), F.lit(0)))


@function()
def array_sort(a: ColumnOrName, ascending: bool = True, nulls_first: bool | None = None) -> Column:
    """Nulls come last ascending and first descending, unless told otherwise."""
    a = col(a)
    first = (not ascending) if nulls_first is None else nulls_first
    values = F.sort_array(F.array_compact(a), asc=ascending)
    nulls = F.filter(a, lambda x: x.isNull())
    return F.concat(nulls, values) if first else F.concat(values, nulls)


@function()
def array_to_string(a: ColumnOrName, delimiter: str) -> Column:
    return F.array_join(col(a).cast("array<string>"), delimiter, "")


@function()
def arrays_overlap(a: ColumnOrName, b: ColumnOrName) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.exists(a, lambda x: F.exists(b, lambda y: x.eqNullSafe(y))))


@function()
def arrays_to_object(keys: ColumnOrName, values: ColumnOrName) -> Column:
    """Entries with a null key or value are left out."""
    pairs = F.zip_with(col(keys), col(values), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()))


@function()
def arrays_zip(*xs: ColumnOrName) -> Column:
    """Structs with the fields $1, $2, ..."""
    return F.arrays_zip(*(col(x).alias(f"${i}") for i, x in enumerate(xs, 1)))


@function("TRANSFORM")
def transform(a: ColumnOrName, f) -> Column:
    return F.transform(col(a), f)


@function("FILTER")
def filter(a: ColumnOrName, f) -> Column:
    return F.filter(col(a), f)


@function("REDUCE")
def reduce(a: ColumnOrName, start: Any, f) -> Column:
    return F.aggregate(col(a), lit(start), f)


# --- maps and objects ------------------------------------------------------------------------------------


def _keep(m: ColumnOrName, keys: tuple, wanted: bool) -> Column:
    ks = F.array(*map(lit, keys))
    return F.map_filter(col(m), lambda k, _: F.array_contains(ks, k) if wanted else ~F.array_contains(ks, k))


@function("MAP_CAT")
def map_cat(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Entries of the right map win."""
    a, b = col(a), col(b)
    left = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(left, b)


@function("MAP_CONSTRUCT")
def map_construct(*xs: Any) -> Column:
    return F.create_map(*map(lit, xs))


@function()
def map_contains_key(k: Any, m: ColumnOrName) -> Column:
    return F.map_contains_key(col(m), lit(k))


@function("MAP_DELETE", "OBJECT_DELETE")
def map_delete(m: ColumnOrName, *keys: Any) -> Column:
    return _keep(m, keys, False)


@function("MAP_PICK", "OBJECT_PICK")
def map_pick(m: ColumnOrName, *keys: Any) -> Column:
    return _keep(m, keys, True)


@function()
def map_entries(m: ColumnOrName) -> Column:
    return F.map_entries(col(m))


@function("MAP_INSERT", "OBJECT_INSERT")
def map_insert(m: ColumnOrName, k: Any, v: Any, update: bool = False) -> Column:
    """An error if the key is there, unless ``update``."""
    m, k = col(m), lit(k)
    out = F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, lit(v)))
    return out if update else must(~F.map_contains_key(m, k), out, "the key exists already")


@function("MAP_KEYS", "OBJECT_KEYS")
def map_keys(m: ColumnOrName) -> Column:
    """Sorted."""
    return F.array_sort(F.map_keys(col(m)))


@function()
def map_size(m: ColumnOrName) -> Column:
    return F.size(col(m))


def _object(xs: tuple) -> tuple[list[str], list[Column]]:
    return [str(k) for k in xs[::2]], [lit(v) for v in xs[1::2]]


@function()
def object_construct(*xs: Any) -> Column:
    """key, value, key, value, ...: a variant object without its null values."""
    keys, values = _object(xs)
    return F.parse_json(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(zip(keys, values, strict=True), key=lambda p: p[0])))))


@function()
def object_construct_keep_null(*xs: Any) -> Column:
    keys, values = _object(xs)
    parts = F.struct(*(v.alias(k) for k, v in sorted(zip(keys, values, strict=True), key=lambda p: p[0])))
    return F.parse_json(F.to_json(parts, {"ignoreNullFields": "false"}))


# --- variants --------------------------------------------------------------------------------------------


@function()
def parse_json(s: ColumnOrName) -> Column:
    """An empty or blank text is null."""
    t = F.trim(col(s))
    return F.when(t != "", F.parse_json(t))


@function()
def try_parse_json(s: ColumnOrName) -> Column:
    return F.try_parse_json(F.trim(col(s)))


@function()
def check_json(s: ColumnOrName) -> Column:
    """Null for valid JSON, else what is wrong."""
    return F.when(col(s).isNotNull() & F.try_parse_json(col(s)).isNull(), F.concat(F.lit("invalid JSON: "), F.left(col(s), F.lit(80))))


def path(*steps: str | int) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


@function("GET", "GET_PATH")
def get_path(v: ColumnOrName, where: str | int, type_: str = "variant") -> Column:
    """An index, a key, or a path such as ``a.b[0]``; null if absent. Keys are case-sensitive."""
    p = f"$[{where}]" if isinstance(where, int) else where if where.startswith("$") else "$." + where if not where.startswith("[") else "$" + where
    return F.try_variant_get(col(v), p, type_)


@function()
def get_ignore_case(m: ColumnOrName, key: str) -> Column:
    """The value of an equal key, else of the first key that differs in case only (of a map)."""
    m = col(m)
    near = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.get(near, F.lit(0))["value"])


@function()
def json_extract_path_text(s: ColumnOrName, where: str) -> Column:
    return F.get_json_object(col(s), "$." + where)


@function()
def strip_null_value(v: ColumnOrName) -> Column:
    return F.when(~F.is_variant_null(col(v)), col(v))


@function()
def is_null_value(v: ColumnOrName) -> Column:
    return F.when(col(v).isNotNull(), F.is_variant_null(col(v)))


#: Dialect names of variant kinds by the beginning of Spark's (fixed values).
KINDS = {
    "OBJECT": "OBJECT", "ARRAY": "ARRAY", "STRING": "VARCHAR", "BOOLEAN": "BOOLEAN", "BIGINT": "INTEGER", "DECIMAL": "DECIMAL", "DOUBLE": "DOUBLE",
    "FLOAT": "DOUBLE", "DATE": "DATE", "TIMESTAMP_NTZ": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_LTZ", "BINARY": "BINARY", "VOID": "NULL_VALUE",
}


@function()
def typeof(v: ColumnOrName) -> Column:
    """Kind of a variant by its dialect name."""
    kind = F.regexp_extract(F.schema_of_variant(col(v)), r"^[A-Z_]+", 0)
    names = F.create_map(*(F.lit(x) for p in KINDS.items() for x in p))
    return F.when(col(v).isNotNull(), F.try_element_at(names, kind))


def _is(kinds: tuple[str, ...]):
    def build(v: ColumnOrName) -> Column:
        return typeof(v).isin(*kinds)

    return build


for _names, _kinds in (
    (("IS_ARRAY",), ("ARRAY",)), (("IS_BINARY",), ("BINARY",)), (("IS_BOOLEAN",), ("BOOLEAN",)), (("IS_DATE", "IS_DATE_VALUE"), ("DATE",)),
    (("IS_DECIMAL",), ("INTEGER", "DECIMAL")), (("IS_DOUBLE", "IS_REAL"), ("INTEGER", "DECIMAL", "DOUBLE")), (("IS_INTEGER",), ("INTEGER",)),
    (("IS_OBJECT",), ("OBJECT",)), (("IS_TIMESTAMP_LTZ",), ("TIMESTAMP_LTZ",)), (("IS_TIMESTAMP_NTZ",), ("TIMESTAMP_NTZ",)),
    (("IS_VARCHAR", "IS_CHAR"), ("VARCHAR",)), (("IS_TIME",), ("TIME",)), (("IS_TIMESTAMP_TZ",), ("TIMESTAMP_TZ",)),
):
    for _n in _names:
        globals()[_n.lower()] = REGISTRY[_n] = _is(_kinds)


def _as(kinds: tuple[str, ...], type_: str):
    def build(v: ColumnOrName) -> Column:
        return F.when(typeof(v).isin(*kinds), F.try_variant_get(col(v), "$", type_))

    return build


for _names, _kinds, _type in (
    (("AS_ARRAY",), ("ARRAY",), "array<variant>"), (("AS_BINARY",), ("BINARY",), "binary"), (("AS_BOOLEAN",), ("BOOLEAN",), "boolean"),
    (("AS_DATE",), ("DATE",), "date"), (("AS_DOUBLE", "AS_REAL"), ("INTEGER", "DECIMAL", "DOUBLE"), "double"), (("AS_INTEGER",), ("INTEGER",), "bigint"),
    (("AS_OBJECT",), ("OBJECT",), "variant"), (("AS_TIMESTAMP_LTZ",), ("TIMESTAMP_LTZ",), "timestamp"), (("AS_TIMESTAMP_TZ",), ("TIMESTAMP_TZ",), "timestamp"),
    (("AS_TIMESTAMP_NTZ",), ("TIMESTAMP_NTZ",), "timestamp_ntz"), (("AS_VARCHAR", "AS_CHAR"), ("VARCHAR",), "string"), (("AS_TIME",), ("TIME",), "bigint"),
):
    for _n in _names:
        globals()[_n.lower()] = REGISTRY[_n] = _as(_kinds, _type)


@function("AS_DECIMAL", "AS_NUMBER")
def as_decimal(v: ColumnOrName, p: int = 38, s: int = 0) -> Column:
    return F.when(typeof(v).isin("INTEGER", "DECIMAL"), F.try_variant_get(col(v), "$", f"decimal({p},{s})"))


@function()
def to_variant(x: ColumnOrName) -> Column:
    return col(x).cast("variant")


@function()
def to_array(v: ColumnOrName) -> Column:
    """A variant array as it is, any other variant as an array of one."""
    v = col(v)
    return F.when(typeof(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.when(v.isNotNull(), F.array(v)))


@function()
def to_object(v: ColumnOrName) -> Column:
    v = col(v)
    return must(v.isNull() | (typeof(v) == "OBJECT"), v, "TO_OBJECT: not an object")


@function()
def to_json(v: ColumnOrName) -> Column:
    return F.to_json(col(v))


# --- XML -------------------------------------------------------------------------------------------------


def _element(e) -> dict:
    """An element as an object: ``@`` its name, ``$`` its content, attributes as ``@name``."""
    out: dict[str, Any] = {"@": e.tag} | {"@" + k: v for k, v in e.attrib.items()}
    kids = [_element(c) for c in e]
    text = (e.text or "").strip()
    out["$"] = (([text] if text else []) + kids if len(kids) > 1 or text and kids else kids[0]) if kids else text
    return out


def _xml(text: str | None):
    import xml.etree.ElementTree as ET

    if text is None or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        return ET.fromstring(text.strip())
    except ET.ParseError:
        return None


@batch_udf("string")
def _xml_json(s: pd.Series) -> pd.Series:
    import json

    return pd.Series([None if (e := _xml(x)) is None else json.dumps(_element(e)) for x in s], dtype=object)


@batch_udf("string")
def _xml_get(s: pd.Series, tag: pd.Series, n: pd.Series) -> pd.Series:
    import xml.etree.ElementTree as ET

    out = []
    for x, t, i in zip(s, tag, n, strict=True):
        found = [] if (e := _xml(x)) is None else [c for c in e if c.tag == t]
        out.append(ET.tostring(found[i], encoding="unicode").strip() if i < len(found) else None)
    return pd.Series(out, dtype=object)


def _from_object(o: Any) -> str:
    from xml.sax.saxutils import escape, quoteattr

    if isinstance(o, list):
        return "".join(map(_from_object, o))
    if not isinstance(o, dict):
        return "" if o is None else escape(str(o))
    name = o.get("@", "object")
    attributes = "".join(f" {k[1:]}={quoteattr(str(v))}" for k, v in o.items() if k[:1] == "@" and len(k) > 1)
    inner = _from_object(o["$"]) if "$" in o else "".join(f"<{k}>{_from_object(v)}</{k}>" for k, v in o.items() if k[:1] != "@")
    return f"<{name}{attributes}>{inner}</{name}>"


@batch_udf("string")
def _to_xml(s: pd.Series) -> pd.Series:
    import json

    return pd.Series([None if x is None else _from_object(json.loads(x)) for x in s], dtype=object)


@function()
def parse_xml(s: ColumnOrName) -> Column:
    """An element as a variant object."""
    j = _xml_json(col(s))
    return F.parse_json(must(col(s).isNull() | j.isNotNull(), j, "PARSE_XML: not well formed"))


@function()
def check_xml(s: ColumnOrName) -> Column:
    return F.when(col(s).isNotNull() & _xml_json(col(s)).isNull(), F.lit("not well formed"))


@function("XMLGET")
def xmlget(s: ColumnOrName, tag: str, instance: int = 0) -> Column:
    """Text of the n-th child element of that name."""
    return _xml_get(col(s), F.lit(tag), F.lit(instance))


@function()
def to_xml(v: ColumnOrName) -> Column:
    return _to_xml(F.to_json(col(v)))


