"""String and regular-expression functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import batch_udf, ColumnOrName, col, function, let, lit, must, null_if_any

#: Characters after which INITCAP starts a word (fixed values of the dialect).
INITCAP_DELIMITERS = " \t\n\r\f\v!?@\"^#$&~_,.:;+-*%/|\\[](){}<>"


@function()
def ascii(s: ColumnOrName) -> Column:
    return F.when(F.length(col(s)) == 0, 0).otherwise(F.ascii(col(s)))


@function("UNICODE")
def unicode(s: ColumnOrName) -> Column:
    """Code point of the first character, beyond the basic plane too."""
    h = F.hex(F.encode(F.substring(col(s), 1, 1), "UTF-32"))
    return F.when(F.length(col(s)) == 0, 0).otherwise(F.conv(h, 16, 10).cast("int"))


@function("CHR", "CHAR")
def chr_(n: ColumnOrName) -> Column:
    """Character of a code point; an error outside of Unicode."""
    n = col(n)
    ok = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return must(ok, F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"), "CHR: not a code point")


@function()
def bit_length(s: ColumnOrName) -> Column:
    return F.bit_length(col(s))


@function()
def octet_length(s: ColumnOrName) -> Column:
    return F.octet_length(col(s))


@function("LENGTH", "LEN")
def length(s: ColumnOrName) -> Column:
    return F.length(col(s))


@function()
def rtrimmed_length(s: ColumnOrName) -> Column:
    return F.length(F.rtrim(col(s)))


@function("CHARINDEX", "POSITION")
def charindex(needle: ColumnOrName, hay: ColumnOrName, start: int = 1) -> Column:
    return F.locate(needle, col(hay), start) if isinstance(needle, str) else F.position(needle, col(hay), F.lit(start))


position = charindex


@function()
def collate(s: ColumnOrName, spec: str) -> Column:
    """Dialect specs (``en-ci``, ``utf8``, ``upper``, ...) as Spark collations."""
    parts = set(spec.lower().split("-"))
    name = "UTF8_BINARY" if parts <= {"", "utf8"} else "UTF8_LCASE" if parts & {"upper", "lower"} else "UNICODE"
    if name == "UNICODE":
        name += "_CI" if "ci" in parts else ""
        name += "_AI" if "ai" in parts else ""
    if "trim" in parts:
        name += "_RTRIM"
    return F.collate(col(s), name)


@function()
def collation(s: ColumnOrName) -> Column:
    return F.collation(col(s))


@function()
def concat(*xs: ColumnOrName) -> Column:
    return F.concat(*(col(x).cast("string") for x in xs))


@function()
def concat_ws(sep: str | Column, *xs: ColumnOrName) -> Column:
    """Null if any argument is null."""
    cs = [col(x).cast("string") for x in xs]
    s = lit(sep)
    joined = cs[0]
    for c in cs[1:]:
        joined = F.concat(joined, s, c)
    return null_if_any([s, *cs], joined)


@function()
def contains(s: ColumnOrName, part: str | Column) -> Column:
    return F.contains(col(s), lit(part))


@function()
def startswith(s: ColumnOrName, part: str | Column) -> Column:
    return F.startswith(col(s), lit(part))


@function()
def endswith(s: ColumnOrName, part: str | Column) -> Column:
    return F.endswith(col(s), lit(part))


@function()
def editdistance(a: ColumnOrName, b: ColumnOrName, most: int | None = None) -> Column:
    d = F.levenshtein(col(a), col(b))
    return d if most is None else F.least(d, F.lit(most))


@function()
def like(s: ColumnOrName, pattern: str | Column, escape: str | None = None) -> Column:
    return F.like(col(s), lit(pattern), F.lit(escape) if escape else None)


@function()
def ilike(s: ColumnOrName, pattern: str | Column, escape: str | None = None) -> Column:
    return F.ilike(col(s), lit(pattern), F.lit(escape) if escape else None)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


@function("LIKE ANY")
def like_any(s: ColumnOrName, *patterns: str | None) -> Column:
    """Null patterns are skipped."""
    return _any([like(s, p) for p in patterns if p is not None] or [F.lit(False)])


@function("ILIKE ANY")
def ilike_any(s: ColumnOrName, *patterns: str | None) -> Column:
    return _any([ilike(s, p) for p in patterns if p is not None] or [F.lit(False)])


@function("LIKE ALL")
def like_all(s: ColumnOrName, *patterns: str | None) -> Column:
    return ~_any([~like(s, p) for p in patterns if p is not None] or [F.lit(False)])


@function()
def initcap(s: ColumnOrName, delimiters: str = INITCAP_DELIMITERS) -> Column:
    """Upper case after any delimiter, lower case elsewhere; without delimiters only the first letter."""
    s = col(s)
    low = F.lower(s)
    if not delimiters:
        return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
    chars = F.filter(F.split(low, ""), lambda x: x != "")
    before = F.concat(F.array(F.lit(delimiters[0])), chars)
    return F.when(s.isNotNull(), F.array_join(F.transform(chars, lambda x, i: F.when(F.contains(F.lit(delimiters), F.get(before, i)), F.upper(x)).otherwise(x)), ""))


@function("INSERT")
def insert(base: ColumnOrName, pos: int | Column, length: int | Column, new: str | Column) -> Column:
    base = col(base)
    return F.concat(F.substring(base, F.lit(1), lit(pos) - 1), lit(new), F.substring(base, lit(pos) + lit(length), F.lit(1 << 30)))


@function()
def jarowinkler_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100, without regard to case."""
    return _jarowinkler(col(a), col(b))


def jarowinkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two strings, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, other, strict=True)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@batch_udf("int")
def _jarowinkler(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a, b, strict=True)
    return pd.Series([None if x is None or y is None else int(100 * jarowinkler(x.lower(), y.lower())) for x, y in pairs], dtype="Int32")


@function()
def left(s: ColumnOrName, n: int | Column) -> Column:
    return F.left(col(s), lit(n))


@function()
def right(s: ColumnOrName, n: int | Column) -> Column:
    return F.right(col(s), lit(n))


@function()
def lower(s: ColumnOrName) -> Column:
    return F.lower(col(s))


@function()
def upper(s: ColumnOrName) -> Column:
    return F.upper(col(s))


@function()
def lpad(s: ColumnOrName, n: int, pad: str = " ") -> Column:
    return F.lpad(col(s), n, pad)


@function()
def rpad(s: ColumnOrName, n: int, pad: str = " ") -> Column:
    return F.rpad(col(s), n, pad)


@function()
def ltrim(s: ColumnOrName, chars: str = " ") -> Column:
    return F.ltrim(col(s), F.lit(chars))


@function()
def rtrim(s: ColumnOrName, chars: str = " ") -> Column:
    return F.rtrim(col(s), F.lit(chars))


@function()
def trim(s: ColumnOrName, chars: str = " ") -> Column:
    return F.trim(col(s), F.lit(chars))


@function("NORMALIZE")
def normalize(x: ColumnOrName, low: float | Column, high: float | Column) -> Column:
    return (col(x) - lit(low)) / (lit(high) - lit(low))


@function()
def parse_url(url: ColumnOrName, permissive: int = 0) -> Column:
    """Seven parts, by name; with ``permissive`` a string without a scheme gives nulls instead of an error."""
    u = col(url)
    part = lambda p: F.try_parse_url(u, F.lit(p)) if permissive else F.parse_url(u, F.lit(p))
    authority = part("AUTHORITY")
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))
    query = part("QUERY")
    parameters = F.when(query.isNotNull(), F.str_to_map(query, F.lit("&"), F.lit("=")))
    return F.struct(
        part("REF").alias("fragment"), part("HOST").alias("host"), parameters.alias("parameters"),
        F.ltrim(part("PATH"), F.lit("/")).alias("path"), port.alias("port"), query.alias("query"), part("PROTOCOL").alias("scheme"),
    )


@function()
def randstr(n: int, seed: int | None = None) -> Column:
    return F.randstr(n) if seed is None else F.randstr(n, seed)


def _flagged(pattern: str, flags: str) -> str:
    """Parameters: c(ase), i(gnore case), m(ultiline), s (dot matches line ends), e(xtract)."""
    keep = "".join(f for f in ("i", "m", "s") if f in flags and not (f == "i" and flags.rfind("c") > flags.rfind("i")))
    return f"(?{keep}){pattern}" if keep else pattern


@function("REGEXP_LIKE", "RLIKE", "REGEXP")
def regexp_like(s: ColumnOrName, pattern: str, flags: str = "c") -> Column:
    """The pattern must match the whole string."""
    return F.rlike(col(s), F.lit(_flagged(f"^(?:{pattern})$", flags)))


def _from(s: ColumnOrName, pos: int) -> Column:
    return F.substring(col(s), pos, 1 << 30) if pos > 1 else col(s)


@function()
def regexp_count(s: ColumnOrName, pattern: str, pos: int = 1, flags: str = "c") -> Column:
    return F.regexp_count(_from(s, pos), F.lit(_flagged(pattern, flags)))


@function()
def regexp_substr_all(s: ColumnOrName, pattern: str, pos: int = 1, flags: str = "c", group: int = 0) -> Column:
    if "e" in flags and not group:
        group = 1
    return F.regexp_extract_all(_from(s, pos), F.lit(_flagged(pattern, flags)), F.lit(group))


@function()
def regexp_substr(s: ColumnOrName, pattern: str, pos: int = 1, occurrence: int = 1, flags: str = "c", group: int = 0) -> Column:
    return F.get(regexp_substr_all(s, pattern, pos, flags, group), F.lit(occurrence - 1))


@function()
def regexp_instr(s: ColumnOrName, pattern: str, pos: int = 1, occurrence: int = 1, option: int = 0, flags: str = "c") -> Column:
    """Place of an occurrence, or (option 1) the place after it; 0 if there is none."""
    rest = _from(s, pos)
    p = _flagged(pattern, flags)
    hits = F.regexp_extract_all(rest, F.lit(p), F.lit(0))
    gaps = F.split(rest, p, -1)
    before = lambda k: F.aggregate(
        F.slice(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))), 1, k), F.lit(0), lambda a, x: a + x
    )
    at = before(occurrence - 1) + F.length(F.get(gaps, F.lit(occurrence - 1))) if occurrence > 1 else F.length(F.get(gaps, F.lit(0)))
    if option:
        at = at + F.length(F.get(hits, F.lit(occurrence - 1)))
    return F.when(col(s).isNull(), None).when(F.size(hits) < occurrence, 0).otherwise(at + pos)


@function()
def regexp_replace(s: ColumnOrName, pattern: str, replacement: str = "", pos: int = 1, occurrence: int = 0, flags: str = "c") -> Column:
    r"""``\1`` refers to a group; occurrence 0 replaces all."""
    import re

    to = re.sub(r"\\(\d)", r"$\1", replacement)
    p = _flagged(pattern, flags)
    head = F.substring(col(s), 1, pos - 1) if pos > 1 else F.lit("")
    rest = _from(s, pos)
    if not occurrence:
        return F.concat(head, F.regexp_replace(rest, p, to))
    gaps, hits = F.split(rest, p, -1), F.regexp_extract_all(rest, F.lit(p), F.lit(0))
    new = F.transform(hits, lambda h, i: F.when(i == occurrence - 1, F.regexp_replace(h, F.lit(p), F.lit(to))).otherwise(h))
    return F.concat(head, F.array_join(F.zip_with(gaps, new, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), ""))


@function()
def repeat(s: ColumnOrName, n: int | Column) -> Column:
    return F.repeat(col(s), lit(n))


@function()
def replace(s: ColumnOrName, find: str | Column, new: str | Column = "") -> Column:
    return F.replace(col(s), lit(find), lit(new))


@function()
def reverse(s: ColumnOrName) -> Column:
    return F.reverse(col(s))


@function()
def soundex(s: ColumnOrName) -> Column:
    return F.soundex(col(s))


#: Letters with the digits of Soundex (fixed values).
SOUNDEX_DIGITS = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


@function()
def soundex_p123(s: ColumnOrName) -> Column:
    """Soundex in which the first letter's digit isn't merged with the one that follows."""
    letters = F.upper(F.regexp_replace(col(s), "[^A-Za-z]", ""))
    tail = F.substring(letters, 2, 1 << 30)
    source, to = "".join(SOUNDEX_DIGITS), "".join(d * len(k) for k, d in SOUNDEX_DIGITS.items())
    coded = F.translate(F.regexp_replace(tail, "[HW]", ""), source + "AEIOUY", to + "000000")
    once = F.regexp_replace(F.regexp_replace(coded, r"(.)\1+", "$1"), "0", "")
    return F.when(F.length(letters) > 0, F.rpad(F.concat(F.substring(letters, 1, 1), once), 4, "0")).otherwise(F.lit(""))


@function()
def space(n: int | Column) -> Column:
    return F.repeat(F.lit(" "), lit(n))


@function("SPLIT")
def split(s: ColumnOrName, delimiter: str) -> Column:
    """By a literal delimiter; an empty delimiter doesn't split."""
    return F.array(col(s)) if delimiter == "" else F.split(col(s), "\\Q" + delimiter + "\\E", -1)


@function()
def split_part(s: ColumnOrName, delimiter: str, n: int) -> Column:
    """Parts from 1, from the end if negative, 0 is 1; empty beyond."""
    parts = split(s, delimiter)
    i = F.lit(n - 1 if n > 0 else 0) if n >= 0 else F.size(parts) + n
    return F.when(col(s).isNotNull(), F.coalesce(F.when(i >= 0, F.get(parts, i)), F.lit("")))


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in chars) + "]+"


@function()
def strtok_to_array(s: ColumnOrName, delimiters: str = " ") -> Column:
    parts = F.split(col(s), _char_class(delimiters), -1) if delimiters else F.array(col(s))
    return F.filter(parts, lambda x: x != "")


@function()
def strtok(s: ColumnOrName, delimiters: str = " ", n: int = 1) -> Column:
    return F.get(strtok_to_array(s, delimiters), F.lit(n - 1))


@function("SUBSTRING", "SUBSTR")
def substring(s: ColumnOrName, start: int | Column, n: int | Column | None = None) -> Column:
    """From 1; 0 is 1; negative from the end, and empty where that is before the beginning."""
    s, start = col(s), lit(start)
    rest = F.lit(1 << 30) if n is None else lit(n)
    before = (start < 0) & (-start > F.length(s))
    return F.when(before, F.lit("")).otherwise(F.substring(s, F.when(start == 0, 1).otherwise(start), F.greatest(rest, F.lit(0))))


@function("TRANSLATE")
def translate(s: ColumnOrName, source: str, to: str) -> Column:
    return F.translate(col(s), source, to)


@function()
def validate_utf8(s: ColumnOrName) -> Column:
    return F.validate_utf8(col(s))


@function()
def try_validate_utf8(s: ColumnOrName) -> Column:
    return F.try_validate_utf8(col(s))


def _ip_parts(text: str | None) -> dict | None:
    import ipaddress

    try:
        net = ipaddress.ip_interface(text.strip())
    except (ValueError, AttributeError):
        return None
    first, last = int(net.network.network_address), int(net.network.broadcast_address)
    prefix = net.network.prefixlen if "/" in text else None
    return {"family": net.version, "host": str(net.ip), "ip_fields": net.ip.packed.hex(), "netmask_prefix_length": prefix, "range_start": str(first), "range_end": str(last)}


_IP = "struct<family:int,host:string,ip_fields:string,netmask_prefix_length:int,range_start:string,range_end:string>"


@batch_udf(_IP)
def _parse_ip(s: pd.Series) -> pd.DataFrame:
    names = ["family", "host", "ip_fields", "netmask_prefix_length", "range_start", "range_end"]
    rows = [_ip_parts(x) or dict.fromkeys(names) for x in s]
    return pd.DataFrame(rows, columns=names).astype({"family": "Int32", "netmask_prefix_length": "Int32"})


@function()
def try_parse_ip(s: ColumnOrName, kind: str = "INET") -> Column:
    """Parts of an IPv4 or IPv6 address or network, null if it is none."""
    return let(_parse_ip(col(s)), lambda x: F.when(x["family"].isNotNull(), x))


@function()
def parse_ip(s: ColumnOrName, kind: str = "INET") -> Column:
    return let(_parse_ip(col(s)), lambda x: must(x["family"].isNotNull() | F.lit(False), x, "PARSE_IP: not an address"))


@function()
def search(columns: ColumnOrName | list[ColumnOrName], terms: str, mode: str = "OR") -> Column:
    """Whether lower-cased words of the columns hold any (or, by mode, all) of the words of ``terms``."""
    import re

    cs = columns if isinstance(columns, list) else [columns]
    words = F.split(F.lower(F.concat_ws(" ", *(col(c).cast("string") for c in cs))), r"[^\p{L}\p{N}]+")
    wanted = [w for w in re.split(r"[^\w]+", terms.lower()) if w]
    found = F.array(*map(F.lit, wanted))
    if mode.upper() == "AND":
        return F.size(F.array_except(found, words)) == 0
    return F.arrays_overlap(words, found)
