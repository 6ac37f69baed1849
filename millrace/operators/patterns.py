"""MATCH_RECOGNIZE.

The conditions of DEFINE are Spark expressions over a row and its neighbours (``lag``/``lead`` stand for PREV and
NEXT), so they are evaluated in the JVM, as one bit for each symbol. A partition's rows then read as a text with a
character for each set of symbols, and the pattern is a regular expression over it. Only the bits, the order and
the measured columns reach Python.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols of one pattern at most: each subset of them is a character.
SYMBOLS = 10
_BASE = 0x4E00


def _tokens(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c.isspace():
            i += 1
        elif c.isalpha() or c == "_":
            j = i
            while j < len(pattern) and (pattern[j].isalnum() or pattern[j] == "_"):
                j += 1
            out.append(pattern[i:j].upper())
            i = j
        elif pattern.startswith(("{-", "-}"), i):
            out.append(pattern[i : i + 2])
            i += 2
        elif c == "{":
            j = pattern.index("}", i) + 1
            out.append(pattern[i:j].replace(" ", ""))
            i = j
        else:
            out.append(c)
            i += 1
    return out


def to_regex(pattern: str, defined: Sequence[str]) -> tuple[str, list[str]]:
    """The pattern over characters of symbol sets, and all its symbols; undefined symbols fit any row."""
    tokens = _tokens(pattern)
    names = list(dict.fromkeys(t for t in tokens if (t[0].isalpha() or t[0] == "_") and t != "PERMUTE"))
    if len(names) > SYMBOLS:
        raise ValueError(f"a pattern has {SYMBOLS} symbols at most")
    bits = {n: 1 << i for i, n in enumerate(names)}
    known = {d.upper() for d in defined}

    def symbol(n: str) -> str:
        fits = [m for m in range(1 << len(names)) if m & bits[n]] if n in known else range(1 << len(names))
        return f"(?P<{n}>[{''.join(chr(_BASE + m) for m in fits)}])"

    def group(i: int, close: str) -> tuple[list[str], int]:
        """Comma-separated parts up to ``close``, and the place behind it."""
        parts, now, depth = [], [], 0
        while True:
            t = tokens[i]
            if depth == 0 and t in (close, ","):
                parts.append(build(now))
                now = []
                if t == close:
                    return parts, i + 1
            else:
                depth += t in ("(", "{-")
                depth -= t in (")", "-}")
                now.append(t)
            i += 1

    def build(ts: list[str]) -> str:
        nonlocal tokens
        outer, tokens = tokens, ts
        out, i = [], 0
        while i < len(ts):
            t = ts[i]
            if t == "PERMUTE":
                parts, i = group(i + 2, ")")
                out.append("(?:" + "|".join("".join(p) for p in itertools.permutations(parts)) + ")")
                continue
            if t == "{-":
                j = ts.index("-}", i)
                out.append("(?P<_excluded>" + build(ts[i + 1 : j]) + ")")
                i = j + 1
                continue
            if t == "(":
                out.append("(?:")
            elif t in bits:
                out.append(symbol(t))
            else:
                out.append(t)
            i += 1
        tokens = outer
        return "".join(out)

    return build(tokens), names


def match_recognize(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[Column],
    pattern: str,
    define: dict[str, Column],
    measures: dict[str, tuple[str, ...]],
    rows: str = "ONE ROW PER MATCH",
    skip: str = "PAST LAST ROW",
) -> DataFrame:
    """Matches of ``pattern`` in each partition.

    measures: name -> ("match_number",), ("classifier",), ("match_sequence_number",), or (kind, symbol or "",
    column) with kind first, last, count, sum, avg, min, max over the rows of that symbol (all rows for "").
    rows: ONE ROW PER MATCH, ALL ROWS PER MATCH [SHOW EMPTY MATCHES | OMIT EMPTY MATCHES | WITH UNMATCHED ROWS].
    skip: PAST LAST ROW, TO NEXT ROW, TO FIRST s, TO LAST s, TO s. In all-rows form measures are those up to the row.
    A partition is matched in one task; choose keys whose groups fit there.
    """
    expression, names = to_regex(pattern, list(define))
    low = {k.upper(): v for k, v in define.items()}
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    mask = F.lit(0)
    for i, n in enumerate(names):
        test = low.get(n)
        bit = F.lit(1 << i) if test is None else F.when(F.coalesce(test, F.lit(False)), 1 << i).otherwise(0)
        mask = mask.bitwiseOR(bit)
    prepared = df.withColumn("_n", F.row_number().over(w)).withColumn("_mask", mask)
    every = rows.upper().startswith("ALL ROWS")
    unmatched, no_empty = "UNMATCHED" in rows.upper(), "OMIT" in rows.upper()
    kept = list(df.columns) if every else list(partition_by)
    fields = [df.schema[c] for c in kept]
    for m, (kind, *rest) in measures.items():
        if kind in ("match_number", "match_sequence_number", "count"):
            t: T.DataType = T.LongType()
        elif kind == "classifier":
            t = T.StringType()
        elif kind in ("avg",):
            t = T.DoubleType()
        else:
            t = df.schema[rest[1]].dataType
        fields.append(T.StructField(m, t))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    needed = list(dict.fromkeys([*kept, *(m[2] for m in measures.values() if len(m) == 3)]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import regex

        pdf = pdf.sort_values("_n", kind="stable").reset_index(drop=True)
        text = "".join(chr(_BASE + m) for m in pdf["_mask"])
        column = {c: pdf[c].tolist() for c in needed}
        compiled = regex.compile(expression, regex.S)
        out: list[dict] = []
        at = number = 0
        covered: set[int] = set()

        def measure(spec: tuple, symbols: dict[int, str], upto: int, row: int | None) -> object:
            kind, *rest = spec
            if kind == "match_number":
                return number
            if kind == "classifier":
                return symbols.get(upto)
            if kind == "match_sequence_number":
                return upto - min(symbols, default=upto) + 1
            picked = [i for i, s in sorted(symbols.items()) if i <= upto and (not rest[0] or s == rest[0].upper())]
            if kind == "count":
                return len(picked)
            values = [column[rest[1]][i] for i in picked]
            if kind in ("first", "last"):
                return (values[0] if kind == "first" else values[-1]) if values else None
            values = [v for v in values if not pd.isna(v)]
            if not values:
                return None
            return {"sum": sum, "min": min, "max": max, "avg": lambda v: sum(v) / len(v)}[kind](values)

        while at <= len(text):
            m = compiled.match(text, at)
            if m is None or (m.end() == m.start() and at == len(text)):
                at += 1
                continue
            number += 1
            spans = [(s, n) for n in names for s, _ in m.spans(n)] if m.end() > m.start() else []
            symbols = dict(sorted(spans))
            hidden = {i for a, b in (m.spans("_excluded") if "_excluded" in compiled.groupindex else []) for i in range(a, b)}
            covered |= set(range(m.start(), m.end()))
            if every:
                if m.end() == m.start() and not no_empty:
                    out.append({c: column[c][m.start()] for c in kept} | {k: measure(s, {}, m.start(), None) for k, s in measures.items()})
                for i in range(m.start(), m.end()):
                    if i not in hidden:
                        out.append({c: column[c][i] for c in kept} | {k: measure(s, symbols, i, i) for k, s in measures.items()} | {"_at": i})
            elif len(pdf):
                here = min(m.start(), len(pdf) - 1)
                out.append({c: column[c][here] for c in kept} | {k: measure(s, symbols, m.end() - 1, None) for k, s in measures.items()})
            to = skip.upper().split()
            if to[:2] == ["TO", "NEXT"] or m.end() == m.start():
                at = m.start() + 1
            elif to[0] == "PAST":
                at = m.end()
            else:
                wanted = to[-1]
                places = [i for i, s in symbols.items() if s == wanted]
                at = (min(places) if "FIRST" in to else max(places)) if places else m.end()
                if at <= m.start():
                    raise ValueError("AFTER MATCH SKIP TO the first row of the match would never end")
        if every and unmatched:
            for i in range(len(pdf)):
                if i not in covered:
                    out.append({c: column[c][i] for c in kept} | dict.fromkeys(measures) | {"_at": i})
            out.sort(key=lambda r: r.get("_at", -1))
        made = pd.DataFrame(out, columns=[f.name for f in schema])
        for f in schema:
            if isinstance(f.dataType, T.LongType):
                made[f.name] = made[f.name].astype("Int64")
        return made

    return prepared.select(*needed, *(c for c in partition_by if c not in needed), "_n", "_mask").groupBy(*partition_by).applyInPandas(run, schema)
