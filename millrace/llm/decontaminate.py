"""Benchmark decontamination: one Aho-Corasick automaton over all test items.

Texts and items are normalised alike: A-Z in lower case, words of letters, digits and bytes beyond ASCII, one
blank between words. A window is ``WINDOW`` consecutive words of an item, or a whole shorter item. A document is
scanned once, word by word; matches are mapped to its words and, since normalisation keeps byte positions until
blanks are joined, to byte spans of the original text.

Any window of an item holds one of the item's aligned blocks of half a window's words whole. The automaton's patterns
are these blocks and the shorter items, and its letters are classes of words, so it has about one node for each word
of the items. What it finds is looked up exactly: the windows around a block by their digests in a sorted array, then
word by word. The arrays are one file that executors map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cached, forget_others, map_arrays, map_arrow, pack_arrays, publish, raw, small_batches, to_batch

WINDOW = 10
#: Item text of one automaton, in bytes: an executor's node of it takes some 60 bytes. A benchmark beyond this is
#: scanned for in parts, each with its automaton.
BLOCK_BYTES = 32 << 20
#: Letters of the automaton besides that of words that no item has.
CLASSES = 255


def _is_word(c: int) -> bool:
    return 48 <= c <= 57 or 97 <= c <= 122 or c >= 128


#: Byte map of the normalisation.
NORMAL = bytes(c if _is_word(c) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(item: bytes, size: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(item)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def digests(ids: np.ndarray, size: int) -> np.ndarray:
    """A digest of each ``size`` consecutive ids."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def index(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[str, np.ndarray]:
    """The arrays of ``Automaton`` for items (name, text)."""
    ids: dict[bytes, int] = {}
    long: list[list[int]] = []
    short: dict[tuple[int, ...], set[int]] = {}
    of: list[int] = []
    for k, (_, text) in enumerate(items):
        own = [ids.setdefault(w, len(ids) + 1) for w in words(text)]
        if len(own) >= size:
            long.append(own)
            of.append(k)
        elif own:
            short.setdefault(tuple(own), set()).add(k)
    lengths = np.array([len(x) for x in long], np.int64)
    text = np.fromiter((i for x in long for i in x), np.int32, int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    at = np.concatenate([np.arange(s, s + n - size + 1) for s, n in zip(first.tolist(), lengths.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    item = np.repeat(np.array(of, np.int64), lengths - size + 1)
    d = digests(text, size)[at]
    order = np.lexsort((at, d))
    d, at, item = d[order], at[order], item[order]
    same = np.zeros(len(d), bool)  # the window before it, word by word
    if len(d):
        same[1:] = d[1:] == d[:-1]
        for k in range(size):
            same[1:] &= text[at[1:] + k] == text[at[:-1] + k]
    starts = np.flatnonzero(~same)
    block = max(1, size // 2)
    blocks = np.concatenate([np.arange(s, s + n - block + 1, block) for s, n in zip(first.tolist(), lengths.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    if len(blocks):
        blocks = blocks[np.unique(np.stack([text[blocks + k] for k in range(block)], 1), axis=0, return_index=True)[1]]
    tail = [(i, sorted(x)) for i, x in short.items()]
    flat = lambda lists, kind: np.fromiter((y for x in lists for y in x), kind)
    ends = lambda lists: np.cumsum([0, *map(len, lists)]).astype(np.int64)
    return {
        "words": np.frombuffer(b" ".join(ids), np.uint8), "names": np.frombuffer(json.dumps([n for n, _ in items]).encode(), np.uint8),
        "size": np.array([size], np.int64), "text": text, "blocks": blocks, "digests": d[starts], "at": at[starts],
        "ends": np.append(starts, len(d)).astype(np.int64), "items": item, "short": flat((i for i, _ in tail), np.int32),
        "short_ends": ends([i for i, _ in tail]), "short_items": flat((x for _, x in tail), np.int64), "short_items_ends": ends([x for _, x in tail]),
    }


class _Letters(dict):
    def __missing__(self, word: bytes) -> str:
        return "\0"


class Automaton:
    """The windows of some items."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        import ahocorasick

        self.a = arrays
        self.size = int(arrays["size"][0])
        self.block = max(1, self.size // 2)
        self.names = json.loads(arrays["names"].tobytes())
        known = arrays["words"].tobytes().split()
        self.ids = {w: i for i, w in enumerate(known, 1)}
        self.letters = _Letters((w, chr(1 + i % CLASSES)) for w, i in self.ids.items())
        letter = np.array([chr(1 + i % CLASSES) for i in range(len(known) + 1)])
        self.auto = ahocorasick.Automaton()
        # a pattern's value: its length in words, and the short items that it may be
        for s in arrays["blocks"].tolist():
            self.auto.add_word("".join(letter[arrays["text"][s : s + self.block]]), (self.block, ()))
        ends = arrays["short_ends"].tolist()
        for k, (s, e) in enumerate(zip(ends, ends[1:])):  # noqa: B905
            key = "".join(letter[arrays["short"][s:e]])
            n, others = self.auto.get(key, (e - s, ()))
            seed = n == self.block and key in self.auto and (not others or others[0] < 0)
            self.auto.add_word(key, (e - s, ((-1,) if seed and not others else ()) + others + (k,)))
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, matches as (first, last) word, names of items with a match."""
        w = words(text)
        if not w or self.empty:
            return len(w), [], []
        found = list(self.auto.iter("".join(map(self.letters.__getitem__, w))))
        if not found:
            return len(w), [], []
        ids = np.fromiter((self.ids.get(x, 0) for x in w), np.int32, len(w))
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        starts: set[int] = set()
        a = self.a
        for end, (n, short) in found:
            if not short or short[0] < 0:  # a block: any window around it
                starts.update(range(max(0, end + 1 - self.size), min(end - n + 1, len(w) - self.size) + 1))
            for k in short:
                if k >= 0 and (ids[end - n + 1 : end + 1] == a["short"][a["short_ends"][k] : a["short_ends"][k + 1]]).all():
                    spans.add((end - n + 1, end))
                    items.update(a["short_items"][a["short_items_ends"][k] : a["short_items_ends"][k + 1]].tolist())
        if starts:
            s = np.fromiter(sorted(starts), np.int64)
            d = digests(ids, self.size)[s]
            left, right = (np.searchsorted(a["digests"], d, side) for side in ("left", "right"))
            for i in np.flatnonzero(left < right).tolist():
                at = int(s[i])
                for j in range(int(left[i]), int(right[i])):  # more than one only where digests collide
                    p = int(a["at"][j])
                    if (a["text"][p : p + self.size] == ids[at : at + self.size]).all():
                        spans.add((at, at + self.size - 1))
                        items.update(a["items"][a["ends"][j] : a["ends"][j + 1]].tolist())
        return len(w), sorted(spans), sorted({self.names[i] for i in items})


_automata: dict[str, Automaton] = {}
cached(__name__, _automata.clear)


def _automaton(name: str) -> Automaton:
    if name not in _automata:
        _automata.clear()
        _automata[name] = Automaton(map_arrays(SparkFiles.get(name)))
    return _automata[name]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive word spans, adjacent ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Start and end byte, in the original, of each span of words."""
    if not spans:
        return []
    space = np.frombuffer(text.translate(NORMAL), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [int(x) for a, b in spans for x in (starts[a], ends[b])]


_SCAN = "doc_id long, th long, n_words long, matches array<long>, items array<string>, spans array<long>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, block by block: the driver holds one block of bounded size at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    k = max(1, -(-total // block_bytes))
    for i in range(k):
        some = items if k == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield [(r["item_id"], (r["text"] or "").encode("utf-8", "surrogatepass")) for r in some.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, th, n_words, n_hit, items, spans`` for every row of ``docs``; th is a hash of the text.

    n_hit: words inside any match. items: ids of the items with a match, sorted as strings; a null item_id is
    called ``null``. spans: start and end byte of each run of hit words in the UTF-8 text. Null or empty texts
    have no words, and items without words match nothing. Repeated rows get a row each. An empty benchmark
    leaves all documents clean; an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    parts = []
    for items in _blocks(benchmark, block_bytes):
        name = publish(docs.sparkSession, pack_arrays(index(items, size)), "items")
        arrow = arrow_schema(_SCAN)

        def run(batches: Iterator[pa.RecordBatch], name=name, arrow=arrow) -> Iterator[pa.RecordBatch]:
            forget_others(__name__)
            auto = _automaton(name)
            for b in batches:
                rows = raw(b.column(2))
                found = [auto.scan(x) for x in rows]
                flat = [[y for s in f[1] for y in s] for f in found]
                yield to_batch(
                    {
                        "doc_id": b.column(0), "th": b.column(1), "n_words": [f[0] for f in found], "matches": flat,
                        "items": [f[2] for f in found],
                        "spans": [byte_spans(x, merge(f[1])) if f[1] else [] for x, f in zip(rows, found, strict=True)],
                    },
                    arrow,
                )

        parts.append(picked.mapInArrow(run, _SCAN))
    if len(parts) == 1:
        scanned = parts[0]
    else:
        # every part has a row for each document: n rows of a (doc_id, text) come back as n rows
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        scanned = _merged(every, len(parts))

    def finish(b: pa.RecordBatch) -> dict:
        pairs = [merge(list(zip(m[::2], m[1::2], strict=True))) for m in b.column(3).to_pylist()]
        return {
            "doc_id": b.column(0), "th": b.column(1), "n_words": b.column(2),
            "n_hit": [sum(y - x + 1 for x, y in p) for p in pairs], "items": b.column(4), "spans": b.column(5),
        }

    return map_arrow(scanned, finish, "doc_id long, th long, n_words long, n_hit long, items array<string>, spans array<long>")


def _merged(every: DataFrame, k: int) -> DataFrame:
    one = every.groupBy("doc_id", "th").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("matches")).alias("matches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.flatten(F.collect_set("spans")).alias("spans"), (F.count("*") / k).cast("int").alias("copies"),
    )
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def op3(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without any hit word."""
    dirty = decontaminate(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("__millrace_id"), F.col("th").alias("__millrace_th")).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__millrace_id")) & (F.xxhash64("text") == F.col("__millrace_th"))
    return docs.join(dirty, match, "left_anti")
