"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece can cross (from the vocabulary: letters, other characters and blanks).
The distinct units of the corpus are exploded into substrings of bounded length, equi-joined to the piece table
and grouped by unit again: the edges of each unit's lattice. A Viterbi fold with Spark's higher-order
``aggregate`` picks the path. The units' ids make a dictionary, with which whole texts are encoded in one pass.

Unigram models add up scores. The scores of a BPE model are merge priorities, and their sum doesn't give the
model's ids; there an edge weighs the *set* of merges that build its piece, each a key (priority, position), and
of two paths the one that holds the least key of their symmetric difference is better. That order is kept when
the same set is added to both sides, so Viterbi finds the best path, and the best path is what the model's greedy
merging gives: the least key that can be merged always is. (A piece whose merges don't come in the order of
their priorities takes part with its last one.)
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, forget_others, gathered, joined, keep_freed_memory, materialize, publish, raw, setting, small_batches, tidy, to_batch, valid

#: SentencePiece's stand-in for a blank, and the kinds of pieces and models of its file format (fixed values).
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A lattice of so many characters and edges at most has its merge sets in the bits of a long, others in arrays.
BITS = 62
#: A merge key: priority, position (32 bits) and length (8 bits).
LENGTH_BITS, POSITION_BITS = 8, 32
#: Dictionary entries that executors map from one file take so many bytes at most; rarer units are joined.
HEAD_BYTES = 96 << 20
#: Units of one lattice task: bounds the edges that it holds.
PART_UNITS = 8_000
#: Latin units over this length are cut wherever no piece has both neighbours.
LONG_UNIT = 32
#: Score of an unknown character in a unigram lattice, below the lowest piece.
UNKNOWN_PENALTY = 10.0


# --- the model file --------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value (bytes for groups of bytes and fixed sizes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_type: int
    dummy_prefix: bool = True

    @property
    def plain(self) -> list[int]:
        """Ids of the pieces that texts may be made of."""
        return [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)]

    @property
    def byte_ids(self) -> list[int]:
        found = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        return [found.get(b, unknown) for b in range(256)]


@cache
def load(path: str) -> Vocabulary:
    """Pieces and model type of a SentencePiece model; only the identity normaliser is supported."""
    pieces, model_type, prefix = [], UNIGRAM, True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            prefix = bool(own.get(3, 1))
            if own.get(1, b"identity") != b"identity" or own.get(4, 1):
                raise ValueError("a normaliser that changes texts isn't supported")
    return Vocabulary(*map(tuple, zip(*pieces, strict=True)), model_type, prefix)


# --- units -----------------------------------------------------------------------------------------------


#: Latin letters, in ranges that the pattern compiler turns into one table.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"


@cache
def unit_pattern(vocabulary: Vocabulary) -> re.Pattern:
    """The finest of three patterns whose cuts no piece crosses; matches cover any text."""
    fine = rf"{BLANK}*[{LATIN}]+|[0-9]|{BLANK}*[^{LATIN}{BLANK}0-9]+|{BLANK}+"
    for source in (fine, rf"{BLANK}*[^{BLANK}]+|{BLANK}+"):
        pattern = re.compile(source)
        if all(pattern.fullmatch(vocabulary.pieces[i]) and len(pattern.findall(vocabulary.pieces[i])) == 1 for i in vocabulary.plain):
            return pattern
    return re.compile(r".+", re.S)


class Splitter:
    """Cuts texts into units."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.prefix = BLANK if vocabulary.dummy_prefix else ""
        self.find = unit_pattern(vocabulary).findall
        pairs = {p[i : i + 2] for j in vocabulary.plain for p in [vocabulary.pieces[j]] for i in range(len(p) - 1)}
        latin = re.compile(rf"[{LATIN}]").match

        @lru_cache(maxsize=20_000)
        def cut(unit: str) -> tuple[str, ...]:
            """Where no piece has a character and the next one, no piece crosses."""
            at = [i + 1 for i in range(len(unit) - 1) if unit[i : i + 2] not in pairs]
            return tuple(unit[i:j] for i, j in zip([0, *at], [*at, len(unit)], strict=True))

        self.cut = cut
        self.letters = {c for c in map(chr, range(0x2000)) if latin(c)}

    def text(self, text: str) -> list[str]:
        return self.marked(self.prefix + text.replace(" ", BLANK)) if text else []

    def marked(self, marked: str) -> list[str]:
        """Units of text whose blanks are marked."""
        out = self.find(marked)
        letters = self.letters
        rough = [i for i, u in enumerate(out) if len(u) > 1 and (u[-1] not in letters or len(u) > LONG_UNIT)]
        if rough:
            for i in rough:
                out[i] = self.cut(out[i])
            out = [x for u in out for x in ((u,) if isinstance(u, str) else u)]
        return out


def units_of(text: str, vocabulary: Vocabulary) -> list[str]:
    return Splitter(vocabulary).text(text)


class Words:
    """A column of texts as codes of distinct words, and the words' units, flat.

    Only texts whose blanks stand alone between words are cut that way; ``odd`` has the places of the others,
    which count as having no words here. ``counts``: words of each text; ``sizes``: units of each word.
    """

    def __init__(self, column: pa.Array, splitter: Splitter) -> None:
        plain = pc.fill_null(column, "")
        odd = pc.match_substring_regex(plain, f"^ |  | $|{BLANK}")
        if not splitter.prefix:
            odd = pa.array(np.ones(len(plain), bool))
        odd = pc.or_(odd, pc.equal(plain, ""))
        self.odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        lists = pc.split_pattern(plain.filter(pc.invert(odd)), " ")
        found = lists.flatten().dictionary_encode()
        self.codes = found.indices.to_numpy()
        self.counts = np.zeros(len(plain), np.int64)
        self.counts[~odd.to_numpy(zero_copy_only=False)] = np.diff(lists.offsets.to_numpy())
        self.units = splitter.marked(BLANK + joined(found.dictionary, BLANK)) if len(found.dictionary) else []
        # a word has one blank, at its start
        first = np.fromiter((u[0] == BLANK for u in self.units), bool, len(self.units))
        self.sizes = np.diff(np.append(np.flatnonzero(first), len(self.units)))


_splitters: dict[str, Splitter] = {}


def _splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(load(path))
    return _splitters[path]


def distinct_units(docs: DataFrame, path: str) -> DataFrame:
    """``unit, n``: every unit of the corpus and how often it occurs."""
    out = arrow_schema("unit string, n long")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        keep_freed_memory()
        splitter = _splitter(path)
        for b in gathered(batches, 0):
            column = valid(b.column(0))
            found = Words(column, splitter)
            units = pa.array(found.units, pa.string()).dictionary_encode()
            times = np.repeat(np.bincount(found.codes, minlength=len(found.sizes)), found.sizes)
            n = np.bincount(units.indices.to_numpy(), times, len(units.dictionary)).astype(np.int64)
            yield to_batch({"unit": units.dictionary, "n": pa.array(n)}, out)
            for i in found.odd:
                if own := Counter(splitter.text(column[i].as_py() or "")):
                    yield to_batch({"unit": list(own), "n": list(own.values())}, out)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "unit string, n long")
    return materialize(rows.groupBy("unit").agg(F.sum("n").alias("n")), "units")


# --- the lattice -----------------------------------------------------------------------------------------


def merges(piece: str, ranks: dict[str, int]) -> list[tuple[int, int, str]]:
    """(rank, position, result) of each merge that BPE makes in ``piece``, in order."""
    symbols = [(i, c) for i, c in enumerate(piece)]
    out = []
    while True:
        joined = ((a[1] + b[1], j) for j, (a, b) in enumerate(zip(symbols, symbols[1:])))  # noqa: B905
        best = min(((ranks[m], symbols[j][0], j, m) for m, j in joined if m in ranks), default=None)
        if best is None:
            return out
        rank, at, j, m = best
        out.append((rank, at, m))
        symbols[j : j + 2] = [(at, m)]


def merge_keys(vocabulary: Vocabulary) -> dict[str, list[int]]:
    """For each piece of a BPE model the keys of the merges that build it, its own last; position 0 is its start.

    Pieces that the model's merges can't build are missing: they are in no text's ids.
    """
    ranks = {vocabulary.pieces[i]: -vocabulary.scores[i] for i in vocabulary.plain}
    built = {p: m for p in ranks if not (m := merges(p, ranks)) or m[-1][2] == p}
    # a merge of better rank than one before it comes right after that one
    late = {p: (max(x[0] for x in m), len(m) - 1 - max(range(len(m)), key=lambda i: m[i][0])) for p, m in built.items() if m}
    late = {p: (r, after if r != ranks[p] else 0) for p, (r, after) in late.items()}
    order = {x: i for i, x in enumerate(sorted(set(late.values())))}
    if len(order) >> (BITS - POSITION_BITS - LENGTH_BITS) or max(map(len, built), default=0) >> LENGTH_BITS:
        raise ValueError("the vocabulary has too many or too long pieces")
    key = lambda at, p: (order[late[p]] << POSITION_BITS | at) << LENGTH_BITS | len(p)
    return {p: sorted(key(at, x) for _, at, x in m) for p, m in built.items() if len(p) == 1 or m}


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """``piece, score, own, inner``; as long as the vocabulary.

    own: the key of the merge that makes the piece, for BPE; inner: those of the merges before it (``merge_keys``).
    """
    if vocabulary.model_type == BPE:
        keys = merge_keys(vocabulary)
    else:
        keys = {vocabulary.pieces[i]: [] for i in vocabulary.plain}
    rows = [(p, vocabulary.scores[i], *(keys[p][-1:] or [0]), keys[p][:-1]) for i in vocabulary.plain if (p := vocabulary.pieces[i]) in keys]
    return spark.createDataFrame(rows, "piece string, score double, own long, inner array<long>")


def lattice(units: DataFrame, pieces: DataFrame, longest: int, singles: bool) -> DataFrame:
    """``unit, n, edges``: (key, i, end, score, inner) of every piece of two or more characters from position i to end.

    Single characters always are edges. They weigh nothing in a BPE lattice, which leaves them out; with ``singles``
    they are there too, and have a null score where no piece is. One edge from position 0 to 1, beyond all others
    by its key, keeps units without longer pieces. ``units`` is dealt by unit, and substrings and the broadcast join
    keep that, so the edges are grouped without a shuffle.
    """
    ends = units.select("unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("end"))
    least = F.lit(1) if singles else F.least(F.lit(2), "end")
    spans = ends.select("unit", "n", "end", F.explode(F.sequence(least, F.least(F.lit(max(longest, 2)), "end"))).alias("k"))
    i = F.col("end") - F.col("k")
    subs = spans.select("unit", "n", "end", "k", F.substring("unit", i + 1, F.col("k")).alias("piece"))
    found = subs.join(F.broadcast(pieces), "piece", "left").filter(F.col("score").isNotNull() | (F.col("k") == 1))
    key = F.when(F.col("k") == 1, F.lit(1 << BITS) + F.col("end")).otherwise(_shift(i, LENGTH_BITS) + F.col("own"))
    edge = F.struct(key.alias("key"), i.alias("i"), "end", "score", "inner")
    return found.select("unit", "n", edge.alias("edge")).groupBy("unit", "n").agg(F.collect_list("edge").alias("edges"))


def _shift(value: Column, bits: int) -> Column:
    return F.call_function("shiftleft", value.cast("long"), F.lit(bits))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def viterbi_bits(n: Column) -> Column:
    """Where the pieces of the best path end, for a BPE lattice of ``BITS`` characters and longer edges at most.

    The merges of all edges are the longer edges themselves, so the j-th least key is bit ``BITS - j``: a path's
    score is the sum of its edges' bits, and the greatest sum is the best path. The sum tells which merges
    were made, and with them the path: no piece ends within a merge.
    """
    one = F.lit(1).cast("long")
    left = lambda x, k: F.call_function("shiftleft", x, k)
    bit = lambda at: F.call_function("shiftright", F.lit(1 << BITS), at.cast("int"))

    def arcs(longer: Column, keys: Column) -> Column:
        def arc(e: Column, at: Column) -> Column:
            inner = lambda a, k: a + bit(F.array_position(keys, k + _shift(e["i"], LENGTH_BITS)))
            score = F.aggregate(e["inner"], bit(at + 1), inner)
            within = left(left(one, e["end"] - e["i"] - 1) - 1, e["i"] + 1)
            return F.struct(e["i"].alias("i"), e["end"].alias("end"), score.alias("score"), bit(at + 1).alias("own"), within.alias("within"))

        return F.transform(longer, arc)

    def best(found: Column) -> Column:
        def step(acc: Column, end: Column) -> Column:
            over = lambda m, a: F.when(a["end"] == end, F.greatest(m, F.element_at(acc, a["i"] + 1) + a["score"])).otherwise(m)
            return F.concat(acc, F.array(F.aggregate(found, F.element_at(acc, end), over)))

        return F.element_at(F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0).cast("long")), step), -1)

    def cuts(found: Column) -> Column:
        made = lambda total: F.aggregate(found, F.lit(0).cast("long"), lambda m, a: F.when(total.bitwiseAND(a["own"]) != 0, m.bitwiseOR(a["within"])).otherwise(m))
        ends = lambda inside: F.filter(F.sequence(F.lit(1), n), lambda p: inside.bitwiseAND(left(one, p)) == 0)
        return _let(best(found), lambda total: _let(made(total), ends))

    longer = F.slice(F.sort_array("edges"), F.lit(1), F.size("edges") - 1)
    return _let(longer, lambda es: _let(F.transform(es, lambda e: e["key"]), lambda keys: _let(arcs(es, keys), cuts)))


def viterbi_any(n: Column, longest: int, bpe: bool, unknown: float = 0.0) -> Column:
    """Where the pieces of the best path end, for a lattice of any size; unigram ties take the longer last piece.

    The fold goes over the edges by their ends and carries the last ``longest`` + 1 positions with the cost and the
    path to each. What all their paths begin with is settled and leaves the state, merges included.
    """
    cost = "array<bigint>" if bpe else "double"
    entry = f"struct<end:int,cost:{cost},path:array<int>>"
    state = f"struct<done:array<int>,window:array<{entry}>>"
    zero = F.array(F.lit((1 << 63) - 1)) if bpe else F.lit(0.0)
    nothing = F.array().cast("array<int>")
    start = F.struct(nothing.alias("done"), F.array(F.struct(F.lit(0).alias("end"), zero.alias("cost"), nothing.alias("path"))).alias("window")).cast(state)

    def add(before: Column, e: Column) -> Column:
        if not bpe:
            return before - F.coalesce(e["score"], F.lit(unknown))
        shift = _shift(e["i"], LENGTH_BITS)
        made = F.concat(before, F.array(e["key"]), F.transform(e["inner"], lambda k: k + shift))
        return F.when(e["key"].isNull(), before).otherwise(F.sort_array(made))

    def extend(before: Column, e: Column) -> Column:
        return F.struct(e["end"].alias("end"), add(before["cost"], e).alias("cost"), F.concat(before["path"], F.array(e["end"])).alias("path")).cast(entry)

    def settle(done: Column, window: Column) -> Column:
        def cut(x: Column, end: Column) -> Column:
            rest = x["cost"]
            if bpe:
                position = lambda k: F.call_function("shiftright", k, F.lit(LENGTH_BITS)).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
                rest = F.filter(rest, lambda k: (k == (1 << 63) - 1) | (position(k) >= end))
            return F.struct(x["end"].alias("end"), rest.alias("cost"), F.slice(x["path"], F.lit(2), F.size(x["path"])).alias("path")).cast(entry)

        def first(head: Column) -> Column:
            same = F.forall(window, lambda x: F.coalesce(F.get(x["path"], F.lit(0)) == head, F.lit(False)))
            settled = F.struct(F.concat(done, F.array(head)).alias("done"), F.transform(window, lambda x: cut(x, head)).alias("window"))
            return F.when(same, settled.cast(state)).otherwise(F.struct(done.alias("done"), window.alias("window")).cast(state))

        return _let(F.get(F.element_at(window, 1)["path"], F.lit(0)), first)

    def step(acc: Column, e: Column) -> Column:
        window = acc["window"]
        last = F.element_at(window, -1)

        def take(c: Column) -> Column:
            kept = F.slice(window, F.greatest(F.lit(1), F.size(window) - longest + 1), F.lit(longest))
            better = F.concat(F.slice(window, F.lit(1), F.size(window) - 1), F.array(c))
            same_end = F.struct(acc["done"].alias("done"), F.when(c["cost"] < last["cost"], better).otherwise(window).alias("window")).cast(state)
            return F.when(e["end"] == last["end"], same_end).otherwise(_let(F.concat(kept, F.array(c)), lambda w: settle(acc["done"], w)))

        return _let(extend(F.element_at(window, F.size(window) - (last["end"] - e["i"])), e), take)

    by_end = "array<struct<end:int,i:int,score:double,key:bigint,inner:array<bigint>>>"
    edges = F.transform("edges", lambda e: F.struct(*(e[x].alias(x) for x in ("end", "i", "score", "key", "inner")))).cast(by_end)
    if bpe:
        longer = F.filter(edges, lambda e: e["end"] - e["i"] > 1)
        no_merge = (F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("array<bigint>").alias("inner"))
        alone = F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(p.alias("end"), (p - 1).alias("i"), F.lit(0.0).alias("score"), *no_merge))
        edges = F.concat(longer, alone.cast(by_end))
    return F.aggregate(F.sort_array(edges), start, step, lambda acc: F.concat(acc["done"], F.element_at(acc["window"], -1)["path"]))


def paths(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unit, n, cuts``: where the pieces of each unit end."""
    spark = units.sparkSession
    longest = max((len(vocabulary.pieces[i]) for i in vocabulary.plain), default=1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // PART_UNITS))
    bpe = vocabulary.model_type == BPE
    found = lattice(units.repartition(parts, "unit"), piece_table(spark, vocabulary), longest, not bpe)
    n = F.length("unit")
    if bpe:
        small = (n <= BITS) & (F.size("edges") <= BITS + 1)
        cuts = F.when(small, viterbi_bits(n)).otherwise(viterbi_any(n, longest, True))
    else:
        unknown = min((vocabulary.scores[i] for i in vocabulary.plain), default=0.0) - UNKNOWN_PENALTY
        cuts = viterbi_any(n, longest, False, unknown)
    return found.select("unit", "n", cuts.alias("cuts"))


def dictionary(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unit, n, ids`` for every unit of ``units`` (unit, n); a character without a piece has the ids of its bytes."""
    schema = "unit string, n long, ids array<int>"
    arrow = arrow_schema(schema)
    of_bytes = vocabulary.byte_ids
    known = {vocabulary.pieces[i]: [i] for i in vocabulary.plain}

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        for b in batches:
            ids = []
            for u, cuts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, own = 0, []
                for end in cuts:
                    p = u[at:end]
                    own += known.get(p) or [of_bytes[x] for x in p.encode()]
                    at = end
                ids.append(own)
            yield to_batch({"unit": b.column(0), "n": b.column(1), "ids": ids}, arrow)

    return paths(units, vocabulary).mapInArrow(name, schema)


# --- encoding and decoding whole texts -------------------------------------------------------------------


class Head:
    """Dictionary entries, mapped from a file: sorted digests, ends and ids. Digests that units share aren't in it."""

    def __init__(self, source: str | bytes) -> None:
        data = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        n, width = (int(x) for x in data[:16].view("<i8"))
        self.digests = data[16 : 16 + 8 * n].view("<i8")
        at = 16 + 8 * n
        self.ends = data[at : at + 4 * n + 8].view("<i4")
        self.ids = data[at + 4 * n + 8 :]
        #: an entry for each digest, then an empty one
        self.entries = pa.BinaryArray.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)])
        self.dtype = np.dtype(f"<u{width}")

    @staticmethod
    def pack(digests: np.ndarray, ids: pa.BinaryArray, width: int) -> Iterator[bytes]:
        order = np.argsort(digests, kind="stable")
        yield np.array([len(order), width], "<i8").tobytes()
        yield digests[order].astype("<i8").tobytes()
        ids = ids.take(pa.array(order))
        at = ids.offsets.to_numpy() if hasattr(ids, "offsets") else np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
        yield np.append(at - at[0], at[-1] - at[0]).astype("<i4").tobytes()
        yield ids.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(ids) else b""

    def find(self, units: Collection[str]) -> np.ndarray:
        """Place of each unit's entry; the place after the last, which is empty, for those that are missing."""
        import xxhash

        digest, none = xxhash.xxh64_intdigest, len(self.digests)
        d = np.fromiter((digest(u.encode(), 42) for u in units), np.uint64, len(units)).view(np.int64)
        if not none:
            return np.zeros(len(units), np.int64)
        by = np.argsort(d)  # neighbours in the file after each other
        at = np.empty(len(d), np.int64)
        at[by] = np.minimum(np.searchsorted(self.digests, d[by]), none - 1)
        return np.where(self.digests[at] == d, at, none)

    def one(self, place: int) -> bytes:
        return self.ids[self.ends[place] : self.ends[place + 1]].tobytes()


def publish_head(words: DataFrame, head_bytes: int, n_ids: int) -> tuple[str, bool]:
    """Publish the most frequent entries that fit ``head_bytes``; the file's name, and whether it has all entries.

    Ranks of counts come from a histogram of logarithmic buckets, whose number does not grow.
    """
    spark = words.sparkSession
    width = 2 if n_ids <= 1 << 16 else 4
    bucket = F.floor(F.log2(F.col("n")) * 4)
    rows = words.groupBy(bucket.alias("b")).agg(F.sum(20 + width * F.size("ids")).alias("bytes"), F.min("n").alias("n")).collect()
    least, used, whole = 1 << 62, 0, True
    for r in sorted(rows, key=lambda r: -r["b"]):
        used += r["bytes"]
        if used > head_bytes:
            whole = False
            break
        least = r["n"]
    keyed = words.select(F.xxhash64("unit").alias("d"), "n", "ids")
    shared = keyed.groupBy("d").agg(F.count("*").alias("c")).filter("c > 1").select("d")
    picked = keyed.filter(F.col("n") >= least)
    if not shared.isEmpty():
        picked, whole = picked.join(shared, "d", "left_anti"), False
    schema = "d long, ids binary"
    arrow = arrow_schema(schema)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(f"<u{width}").tobytes()
            at = ((ids.offsets.to_numpy() - ids.offsets[0].as_py()) * width).astype(np.int32)
            yield to_batch({"d": b.column(0), "ids": pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(flat)])}, arrow)

    got = picked.select("d", "ids").mapInArrow(narrow, schema).toArrow()  # head_bytes at most
    ids = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.binary())
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    return publish(spark, Head.pack(got.column("d").to_numpy().astype(np.int64), ids, width), "pieces"), whole


class Decoder:
    """Bytes of ids; a whole batch at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.prefix = vocabulary.dummy_prefix
        self.bytes = pa.array(
            [
                bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(BLANK, " ").encode()
                for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
            ],
            pa.binary(),
        )

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive ids that end at ``ends``; the blank that encoding puts first goes again."""
        joined = self.bytes.take(pa.array(ids.astype(np.int32)))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int32)[np.concatenate(([0], ends))].tolist() if len(ids) else [0] * (len(ends) + 1)
        data = memoryview(data) if data is not None else memoryview(b"")
        texts = [str(data[s:e], "utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


#: What a batch of texts gives: ids of all, the ends of each text's, the decoded texts.
Derived = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, list[str]], dict]


def _everything(b: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, decoded: list[str]) -> dict:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
    return {"doc_id": b.column(0), "th": b.column(1), "text": b.column(2), "n_tokens": np.diff(ends, prepend=0), "ids": lists, "decoded": decoded}


ENCODED = "doc_id long, th long, text string, n_tokens long, ids array<int>, decoded string"


def encode_decode(docs: DataFrame, path: str, head_bytes: int = HEAD_BYTES, columns: Derived = _everything, schema: str = ENCODED) -> DataFrame:
    """``doc_id, th, text, n_tokens, ids, decoded`` for every row of ``docs`` (doc_id, text); th is a hash of the text.

    ids are those of the model's own encoder without special ids; decoded is the text made from them again: the
    text itself, but for U+2581, which stands for a blank. Null and empty texts have no ids and decode to an
    empty text. Repeated rows get a row each. Empty table: no rows. Other columns are not read. Texts of any
    length are used whole; the edges of one unit (a run of letters, say) are gathered in one task. ``columns``
    and ``schema`` have other columns derived from a batch's ids and decoded texts where they are made.
    """
    spark = docs.sparkSession
    vocabulary = load(path)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    # edges are grouped by sorting, which holds less than two hash tables of lists; many small parts a task, one by one
    with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        found = dictionary(distinct_units(picked, path), vocabulary).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
        words = materialize(found, "piece-dictionary")
    name, whole = publish_head(words, head_bytes, len(vocabulary.pieces))
    if whole:
        picked = picked.select("*", F.lit(None).cast("array<string>").alias("units"), F.lit(None).cast("array<array<int>>").alias("unit_ids"))
    else:
        missing = picked.mapInArrow(_missing(path, name), "doc_id long, th long, unit string").distinct()
        pairs = missing.join(words.select("unit", "ids"), "unit").groupBy("doc_id", "th")
        tail_rows = pairs.agg(F.collect_list(F.struct("unit", "ids")).alias("own")).withColumnsRenamed({"doc_id": "__millrace_id", "th": "__millrace_th"})
        picked = picked.join(tail_rows, F.col("doc_id").eqNullSafe(F.col("__millrace_id")) & (F.col("th") == F.col("__millrace_th")), "left").select(
            "doc_id", "th", "text", F.col("own.unit").alias("units"), F.col("own.ids").alias("unit_ids")
        )
    arrow = arrow_schema(schema)

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        keep_freed_memory()
        book, decoder = _book(path, name), Decoder(load(path))
        for b in gathered(batches, 2):
            own = [dict(zip(u, i, strict=True)) if u else {} for u, i in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            ids, ends = book.encode(valid(b.column(2)), own)
            yield to_batch(columns(b, ids, ends, decoder.decode(ids, ends)), arrow)

    small_batches(spark)
    return picked.mapInArrow(encode, schema)


_books: dict[tuple[str, str], _Book] = {}


def _book(path: str, name: str) -> _Book:
    if (path, name) not in _books:
        _books.clear()
        _books[path, name] = _Book(path, Head(SparkFiles.get(name)))
    return _books[path, name]


class _Book:
    """Ids of texts from the head."""

    def __init__(self, path: str, head: Head) -> None:
        self.splitter = _splitter(path)
        self.head = head

    def words(self, found: Words) -> tuple[pa.Array, np.ndarray]:
        """Ids, as bytes, of each word, and whether the head lacks one of its units."""
        distinct = {u: i for i, u in enumerate(dict.fromkeys(found.units))}
        at = self.head.find(distinct)[np.fromiter(map(distinct.__getitem__, found.units), np.int64, len(found.units))]
        flat = self.head.entries.take(pa.array(at)).cast(pa.large_binary())
        firsts = np.cumsum(found.sizes) - found.sizes
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(firsts), [None, pa.py_buffer(np.append(ends[firsts], ends[-1])), flat.buffers()[2]]
        )
        gone = at == len(self.head.digests)
        return words, np.add.reduceat(gone, firsts) > 0 if len(firsts) else np.zeros(0, bool)

    def encode(self, column: pa.Array, own: list[dict[str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each text's end."""
        found = Words(column, self.splitter)
        words, gone = self.words(found)
        dtype = self.head.dtype
        odd = {*found.odd, *_rows(found, gone[found.codes]).tolist()}
        flat = words.take(pa.array(found.codes))
        _, ends, data = flat.buffers()
        data = memoryview(data) if data is not None else memoryview(b"")
        upto = np.frombuffer(ends, np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        ends = np.cumsum(found.counts)
        starts = ends - found.counts
        if not odd:
            return np.frombuffer(data[: upto[-1]], dtype), upto[ends] // dtype.itemsize
        parts = [data[s:e] for s, e in zip(upto[starts].tolist(), upto[ends].tolist(), strict=True)]
        for i in odd:
            parts[i] = self.whole(column[i].as_py() or "", own[i], dtype)
        lengths = np.array([len(p) for p in parts], np.int64) // dtype.itemsize
        return np.frombuffer(b"".join(parts), dtype), np.cumsum(lengths)

    def whole(self, text: str, own: dict[str, list[int]], dtype: np.dtype) -> bytes:
        """Ids of a text whose blanks or rare units need more care; ``own`` has the units that the head lacks."""
        units = self.splitter.text(text)
        names = list(set(units) - own.keys())
        found = {u: self.head.one(at) for u, at in zip(names, self.head.find(names).tolist(), strict=True)}
        found |= {u: np.array(x, dtype).tobytes() for u, x in own.items()}
        return b"".join([found[u] for u in units])


def _rows(found: Words, hit: np.ndarray) -> np.ndarray:
    """Texts of the words that are hit, one for each."""
    return np.repeat(np.arange(len(found.counts)), found.counts)[hit]


def _missing(path: str, name: str):
    arrow = arrow_schema("doc_id long, th long, unit string")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        book = _book(path, name)
        none = len(book.head.digests)
        for b in gathered(batches, 2):
            column = valid(b.column(2))
            found = Words(column, book.splitter)
            _, gone = book.words(found)
            firsts = np.cumsum(found.sizes) - found.sizes
            rare: dict[int, list[str]] = {}
            for w in np.flatnonzero(gone).tolist():
                units = found.units[firsts[w] : firsts[w] + found.sizes[w]]
                rare[w] = [u for u, at in zip(units, book.head.find(units).tolist(), strict=True) if at == none]
            own: dict[int, set[str]] = {}
            hit = gone[found.codes]
            for i, w in zip(_rows(found, hit).tolist(), found.codes[hit].tolist(), strict=True):
                own.setdefault(i, set()).update(rare[w])
            for i in found.odd:
                units = list(set(book.splitter.text(column[i].as_py() or "")))
                own[i] = {u for u, at in zip(units, book.head.find(units).tolist(), strict=True) if at == none}
            out: dict[str, list] = {"doc_id": [], "th": [], "unit": []}
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, units in own.items():
                out["doc_id"] += [ids[i]] * len(units)
                out["th"] += [hashes[i]] * len(units)
                out["unit"] += units
            yield to_batch(out, arrow)

    return run


def _digests(b: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, decoded: list[str]) -> dict:
    from hashlib import sha256

    flat = ids.astype("<u4")
    at = np.concatenate(([0], ends)).tolist()
    return {
        "doc_id": b.column(0), "n_tokens": np.diff(ends, prepend=0),
        "ids_crc32": [zlib.crc32(flat[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)],
        "decoded_sha256": [sha256(x.encode()).hexdigest() for x in decoded],
        "round_trip": [x.encode() == y for x, y in zip(decoded, raw(b.column(2)), strict=True)],
    }


def op7(documents: DataFrame, path: str) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return encode_decode(documents, path, columns=_digests, schema=schema)
