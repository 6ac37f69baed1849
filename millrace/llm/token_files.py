"""Token-ID files: canonical length-limited Huffman code, decoded by table in independent blocks.

A file is a folder of two Parquet tables, so that any store Spark can write to will do: ``codebook``
(symbol, length) and ``frames``. A frame holds whole documents in ascending order: their ids and token counts,
the bit offset of every block of ``BLOCK`` tokens, and the code bits. Codes follow from the lengths alone
(canonical), lengths are optimal under ``MAX_LEN`` (package-merge) for the counts of the whole corpus. A block
can be decoded from its bit offset without the ones before it; all blocks of a frame are decoded in lockstep.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cached, forget_others, gathered, joined, keep_freed_memory, materialize, scratch_path, small_batches, to_batch, valid

MAX_LEN = 20
BLOCK = 512
#: A frame is closed at so many tokens; one document is never split.
FRAME = 1 << 19
END_ID = 2
#: Cached words in each of two generations, per Python worker, and the bytes of ids that one may have.
CACHE, CACHED_BYTES = 300_000, 64

# --- the code --------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Optimal code lengths of at most ``max_len`` bits by package-merge; 0 for symbols that don't occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_len:
        raise ValueError(f"{n} symbols don't fit codes of {max_len} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    packages = np.zeros(0)
    levels = []
    for _ in range(max_len):
        items = np.concatenate((coins, packages))
        by = np.argsort(items, kind="stable")
        levels.append(by < n)
        items = items[by]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for coin in reversed(levels):
        k = int(coin[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """For each window of ``max_len`` bits: symbol * 32 + length."""
    codes = canonical(lengths)
    table = np.zeros(1 << max_len, np.uint32)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        at = int(codes[s]) << (max_len - n)
        table[at : at + (1 << (max_len - n))] = (int(s) << 5) | n
    return table


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids`` and the bit offset of every block."""
    n, c = lengths[ids], codes[ids]
    if len(ids) & 1:
        n, c = np.append(n, 0), np.append(c, np.uint64(0))
    if not len(ids):
        return bytes(16), np.zeros(0, np.int64)
    # two codes at a time, put into words of 64 bits
    value = (c[::2] << n[1::2].astype(np.uint64)) | c[1::2]
    n = n[::2] + n[1::2]
    ends = np.cumsum(n)
    starts = ends - n
    word, room = starts >> 6, 64 - (starts & 63) - n
    over = room < 0
    high = np.where(over, value >> (-room).clip(0).astype(np.uint64), value << room.clip(0).astype(np.uint64))
    words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)  # one code at most crosses into a word
    return words.astype(">u8").tobytes(), starts[:: BLOCK // 2].astype(np.int64)


def unpack(data: bytes, offsets: np.ndarray, n_tokens: int, table: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """``n_tokens`` symbols of consecutive blocks that begin at bit ``offsets``."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    pos = offsets.astype(np.int64).copy()
    out = np.zeros((BLOCK, len(pos)), np.uint32)
    last = n_tokens - BLOCK * (len(pos) - 1)
    mask, shift = np.uint32((1 << max_len) - 1), 32 - max_len
    for i in range(BLOCK):
        if i == last:
            pos = pos[:-1]
        if not len(pos):
            break
        e = table[(window[pos >> 3] >> (shift - (pos & 7)).astype(np.uint32)) & mask]
        out[i, : len(pos)] = e >> 5
        pos = pos + (e & 31)
    return out.T.ravel()[:n_tokens]


# --- encoding text ---------------------------------------------------------------------------------------

#: A blank that stands at an end of the text or beside other white space; elsewhere no pre-token spans its front.
_ODD = r"^$|^ | $|[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Distinct words that go to the library as one text.
GROUP = 200


class BatchEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, each distinct word of a batch once.

    A text is cut before each blank: where a blank stands alone between other characters, no pre-token and no
    added token spans its front, so the words' ids joined are the ids of the whole. Words go to the library many at
    a time, each with its blank; the tokens that begin with a blank tell them apart again. Texts with other blanks,
    and all texts of a tokenizer that isn't of this kind, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        own = json.loads(self.tok.to_str())
        cut = own["pre_tokenizer"] or {}
        self.cuts = (
            own["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not own["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in own["added_tokens"])
        )
        # byte 32 is written as U+0120 in such vocabularies
        self.begins = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H" if self.dtype == "<u2" else "I", e.ids).tobytes() for e in found]

    def words(self, words: list[str], often: list[bool]) -> list[bytes]:
        """Ids, as bytes, of words that follow a blank; those that a batch has often are kept for the next."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        new = []
        for i, x in enumerate(out):
            if x is None:
                if (x := old.get(words[i])) is not None:
                    out[i] = young[words[i]] = x
                else:
                    new.append(i)
        width = np.dtype(self.dtype).itemsize
        for at in range(0, len(new), 100 * GROUP):
            groups = [new[k : k + GROUP] for k in range(at, min(at + 100 * GROUP, len(new)), GROUP)]
            for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                first = np.flatnonzero(self.begins[ids])
                data = ids.tobytes()
                for i, s, t in zip(group, (first * width).tolist(), np.append(first[1:] * width, len(data)).tolist(), strict=True):
                    out[i] = data[s:t]
                    if often[i] and t - s <= CACHED_BYTES:
                        young[words[i]] = out[i]
            if len(young) > CACHE:
                self.old, self.young = young, {}
                young, old = self.young, self.old
        return out

    def encode(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and where each text's end."""
        plain = pc.fill_null(column, "")
        n = len(plain)
        odd = pc.match_substring_regex(plain, _ODD).to_numpy(zero_copy_only=False) if self.cuts else np.ones(n, bool)
        even = ~odd
        lists = pc.split_pattern(plain.filter(pa.array(even)), " ")
        found = lists.flatten().dictionary_encode()
        codes = found.indices.to_numpy()
        counts = np.ones(n, np.int64)
        counts[even] = np.diff(lists.offsets.to_numpy())
        names = joined(found.dictionary, " ").split(" ") if len(found.dictionary) else []
        known = self.words(names, (np.bincount(codes, minlength=len(names)) > 1).tolist())
        # the first word of a text has no blank
        at = (np.cumsum(counts[even]) - counts[even]).astype(np.int64)
        known += self.whole([names[c] for c in codes[at].tolist()])
        known += self.whole(plain.filter(pa.array(odd)).to_pylist())
        ends = np.cumsum(counts + 1)
        starts = ends - counts - 1
        order = np.full(int(ends[-1]) if n else 0, len(known), np.int64)
        is_word = np.ones(len(order), bool)
        is_word[ends - 1] = False
        is_word[starts[odd]] = False
        order[is_word] = codes
        order[starts[even]] = len(names) + np.arange(len(at))
        order[starts[odd]] = len(names) + len(at) + np.arange(int(odd.sum()))
        flat = pa.array([*known, end], pa.large_binary()).take(pa.array(order))
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        upto = np.frombuffer(flat.buffers()[1], np.int64)
        data = memoryview(flat.buffers()[2] or b"")[: upto[len(flat)]]
        return np.frombuffer(data, self.dtype), upto[ends] // np.dtype(self.dtype).itemsize


_encoders: dict[str, BatchEncoder] = {}
cached(__name__, _encoders.clear)


def encoder(path: str) -> BatchEncoder:
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


# --- writing and reading ---------------------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending doc_id order.

    Null texts count as empty; every document ends with ``end_id``. Null doc_ids come first; rows that repeat a
    doc_id follow each other in the order of their texts' hashes. Other columns are not read. An empty table
    gives a codebook and frames without rows.
    """
    spark = docs.sparkSession
    tokens = arrow_schema("kind int, doc_id long, th long, ids binary")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        counts = np.zeros(max(enc.tok.get_vocab_size(), end_id + 1), np.int64)
        keep_freed_memory()
        width = np.dtype(enc.dtype).itemsize
        for b in gathered(batches, 2):
            ids, ends = enc.encode(valid(b.column(2)), end)
            counts += np.bincount(ids, minlength=len(counts))
            at = pa.py_buffer((np.concatenate(([0], ends)) * width).astype(np.int32))
            rows = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, at, pa.py_buffer(ids.tobytes())])
            yield to_batch({"kind": np.zeros(b.num_rows, np.int32), "doc_id": b.column(0), "th": b.column(1), "ids": rows}, tokens)
        # one more row for each task: its counts
        yield to_batch({"kind": [1], "doc_id": [None], "th": [None], "ids": [counts.astype("<i8").tobytes()]}, tokens)

    small_batches(spark)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    wide = materialize(picked.mapInArrow(tokenise, "kind int, doc_id long, th long, ids binary"), "token-ids")
    per_task = arrow_schema("symbol int, n long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                n = np.frombuffer(x, "<i8")
                total = n if total is None else total + n
        if total is not None:
            used = np.flatnonzero(total)
            yield to_batch({"symbol": used.astype(np.int32), "n": total[used]}, per_task)

    counted = wide.filter("kind = 1").select("ids").mapInArrow(sums, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([r["symbol"] for r in counted], default=0), np.int64)  # as long as the vocabulary at most
    for r in counted:
        counts[r["symbol"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    book = [(int(s), int(lengths[s])) for s in used]
    spark.createDataFrame(book, "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    schema = "part int, first long, n_tokens long, doc_ids array<long>, counts array<int>, offsets array<long>, bits binary"
    frames = arrow_schema(schema)
    dtype = encoder(tokenizer).dtype

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        part, first = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, size, first
            n = [len(x) // np.dtype(dtype).itemsize for x in ids]
            bits, offsets = pack(np.frombuffer(b"".join(ids), dtype).astype(np.int64), lengths, codes)
            row = {"part": [part], "first": [first], "n_tokens": [sum(n)], "doc_ids": [doc_ids], "counts": [n], "offsets": [offsets.tolist()], "bits": [bits]}
            first += sum(n)
            ids, doc_ids, size = [], [], 0
            return to_batch(row, frames)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(x)
                doc_ids.append(i)
                size += len(x)
                if size >= FRAME * np.dtype(dtype).itemsize:
                    yield close()
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    rows = wide.filter("kind = 0").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    rows.mapInArrow(frame, schema).write.parquet(f"{path}/frames")


def read_ids(spark: SparkSession, path: str, columns: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``columns(ids)`` makes of each document's ids (``schema`` for both)."""
    frames = spark.read.parquet(f"{path}/frames")
    totals = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each written partition
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(1 + max([r["symbol"] for r in book], default=0), np.int64)
    for r in book:
        lengths[r["symbol"]] = r["length"]
    shared = spark.sparkContext.broadcast((lengths, base))
    full = f"doc_id long, start long, n_tokens long, {schema}"
    arrow = arrow_schema(full)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, base = shared.value
        table = decode_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["bits"], np.array(r["offsets"], np.int64), r["n_tokens"], table)
                n = np.array(r["counts"], np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                more = [columns(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": r["doc_ids"], "start": starts + (base[r["part"]] + r["first"]), "n_tokens": n}
                yield to_batch(out | {k: [m[k] for m in more] for k in more[0]}, arrow)

    small_batches(spark)
    return frames.select("part", "first", "n_tokens", "doc_ids", "counts", "offsets", "bits").mapInArrow(decode, full)


def checksum(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def op1(documents: DataFrame, tokenizer: str) -> DataFrame:
    spark = documents.sparkSession
    path = scratch_path(spark, "token-file")
    write_ids(documents, tokenizer, path)
    return read_ids(spark, path, checksum, "ids_crc32 long")
