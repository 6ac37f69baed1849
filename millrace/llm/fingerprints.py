"""Document fingerprints by consistent weighted sampling.

Terms are pairs of adjacent words (the text's beginning and end count as words), weighted by their counts.
Sample k of a text is the term with the least gamma-based hash value ``ln a`` and the level of its weight there:
two texts agree on a sample with a chance equal to their generalised Jaccard similarity
sum(min(weights)) / sum(max(weights)). The gamma and uniform variates of a term are rows of fixed tables, chosen
by two independent hashes of the term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, small_batches, texts, to_batch

SAMPLES = 128
TABLE_ROWS = 1 << 15
#: Terms weighed at once: bounds memory for very long texts.
CHUNK = 1024
CACHE = 200_000
#: Ranges of doc_id for each shuffle partition; a range is one group of neighbours, walked in one task.
RANGES = 8


@dataclass
class Variates:
    """Per table row and sample: ln c, and r and beta, with the value ln a - ln c for a weight of one."""

    ln_c: np.ndarray
    r: np.ndarray
    beta: np.ndarray
    at_one: np.ndarray


def variates(samples: int = SAMPLES, seed: int = 1) -> Variates:
    rng = np.random.default_rng(seed)
    shape = (TABLE_ROWS, samples)
    ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    r = np.maximum(rng.gamma(2.0, 1.0, shape), 1e-6).astype(np.float32)
    beta = rng.random(shape, np.float32)
    return Variates(ln_c, r, beta, r * (beta - 1))


class Sampler:
    def __init__(self, samples: int = SAMPLES) -> None:
        self.v = variates(samples)
        # results go to buffers that are there already: fresh arrays of this size cost page faults
        self.value, self.other = np.empty((2, CHUNK, samples), np.float32)
        self.equal = np.empty((CHUNK, samples), bool)
        self.mix = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, w: str) -> int:
        found = self.old.get(w)
        if found is None:
            import xxhash

            found = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[w] = found
        return found

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct word pairs of a text, and their counts."""
        words = text.lower().split()
        get = self.young.get
        h = np.empty(len(words) + 2, np.uint64)
        h[0], h[-1] = 1, 2
        h[1:-1] = [x if (x := get(w)) is not None else self.word(w) for w in words]
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs ^= pairs >> np.uint64(31)
        return np.unique(pairs, return_counts=True)

    def signature(self, text: str) -> np.ndarray:
        """One 16-bit value for each sample."""
        t, counts = self.terms(text)
        mixed = t * np.uint64(0x94D049BB133111EB)
        i = (mixed >> np.uint64(49)).astype(np.int64)
        j = ((mixed >> np.uint64(30)) & np.uint64(TABLE_ROWS - 1)).astype(np.int64)
        v = self.v
        best = np.full(v.ln_c.shape[1], np.inf, np.float32)
        who = np.zeros(len(best), np.int64)
        level = np.zeros(len(best), np.int64)
        for at in range(0, len(t), CHUNK):
            s = slice(at, at + CHUNK)
            n = len(t[s])
            value = np.take(v.ln_c, i[s], axis=0, out=self.value[:n], mode="clip")
            value += np.take(v.at_one, j[s], axis=0, out=self.other[:n], mode="clip")
            more = np.flatnonzero(counts[s] > 1)
            y = None
            if len(more):
                jj = j[s][more]
                r, beta = v.r[jj], v.beta[jj]
                y = np.floor(np.log(counts[s][more]).astype(np.float32)[:, None] / r + beta)
                value[more] = v.ln_c[i[s][more]] - r * (y - beta + 1)
            least = value.min(axis=0)
            row, column = np.nonzero(np.equal(value, least, out=self.equal[:n]))
            k = np.empty(len(best), np.int64)
            k[column[::-1]] = row[::-1]  # the first of ties
            new = least < best
            best[new] = least[new]
            who[new] = k[new] + at
            if y is not None:
                row = np.full(n, -1)
                row[more] = np.arange(len(more))
                got = row[k]
                lv = np.where(got >= 0, y[got, np.arange(len(best))], 0).astype(np.int64)
            else:
                lv = np.zeros(len(best), np.int64)
            level[new] = lv[new]
        x = (t[who] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) + self.mix
        x ^= x >> np.uint64(33)
        return (x * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_samplers: list[Sampler] = []


def sampler() -> Sampler:
    if not _samplers:
        _samplers.append(Sampler())
    return _samplers[0]


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows ``part, extra, ord, doc_id, text``: sorted by (part, extra, ord descending), each row's successor is
    the next document in descending doc_id.

    Ids are cut into ranges of about equal size by approximate quantiles. The first document of each range is
    also dealt, marked ``extra``, to the range before it (that of the first range to the last), so that no
    order over the whole table is needed. Null ids come last.
    """
    ranges = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_x", F.col("ord").cast("double"))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("_x", F.array(*map(F.lit, probs)), 10 * ranges)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_x", outputCol="_part").transform(rows) if len(splits) > 2 else rows.withColumn("_part", F.lit(0.0))
    rows = rows.withColumn("part", F.col("_part").cast("int")).drop("_x", "_part")
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("ord").alias("head")).collect()}  # ``ranges`` rows at most
    down = sorted(heads, reverse=True)
    to = [(p, heads[p], down[i - 1]) for i, p in enumerate(down)]
    spark = docs.sparkSession
    head = F.broadcast(spark.createDataFrame(to, "part int, head long, receiver int"))
    dealt = F.array(
        F.struct(F.col("part"), F.lit(0).alias("extra")),
        F.when(F.col("ord") == F.col("head"), F.struct(F.col("receiver").alias("part"), F.lit(1).alias("extra"))),
    )
    placed = rows.join(head, "part").select(F.explode(F.filter(dealt, lambda x: x.isNotNull())).alias("d"), "ord", "doc_id", "text")
    placed = placed.select("d.part", "d.extra", "ord", "doc_id", "text")
    return placed.repartition("part").sortWithinPartitions("part", "extra", F.col("ord").desc(), "text")


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Null texts count as empty. Order: descending doc_id, then text; null ids last; after the last comes the
    first, so a single document is its own successor. Rows that repeat a doc_id each get a row. Empty table: no
    rows. Other columns are not read. Texts of any length are used whole.
    """
    arrow = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler()
        held: tuple[int, int, int | None, str, np.ndarray] | None = None
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for part, extra, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), texts(b.column(4)), strict=True):
                if extra and held is not None and held[0] == part and held[1]:
                    continue  # a further row of the successor's doc_id
                sig = s.signature(text)
                if held is not None and held[0] == part and not held[1]:
                    _, _, own, before, own_sig = held
                    new = edited(before, text)
                    new_sig = s.signature(new)
                    out["doc_id"].append(own)
                    out["n_chars"].append(len(before))
                    out["edited_sha256"].append(sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
                    out["fingerprint"].append(to_hex(own_sig))
                    out["edited_fingerprint"].append(to_hex(new_sig))
                    out["near_edited"].append(likeness(own_sig, new_sig))
                    out["near_next"].append(likeness(own_sig, sig))
                held = (part, extra, doc_id, text, sig)
            if out["n_chars"]:
                yield to_batch(out, arrow)

    small_batches(docs.sparkSession)
    return neighbours(docs).mapInArrow(run, _SCHEMA)


def op5(documents: DataFrame) -> DataFrame:
    return fingerprint_edits(documents)
