"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the hashed terms present in a text: its words and
their beginnings of four and five characters. The pairwise part, through low-rank factors, learns what single
weights miss, such as an insult beside the mention of a group. Trained on the driver from a bounded sample of
labelled rows (``SAMPLE``); scoring is one pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, map_arrow, raw

HASH_BITS = 18
RANK = 8
#: Labelled rows that the model is fitted to, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: A term needs so many of the training rows to count.
SUPPORT = 5
#: ... and to go with the label, or against it, by so much (1 in 1,000 terms does by chance).
CHI_SQUARE = 10.83
EPOCHS = 8
#: Few rows are gone over more often, for about so many batches.
STEPS = 400
THRESHOLD = 0.7
PREFIXES = (4, 5)
CACHE = 100_000


def _is_word(c: int) -> bool:
    return 48 <= c <= 57 or 97 <= c <= 122 or c >= 128


NORMAL = bytes(c if _is_word(c) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_young: dict[bytes, np.ndarray] = {}
_old: dict[bytes, np.ndarray] = {}


def _forget() -> None:
    _young.clear()
    _old.clear()


cached(__name__, _forget)


def _word_terms(word: bytes) -> np.ndarray:
    """Hashed ids of a word and its beginnings."""
    global _young, _old
    found = _old.get(word)
    if found is None:
        import xxhash

        s = word.decode("utf-8", "replace")
        terms = [b"w:" + word, *(f"{n}:{s[:n]}".encode() for n in PREFIXES if len(s) >= n)]
        found = np.array([xxhash.xxh32_intdigest(t) & ((1 << HASH_BITS) - 1) for t in terms], np.int32)
    if len(_young) >= CACHE:
        _old, _young = _young, {}
    _young[word] = found
    return found


def terms(text: bytes) -> np.ndarray:
    """Sorted distinct hashed terms of a UTF-8 text."""
    words = set(text.translate(NORMAL).split())
    if not words:
        return np.zeros(0, np.int32)
    get = _young.get
    return np.unique(np.concatenate([x if (x := get(w)) is not None else _word_terms(w) for w in words]))


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # of each kept term; the last is for terms that aren't kept, zero
    factors: np.ndarray
    row: np.ndarray  # hashed id -> row of weights and factors

    def score(self, ids: np.ndarray) -> float:
        r = self.row[ids]
        s = self.factors[r]
        total = s.sum(axis=0)
        z = self.bias + self.weights[r].sum() + 0.5 * float((total * total).sum() - (s * s).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _chi_square(rows: list[np.ndarray], labels: np.ndarray, support: np.ndarray) -> np.ndarray:
    """How strongly each term's presence goes with the label."""
    n, toxic = len(rows), float(labels.sum())
    both = np.zeros(len(support))
    for r, y in zip(rows, labels, strict=True):
        if y:
            both[r] += 1
    rest = support * (n - support.astype(np.float64)) * toxic * (n - toxic)
    return np.where(rest > 0, n * (both * n - support * toxic) ** 2 / np.maximum(rest, 1), 0)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adagrad on log loss, in small batches."""
    n = 1 << HASH_BITS
    if not len(rows):
        return Model(-5.0, np.zeros(1, np.float32), np.zeros((1, RANK), np.float32), np.zeros(n, np.int32))
    support = np.bincount(np.concatenate(rows), minlength=n) if sum(map(len, rows)) else np.zeros(n, np.int64)
    kept = np.flatnonzero((support >= SUPPORT) & (_chi_square(rows, labels, support) >= CHI_SQUARE))
    row = np.full(n, len(kept), np.int32)
    row[kept] = np.arange(len(kept))
    rows = [x[x < len(kept)] for x in (row[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept) + 1), rng.normal(0, 0.01, (len(kept) + 1, RANK))
    v[-1] = 0
    gw, gv = np.full(len(w), 1e-4), np.full(v.shape, 1e-2)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    bias, gb = float(np.log(rate / (1 - rate))), 1e-2
    y = labels.astype(np.float64)
    for _ in range(max(epochs, STEPS * 128 // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            size = np.array([len(rows[i]) for i in batch])
            f = np.concatenate([rows[i] for i in batch])
            d = np.repeat(np.arange(len(batch)), size)
            vf = v[f]
            sums = np.stack([np.bincount(d, vf[:, k], len(batch)) for k in range(RANK)], axis=1)
            squares = np.bincount(d, (vf * vf).sum(axis=1), len(batch))
            z = bias + np.bincount(d, w[f], len(batch)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[batch]) / len(batch)
            u, inverse = np.unique(f, return_inverse=True)
            dw = np.bincount(inverse, g[d], len(u)) + 1e-6 * w[u]
            dv = np.stack([np.bincount(inverse, g[d] * (sums[d, k] - vf[:, k]), len(u)) for k in range(RANK)], axis=1) + 1e-5 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += g.sum() ** 2
            w[u] -= 0.15 * dw / np.sqrt(gw[u])
            v[u] -= 0.02 * dv / np.sqrt(gv[u])
            bias -= 0.05 * g.sum() / np.sqrt(gb)
    w[-1], v[-1] = 0, 0
    return Model(bias, w.astype(np.float32), v.astype(np.float32), row)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = picked.join(F.broadcast(marked), "doc_id").select("toxic", "text", "doc_id")  # ``sample`` rows of two numbers

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(2), "toxic": b.column(0), "ids": [terms(x).astype("<i4").tobytes() for x in raw(b.column(1))]}

    got = map_arrow(rows, run, "doc_id long, toxic int, ids binary").toArrow().to_pylist()
    seen: set[int] = set()
    got = [r for r in sorted(got, key=lambda r: (r["doc_id"], r["ids"])) if not (r["doc_id"] in seen or seen.add(r["doc_id"]))]
    return fit([np.frombuffer(r["ids"], "<i4") for r in got], np.array([r["toxic"] for r in got]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, th, held_out, score, predicted`` for every row of ``docs``; th is a hash of the text.

    Only the text is an input of a score. Null and empty texts score as a text without terms. Repeated rows get
    a row each and the same score. Null labels are skipped; a doc_id labelled twice is toxic if one label says
    so. Without any label no text is toxic. Empty table: no rows. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # 2**18 terms at most
    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), held_out().alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )

    def run(b: pa.RecordBatch) -> dict:
        m = model.value
        s = np.array([m.score(terms(x)) for x in raw(b.column(3))])
        return {"doc_id": b.column(0), "th": b.column(1), "held_out": b.column(2), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_arrow(picked, run, "doc_id long, th long, held_out boolean, score double, predicted int")


def op8(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, labels).select("doc_id", "held_out", "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""
    toxic = score(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("__millrace_id"), F.col("th").alias("__millrace_th")).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__millrace_id")) & (F.xxhash64("text") == F.col("__millrace_th"))
    return docs.join(toxic, match, "left_anti")
