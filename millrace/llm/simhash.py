"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``tau`` bits differ. The bits are dealt to partitions, correlated
bits together, so that the other partitions tell texts apart better. Thresholds ``t_i`` with
``sum(t_i + 1) = tau + 1`` are complete: two linked fingerprints lie within ``t_i`` bits in at least one
partition i. Dynamic programming picks the thresholds with the lowest estimated cost, from bit counts of all
distinct fingerprints. Each fingerprint goes to the bucket of its own key and to those of all keys within
``t_i`` bits; buckets are verified on whole fingerprints and give spanning forests, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, materialize, raw, small_batches, tidy, to_batch

BITS = 64
#: Fixed by XXH64's use in this operator.
SEED = 42
#: Lower case for A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A bucket with more members is dealt to blocks that are verified in different tasks.
BLOCK = 20_000
#: Relative costs of a bucket entry and of one comparison.
ENTRY_COST, PAIR_COST = 2.0, 0.01


def fingerprint(text: bytes, size: int = 4) -> int:
    """Fingerprint of one UTF-8 text over shingles of ``size`` words, repeats included; 0 without words."""
    import xxhash

    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[: n - size + 1].tolist(), ends, strict=True)])
    hashes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``doc_id, th, fp``: one signed 64-bit fingerprint and a hash of the text for each row. Null texts have no words."""

    def run(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, size) for x in raw(b.column(1))], np.uint64).view(np.int64)
        return {"doc_id": b.column(0), "th": b.column(2), "fp": fps}

    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("th"))
    return map_arrow(picked, run, "doc_id long, th long, fp long")


# --- partitions and thresholds ---------------------------------------------------------------------------


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set; over all rows."""
    small = arrow_schema("pair int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total, both = total + len(v), both + bits.T @ bits
        yield to_batch({"pair": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), total).astype(np.int64)}, small)

    rows = nodes.select("fp").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["pair"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` parts of nearly equal width; each part is grown by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        if i == m - 1:
            parts.append(left)
            break
        sub = corr[np.ix_(left, left)]
        part = [left[int(sub.sum(axis=1).argmax())]]
        rest = [b for b in left if b != part[0]]
        while len(part) < width:
            gains = corr[np.ix_(part, rest)].sum(axis=0)
            part.append(rest.pop(int(gains.argmax())))
        parts.append(sorted(part))
        left = rest
    return parts


def near_chance(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... ``most`` of the bits with these rates of ones."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for x in p:
        differ = 2 * x * (1 - x)
        moved = np.roll(dist, 1) * differ
        moved[0] = 0
        dist = dist * (1 - differ) + moved
        dist[-1] = 0
    return np.cumsum(dist[: most + 1])


def allocate(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """Parts of bits, each with its threshold: the cheapest by dynamic programming over parts, for 2 to tau + 1 parts.

    The cost of threshold t in a part is that of its bucket entries, and of its estimated candidates:
    n * n / 2 times the chance that two fingerprints lie within t there. Threshold -1 leaves a part out.
    """
    rates = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(2, tau + 2):
        parts = correlated_parts(n, both, m)
        costs = []
        for part in parts:
            chance = near_chance(rates[part], tau)
            entries = np.cumsum([math.comb(len(part), t) for t in range(tau + 1)])
            costs.append([0.0, *(n * entries * ENTRY_COST + n * n / 2 * chance * PAIR_COST)])
        # best[s]: lowest cost of the parts so far with sum(t_i + 1) = s
        table = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t in range(-1, tau - s + 1):
                    x = (c + cost[t + 1], [*ts, t])
                    if s + t + 1 not in new or x[0] < new[s + t + 1][0]:
                        new[s + t + 1] = x
            table = new
        c, ts = table[tau + 1]
        if c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


# --- probe and verify ------------------------------------------------------------------------------------


def keys(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def flips(width: int, t: int) -> np.ndarray:
    """All masks of 0 to ``t`` of ``width`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(width), k)], np.uint64)


def spread(v: np.ndarray, tau: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``v``: breadth first over a shrinking set of unseen values."""
    unseen = np.unique(v)
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            x = queue.pop()
            hit = np.bitwise_count(unseen ^ x) <= tau
            if hit.any():
                new = unseen[hit]
                unseen = unseen[~hit]
                for y in new:
                    yield x, y
                queue.extend(new)


class Forest:
    """Union-find that keeps only edges that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.up.setdefault(min(ra, rb), min(ra, rb))
            self.edges.append((a, b))


def verify_runs(bucket: np.ndarray, fp: np.ndarray, tau: int, forest: Forest) -> None:
    """Link what lies within ``tau`` in each run of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.concatenate((starts, [len(bucket)])))
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size <= 24:
            i, j = np.triu_indices(size, 1)
            for some in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
                m = fp[some[:, None] + np.arange(size)]
                a, b = m[:, i], m[:, j]
                hit = (np.bitwise_count(a ^ b) <= tau) & (a != b)
                for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                    forest.link(x, y)
        else:
            for s in at:
                for x, y in spread(fp[s : s + size], tau):
                    forest.link(int(x), int(y))


def links(nodes: DataFrame, tau: int = 4) -> DataFrame:
    """``a, b``: edges that join exactly the fingerprints (column ``fp``, distinct) reachable by links of ``tau`` bits."""
    n, both = bit_counts(nodes)
    plan = allocate(n, both, tau)
    masks = [flips(len(part), t) for part, t in plan]

    def enter(b: pa.RecordBatch) -> dict:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bucket = []
        for i, ((part, _), mask) in enumerate(zip(plan, masks, strict=True)):
            bucket.append(((keys(fp, part)[:, None] ^ mask) | np.uint64(i << 58)).ravel())
        at = np.concatenate([np.repeat(fp, len(m)) for m in masks])
        return {"bucket": np.concatenate(bucket).view(np.int64), "fp": at.view(np.int64)}

    entries = materialize(map_arrow(nodes.select("fp"), enter, "bucket long, fp long"), "simhash-entries")
    crowded = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "simhash-crowded")
    rows = entries
    if not crowded.isEmpty():
        # A crowded bucket becomes blocks: each pair of slices meets in one block, so no link is lost.
        k = F.ceil(F.col("n") / BLOCK).cast("long")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k"))
        dealt = (
            entries.join(crowded, "bucket").withColumn("k", k).withColumn("own", own)
            .select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
            .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
        )
        rows = entries.join(crowded, "bucket", "left_anti").unionByName(dealt)
    pair = arrow_schema("a long, b long")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush(last: bool) -> None:
            nonlocal held, count
            bucket = np.concatenate([x for x, _ in held])
            fp = np.concatenate([x for _, x in held])
            end = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            if end:
                verify_runs(bucket[:end], fp[:end], tau, forest)
            held = [(bucket[end:], fp[end:])]
            count = len(bucket) - end

        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            count += b.num_rows
            if count >= 200_000:
                flush(False)
        if count:
            flush(True)
        if forest.edges:
            e = np.array(forest.edges, np.uint64).view(np.int64)
            yield to_batch({"a": e[:, 0], "b": e[:, 1]}, pair)

    small_batches(nodes.sparkSession)
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return materialize(sorted_rows.mapInArrow(verify, "a long, b long"), "simhash-links")


# --- components ------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for each node of ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes; each step is an aggregation with map-side
    combining and a join that adaptive execution may split, and is written to the shared folder.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(e.select(F.col("b").alias("v"), F.col("a").alias("u")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        side = both(e) if large else e.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        least = side.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        met = side.join(least, "v")
        if large:
            out = met.filter(F.col("u") > F.col("v")).select(F.col("u").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("u").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        h = F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)")
        return tuple(e.agg(F.count("*"), F.sum(h)).first())

    e = materialize(edges.filter(F.col("a") != F.col("b")), "components-0")
    was = state(e)
    while was[0]:
        e = materialize(star(materialize(star(e, True), "components-large"), False), "components-small")
        now = state(e)
        if now == was:
            break
        was = now
    stars = e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int = 4, size: int = 4) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` for every row; component_id is the smallest doc_id reachable.

    th is a hash of the text, root the least fingerprint of the component.

    Nulls: a null text has no words, so fingerprint 0, linked like any other. A row whose doc_id is null takes
    part in links; it is never the smallest unless all ids of its component are null, then component_id is null.
    Rows that repeat a doc_id each get a row. Empty table: no rows. Other columns are not read. Texts of any
    length are used whole.
    """
    fps = materialize(fingerprints(docs, key, text, size), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = materialize(components(links(nodes, tau)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    whole = nodes.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")
    )
    # written, so that both sides of the last join are plain exchanges: a fingerprint of many copies is split
    return fps.join(materialize(whole, "simhash-components"), "fp", "left").select("doc_id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, tau: int = 4, size: int = 4) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with one document of each component: that with the least doc_id.

    Null ids come last, ties go to the least hash of the text, and of rows that repeat both one stays.
    """
    return least_of_each(docs, materialize(near_duplicates(docs, tau=tau, size=size).select("doc_id", "th", "root"), "simhash-found"))


def least_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``found`` (doc_id, th, root), chosen as in ``one_of_each``."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    kept = found.groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("__millrace_id"), F.col("p.th").alias("__millrace_th"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__millrace_id")) & (F.xxhash64("text") == F.col("__millrace_th"))
    out = docs.join(kept, match, "left_semi")
    repeated = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        out = out.withColumn("__millrace_th", F.xxhash64("text")).dropDuplicates(["doc_id", "__millrace_th"]).drop("__millrace_th")
    return out


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
