"""URL filters: a sorted digest array, memory-mapped by executors.

The file holds the 64-bit xxhash of every rule, sorted, then the rules' strings. A URL gives the keys
``host suffix + path prefix`` for the path lengths that rules have; a vectorised binary search finds equal
digests, and the stored string is compared, so that a collision decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, publish, texts

#: Path rules of the query's contract.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Bytes of one file of a list; a longer list is several files, each mapped and probed.
SHARD_BYTES = 32 << 20
VERDICTS = ("allow", "block")


def blocked_hosts(path: str | Path = Path(__file__).with_name("blocked_hosts.txt")) -> list[str]:
    """Hosts of a list file: one a line, ``#`` begins a comment."""
    with open(path, encoding="utf-8") as f:
        return [x for line in f if (x := line.split("#")[0].strip())]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or where ``://`` is missing."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:end]


def digests(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def pack(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file: counts, sorted digests, string offsets, verdicts, path lengths in use, strings.

    A rule is (host + path, verdict); without ``/`` it is a host that fits any path, even an empty one. A rule with
    both verdicts blocks.
    """
    both: dict[bytes, int] = {}
    for rule, v in rules:
        key = rule.encode("utf-8", "surrogatepass")
        both[key] = max(both.get(key, 0), VERDICTS.index(v))
    found = sorted(both.items())
    keys = [k for k, _ in found]
    d = digests(keys)
    order = np.argsort(d, kind="stable")
    strings = [keys[i] for i in order]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype("<u8")
    verdicts = np.array([found[i][1] for i in order], "<u8")
    paths = sorted({len(k.decode()[k.decode().find("/") :]) if b"/" in k else 0 for k in keys})
    head = np.array([len(strings), len(paths)], "<u8")
    return b"".join([head.tobytes(), d[order].astype("<u8").tobytes(), offsets.tobytes(), verdicts.tobytes(), np.array(paths, "<u8").tobytes(), *strings])


class DigestArray:
    """A packed list, mapped from a file (or over bytes, in tests)."""

    def __init__(self, source: str | bytes) -> None:
        self.data = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        n, p = (int(x) for x in self.data[:16].view("<u8"))
        words = self.data[16 : 16 + 8 * (3 * n + 1 + p)].view("<u8")
        self.digests, self.offsets, self.verdicts = words[:n], words[n : 2 * n + 1], words[2 * n + 1 : 3 * n + 1]
        self.path_lengths = [int(x) for x in words[3 * n + 1 :]]
        self.strings = self.data[16 + 8 * (3 * n + 1 + p) :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key in the array, -1 if absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        d = digests(keys)
        left = np.searchsorted(self.digests, d, "left")
        right = np.searchsorted(self.digests, d, "right")
        for i in np.flatnonzero(left < right):
            for j in range(left[i], right[i]):  # more than one only where digests collide
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == keys[i]:
                    out[i] = j
        return out


def judge_urls(lists: list[DigestArray], urls: list[str | None], default: str = "allow") -> list[tuple[str, str, str | None, str]]:
    """(host, path, longest fitting entry or None, verdict) of each URL, by all files of a list."""
    parts = [split_url(u) for u in urls]
    lengths = sorted({n for x in lists for n in x.path_lengths})
    keys: dict[bytes, int] = {}
    of: list[list[tuple[int, str]]] = []
    for host, path in parts:
        own = []
        at = 0
        while host:
            for n in lengths:
                if n <= len(path):
                    key = host[at:] + path[:n]
                    own.append((keys.setdefault(key.encode("utf-8", "surrogatepass"), len(keys)), key))
            at = host.find(".", at) + 1
            if not at:
                break
        of.append(own)
    verdict = np.full(len(keys), -1, np.int64)
    probes = list(keys)
    for x in lists:
        found = x.find(probes)
        hit = found >= 0
        verdict[hit] = x.verdicts[found[hit]]
    out = []
    for (host, path), own in zip(parts, of, strict=True):
        hits = [(len(key), key, int(verdict[i])) for i, key in own if verdict[i] >= 0]
        if hits:
            _, key, v = max(hits)
            out.append((host, path, key, VERDICTS[v]))
        else:
            out.append((host, path, None, default))
    return out


def publish_list(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str]], shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Files of a list of (rule, verdict) in the shared folder, fetched by every executor; their names.

    A table's rules are gathered file by file, so the driver holds ``shard_bytes`` of them at a time.
    """
    if not isinstance(rules, DataFrame):
        return [publish(spark, [pack(rules)], "digests")]
    rows = rules.select(F.col(rules.columns[0]).cast("string").alias("rule"), F.col(rules.columns[1]).cast("string").alias("verdict")).filter(F.col("rule").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("rule") + 24), F.lit(0))).first()[0]
    k = max(1, -(-total // shard_bytes))
    names = []
    for i in range(k):
        part = rows if k == 1 else rows.filter(F.pmod(F.xxhash64("rule"), F.lit(k)) == i)
        names.append(publish(spark, [pack((r["rule"], r["verdict"]) for r in part.toLocalIterator())], "digests"))
    return names


_mapped: dict[str, DigestArray] = {}


def _lists(names: list[str], kept: list[str]) -> list[DigestArray]:
    for gone in _mapped.keys() - set(kept):
        del _mapped[gone]
    for n in names:
        if n not in _mapped:
            _mapped[n] = DigestArray(SparkFiles.get(n))
    return [_mapped[n] for n in names]


def judge(
    pages: DataFrame,
    rules: dict[str, str] | DataFrame = RULES,
    blocked: Iterable[str] | DataFrame = (),
    key: str = "page_id",
    url: str = "url",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every row.

    rule: the longest path rule that fits, else null; its verdict holds. Otherwise the blocked hosts decide
    (``listed``: the entry that fits, subdomains included), else the verdict is allow. ``rules`` may be a table of
    rules and verdicts and ``blocked`` a table whose first column has hosts, of any size: null entries are skipped, a
    rule with both verdicts blocks. A null URL has an empty host and path and is allowed. Repeated rows are judged
    each; an empty table gives no rows; other columns aren't read.
    """
    spark = pages.sparkSession
    by = rules if isinstance(rules, DataFrame) else rules.items()
    hosts = blocked.select(blocked.columns[0], F.lit("block")) if isinstance(blocked, DataFrame) else ((h, "block") for h in blocked)
    first_names, host_names = publish_list(spark, by, shard_bytes), publish_list(spark, hosts, shard_bytes)

    def run(b: pa.RecordBatch) -> dict:
        every = [*first_names, *host_names]
        by_rule, by_host = _lists(first_names, every), _lists(host_names, every)
        urls = [t if ok else None for ok, t in zip(b.column(1).is_valid().to_pylist(), texts(b.column(1)), strict=True)]
        first, second = judge_urls(by_rule, urls), judge_urls(by_host, urls)
        return {
            "page_id": b.column(0),
            "host": [x[0] for x in first],
            "path": [x[1] for x in first],
            "rule": [x[2] for x in first],
            "verdict": [x[3] if x[2] is not None else y[3] for x, y in zip(first, second, strict=True)],
            "listed": [y[2] for y in second],
        }

    picked = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"))
    return map_arrow(picked, run, "page_id long, host string, path string, rule string, verdict string, listed string")


def op6(pages: DataFrame) -> DataFrame:
    return judge(pages, blocked=blocked_hosts())
