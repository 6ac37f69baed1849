"""Operators on documents: against brute force, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import decontaminate, fingerprints, lines, pieces, simhash, token_files, toxicity
from millrace.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _id int, ids string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and blank texts, a long text, repeated rows and ids, columns named like results."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "s1"), (2, "", "s2"), (3, None, "s3"), (None, "a text of no document", None), (None, None, None),
        (4, long, "s4"), (5, "same words in both of these two rows here", "s5"), (5, "same words in both of these two rows here", "s5"), (5, "other text under that id", "s5"),
        (6, " \t\n ", "s6"), (7, "Ünïcödé 日本 \U0001f600 text", "s7"), (8, "one", "s8"), (9, "the quick brown fox jumps over the lazy dog again", "s9"), (10, "x  y \n z  ", "s1"),
        (11, "a <|endoftext|>b\n <|endoftext|> c d<|endoftext|>", "s10"), (12, " e\u00a0 f \u3000g h\ti j's  k'll", "s10"),
    ]
    return spark.createDataFrame([(i, t, "en", s, 1, "a", 2, "b", "c") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- token files -----------------------------------------------------------------------------------------


def expected_ids(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, out = 0, {}
    for r in order:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        out.setdefault(r.doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(docs):
    want = expected_ids(docs.collect())
    got = token_files.op1(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == docs.count()
    assert all([(r.start, r.n_tokens, r.ids_crc32)] == want[r.doc_id] for r in got)


def test_token_files_odd(odd, none):
    got = token_files.op1(odd, tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == odd.count()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    crcs = lambda rows: sorted(x[2] for v in rows.values() for x in v)
    assert sorted(r.ids_crc32 for r in got) == crcs(expected_ids(odd.collect()))
    assert token_files.op1(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_batches_fuzz():
    """Blanks of all kinds, contractions, added tokens and scripts: ids are the library's."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_files.BatchEncoder(path)
    parts = ["a", "B", "hello", "'s", "'ll", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\x0b", "\x1c", "\x85", "é", "日本", "😀", "23", ".", "<|endoftext|>", "_", "\u200b", "İ"]
    rng = random.Random(3)
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " "]
    ids, ends = enc.encode(pa.array(rows, pa.string()), np.array([2], enc.dtype).tobytes())
    for text, s, e in zip(rows, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert ids[s:e].tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def test_huffman_limits():
    rng = np.random.default_rng(1)
    for counts in ([5], [1, 1], [2**i for i in range(40)], rng.integers(0, 50, 3000).tolist()):
        c = np.array(counts, np.int64)
        n = token_files.code_lengths(c, 20)
        assert n.max() <= 20 and (n[c == 0] == 0).all() and (n[c > 0] > 0).all()
        assert (2.0 ** -n[n > 0]).sum() <= 1
        ids = rng.choice(np.flatnonzero(c), 3000)
        bits, offsets = token_files.pack(ids, n, token_files.canonical(n))
        assert (token_files.unpack(bits, offsets, len(ids), token_files.decode_table(n)) == ids).all()
        # any block alone
        k = 3
        part = token_files.unpack(bits, offsets[k : k + 1], token_files.BLOCK, token_files.decode_table(n))
        assert (part == ids[k * token_files.BLOCK : (k + 1) * token_files.BLOCK]).all()


def test_optimal_lengths_without_limit():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((token_files.code_lengths(counts, 20) * counts).sum()) == cost


# --- decontamination -------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def brute_hits(text, items, size=10):
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for name, item in items:
        v = WORD.findall(lower(item))
        for i in range(max(1, len(v) - size + 1)) if v else []:
            p = v[i : i + size]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 25, 2_000])
def test_decontamination_brute_force(docs, spark, sf, block_bytes):
    """Every document whole: a set of all windows as tuples says the same."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = {}
    for r in bench.collect():
        v = WORD.findall(lower(r.text))
        for i in range(max(1, len(v) - 9)) if v else []:
            windows.setdefault(tuple(v[i : i + 10]), set()).add(str(r.item_id))
    sizes = sorted({len(x) for x in windows})
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).collect()}
    hits = 0
    for r in docs.collect():
        w, hit, names = WORD.findall(lower(r.text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, list(g["items"])) == (len(w), len(hit), sorted(names))
        raw = (r.text or "").encode()
        covered = [raw[a:b] for a, b in zip(g.spans[::2], g.spans[1::2], strict=True)]
        assert sum(len(decontaminate.words(c)) for c in covered) == len(hit)
        hits += bool(hit)
    assert hits


def test_decontamination_against_every_position(tmp_path):
    """Short items, items that share windows, repeated words: against comparison at every position."""
    import random

    from millrace.llm.common import map_arrays, pack_arrays

    rng = random.Random(4)
    few = [f"w{i}" for i in range(4)]
    for trial in range(60):
        items = [(str(i % 9), " ".join(rng.choice(few) for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 9, 14])))) for i in range(12)]
        path = tmp_path / str(trial)
        size = rng.choice([2, 3, 4, 10])
        path.write_bytes(b"".join(pack_arrays(decontaminate.index([(n, x.encode()) for n, x in items], size))))
        auto = decontaminate.Automaton(map_arrays(str(path)))
        text = " ".join(rng.choice([*few, "other"]) for _ in range(60))
        n, spans, names = auto.scan(text.encode())
        covered = sum(b - a + 1 for a, b in decontaminate.merge(spans))
        assert (n, covered, names) == brute_hits(text, items, size)


def test_decontamination_reads_once(docs, spark):
    """A benchmark of megabytes is one automaton: one scan of the documents."""
    rows = [(i, " ".join(f"x{(i * 7919 + k * 31) % 99991}" for k in range(200))) for i in range(2_000)]
    planted = [(1, "some words before " + rows[77][1][300:800] + " and after"), (2, "nothing of it")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    found = decontaminate.decontaminate(spark.createDataFrame(planted, "doc_id long, text string"), bench)
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].n_hit > 50 and "77" in by[1]["items"] and by[2].n_hit == 0
    plan = decontaminate.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_decontamination_odd(odd, none, spark):
    bench = spark.createDataFrame([(1, "Quick BROWN fox"), (2, ""), (3, None), (None, "no document"), (2, "lazy dog again")], "item_id long, text string")
    got = decontaminate.op3(odd, bench).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id in (1, 2, 9)}
    assert by[1].n_hit == 6 and by[1].n_items == 2 and by[1].items_sha256 == hashlib.sha256(b"1,2").hexdigest() and not by[2].contaminated
    assert by[1] == by[9].__class__(**(by[9].asDict() | {"doc_id": 1}))
    assert sum(r.contaminated for r in got if r.doc_id is None) == 1
    two = decontaminate.decontaminate(odd, bench, block_bytes=10).collect()
    assert len(two) == odd.count()
    assert decontaminate.op3(none, bench).count() == 0
    assert not decontaminate.op3(odd, bench.limit(0)).filter("contaminated").count()
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.clean(odd, bench).count() == odd.count() - 3


# --- SimHash ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, tau):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array(fps, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= tau) + i + 1:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_brute_force(docs):
    rows = docs.collect()
    want = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    ids = sorted(want)
    comp = brute_components([want[i] for i in ids], 4)
    got = {r.doc_id: r for r in simhash.op9(docs).collect()}
    assert len(got) == len(rows)
    for i, c in zip(ids, comp, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{want[i]:016x}", ids[c])


def clustered(n, seed):
    """Fingerprints in chains of small steps around some centres."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(n // 6):
            if rng.random() < 0.8:
                for b in rng.choice(64, rng.integers(1, 6), replace=False):
                    x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("tau", "block"), [(1, 20_000), (3, 20_000), (4, 7), (6, 20_000)])
def test_links_brute_force(spark, monkeypatch, tau, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 7: buckets are dealt to blocks
    fps = clustered(240, tau)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, tau)).collect()}
    comp = brute_components(fps, tau)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    mine = [roots.get(s, s) for s in signed]
    pairs = lambda c: [[a == b for b in c] for a in c]
    assert pairs(mine) == pairs(comp)


def test_thresholds_are_complete():
    rng = np.random.default_rng(3)
    for n in (100, 10**6, 10**10):
        bits = rng.integers(0, 2, (500, 64)).astype(float)
        both = bits.T @ bits / 500 * n
        plan = simhash.allocate(n, both, 4)
        assert sum(t + 1 for _, t in plan) == 5 and all(len(set(p)) == len(p) for p, _ in plan)
        for _ in range(200):  # whichever 4 bits differ, some part is within its threshold
            d = set(rng.choice(64, 4, replace=False).tolist())
            assert any(len(d & set(p)) <= t for p, t in plan)


def test_simhash_odd(odd, none):
    got = simhash.op9(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[9][0].component_id == 1
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 6, None} and {r.component_id for r in zero} == {2}
    assert simhash.op9(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 0 and ids.count(1) == 1 and ids.count(5) == 2 and ids.count(None) == 1


# --- fingerprints ----------------------------------------------------------------------------------------


def test_fingerprints_follow_the_contract(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.op5(docs).collect()}
    s = fingerprints.Sampler()
    for i, d in enumerate(order):
        follow = texts[order[(i + 1) % len(order)]]
        new = fingerprints.edited(texts[d], follow)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(texts[d]), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.to_hex(s.signature(texts[d]))
        assert r.near_edited == fingerprints.likeness(s.signature(texts[d]), s.signature(new))
        assert r.near_next == fingerprints.likeness(s.signature(texts[d]), s.signature(follow))


def test_collisions_estimate_generalised_jaccard():
    s = fingerprints.Sampler()
    a, b = "a b c d " * 50 + "e f g h i j k l m n " * 3, "a b c d " * 20 + "e f g h i j k l m n " * 6
    (ta, ca), (tb, cb) = s.terms(a), s.terms(b)
    wa, wb = dict(zip(ta.tolist(), ca.tolist(), strict=True)), dict(zip(tb.tolist(), cb.tolist(), strict=True))
    keys = wa.keys() | wb.keys()
    true = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    found = []
    for seed in range(30):
        s.v = fingerprints.variates(seed=seed)
        found.append(fingerprints.likeness(s.signature(a), s.signature(b)))
    assert abs(np.mean(found) - true) < 0.03


def test_fingerprints_odd(odd, none):
    got = fingerprints.op5(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_chars for r in got if r.doc_id in (2, 3)} == {0}
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[9] and by[2] == by[3] and by[1] != by[8]
    assert fingerprints.op5(none).count() == 0
    alone = fingerprints.op5(odd.filter("doc_id = 8")).collect()[0]
    assert alone.near_next == 1.0 and alone.n_chars == 3


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 1013}" for i in range(5000))
    whole = fingerprints.Sampler().signature(text)
    monkeypatch.setattr(fingerprints, "CHUNK", 97)
    assert (fingerprints.Sampler().signature(text) == whole).all()


# --- toxicity --------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.op8(docs, labels).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in marks.items() if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * sum(not y for _, y in held)


def test_factors_learn_interactions():
    """Neither term alone is toxic, both together are: no linear model can tell."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        noise = rng.choice(np.arange(10, 40), 3, replace=False)
        rows.append(np.unique(np.concatenate([[1] * a, [2] * b, noise])).astype(np.int32))
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y), epochs=30)
    p = np.array([m.score(r) for r in rows])
    assert ((p > 0.5) == np.array(y)).mean() > 0.97
    assert np.abs(m.factors).max() > 0.05


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0), (4, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.op8(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.op8(none, labels).count() == 0
    assert not toxicity.op8(odd, labels.limit(0)).filter("predicted = 1").count()
    assert toxicity.clean(odd, labels).columns == odd.columns


# --- line dedup ------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    sites, first = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate(r[1].split("\n")):
            bare = re.sub(r"[\t\r]", " ", line).strip(" ")
            if bare:
                sites.setdefault(bare, set()).add(r[2])
                first.setdefault(bare, (r[0], k))
    out = {}
    for i, text, _ in rows:
        kept = []
        for k, line in enumerate(text.split("\n")):
            bare = re.sub(r"[\t\r]", " ", line).strip(" ")
            if not bare or len(sites[bare]) < least or first[bare] == (i, k):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("least", [2, 6])
def test_lines_brute_force(docs, least):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute_lines(rows, least)
    got = lines.dedup_lines(docs, least).collect()
    assert len(got) == len(rows) and all(r.text == want[r.doc_id] for r in got)


def test_lines_odd(odd, none, spark):
    got = lines.dedup_lines(odd, 2)
    assert got.columns == [*odd.columns, "n_lines", "n_cut"] and got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id in (1, 3, 9)}
    assert by[1].text and by[9].text == "" and by[9].n_cut == 1 and by[3].text is None and by[3].n_lines == 0
    assert lines.dedup_lines(none).count() == 0
    clash = spark.createDataFrame([(1, "a\nb", "s", 7), (2, "a\nc", "t", 8)], "doc_id long, text string, source string, n_cut int")
    assert sorted(r.text for r in lines.dedup_lines(clash, 2).collect()) == ["a\nb", "c"]


# --- pieces ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head_bytes", [96 << 20, 3_000])
def test_pieces_are_the_models(docs, odd, head_bytes):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    both = docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    got = pieces.encode_decode(both, path, head_bytes).collect()
    assert len(got) == both.count()
    for r in got:
        assert list(r.ids) == sp.encode(r.text or "") and r.decoded == (r.text or "").replace(pieces.BLANK, " ")


def test_merge_sets_are_the_models(spark):
    """Viterbi over merge sets, in bits and in arrays, against the library on units that tie, repeat and run long."""
    import random

    import sentencepiece
    from pyspark.sql import functions as F

    path = tokenizer("piece_bpe_32k.model")
    sp, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    head = sp.encode("\n")
    rng = random.Random(7)
    parts = ["th", "he", "a", "aaa", "e", "ou", "tion", "▁", "ing", "sch", "ss", "ab", "re", "ere", "=", "--", "中", "\n", "é", "😀"]
    units = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)}
    units |= {c * k for c in "a=▁-" for k in (1, 2, 3, 7, 15, 16, 17, 33, 90)} | {"ab" * 40, "a" * 700, "xyz" * 200}
    rows = spark.createDataFrame([(u, 1) for u in sorted(units)], "unit string, n long")
    for r in pieces.dictionary(rows, v).collect():
        assert list(r.ids) == sp.encode("\n" + r.unit)[len(head) :], r.unit
    edges = pieces.lattice(rows.repartition(4, "unit"), pieces.piece_table(spark, v), 16, False)
    in_arrays = edges.select("unit", pieces.viterbi_any(F.length("unit"), 16, True).alias("cuts")).collect()
    assert {r.unit: r.cuts for r in in_arrays} == {r.unit: r.cuts for r in pieces.paths(rows, v).collect()}


def test_pieces_of_nothing(none):
    assert pieces.op7(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_viterbi_brute_force(spark):
    """A unigram vocabulary: the fold finds the best-scoring of all segmentations."""
    from pyspark.sql import functions as F

    table = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.9, "bc": -4.1, "abc": -6.0, "ca": -4.0, "▁": -1.0, "▁a": -2.2}
    v = pieces.Vocabulary(("<unk>", *table), (0.0, *table.values()), (pieces.UNKNOWN, *[pieces.NORMAL] * len(table)), pieces.UNIGRAM)
    words = ["abc", "▁abcab", "caab", "x", "axb", "▁", "bcbcbc"]
    units = spark.createDataFrame([(w, 1) for w in words], "unit string, n long")
    low = min(table.values()) - pieces.UNKNOWN_PENALTY

    def best(w):
        if not w:
            return 0.0
        known = [table[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in table]
        return max(known + ([] if w[0] in table else [low + best(w[1:])]))

    names = [*v.pieces]
    for r in pieces.dictionary(units, v).select("unit", F.col("ids")).collect():
        score = sum(table.get(names[i], low) if i else 0 for i in r["ids"])
        unknown = sum(c not in table for c in r.unit)
        expected = best(r.unit) - unknown * low
        assert abs(score - expected) < 1e-9
