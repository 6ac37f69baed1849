"""Near copies of the pipeline's stage, against brute force."""

import random

import corpus_pipeline
from millrace.llm import near_copies, simhash


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stage_takes_five_words_and_four_fifths(spark, monkeypatch):
    """Links at 0.8 or more and no others; many of them differ in more than four bits of a fingerprint."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(30, 90))
        texts.append(" ".join(words))
        for edits in (1, 2, 3):
            new = list(words)
            for at in rng.sample(range(len(new)), edits):
                new[at] = rng.choice(vocabulary)
            texts.append(" ".join(new))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    far = apart = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = (simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[j].encode())).bit_count()
            if jaccard(texts[i], texts[j]) >= 0.8:
                far += bits > 4
                up[max(root(i), root(j))] = min(root(i), root(j))
            elif i // 4 == j // 4:
                apart += 1
    assert far > 20 and apart > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {root(i) for i in range(len(texts))}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == want
    # crowded tokens, another order of shingles
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == want


def test_near_copies_odd(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (8, "x y"), (8, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 4, 6, 8]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_stage_links_fingerprints_first(spark, monkeypatch):
    """The stage's first pairs are the links of SimHash: those that join all fingerprints of five-word shingles within TAU bits."""
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = rng.choices([f"w{i}" for i in range(500)], k=120)
        for edits in (0, 1, 2, 4):
            new = list(words)
            for at in rng.sample(range(len(new)), edits):
                new[at] = "edited"
            texts.append(" ".join(new))
    texts += ["w1 W2", "w1 w2", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    links, verified = near_copies.links, near_copies.verified
    monkeypatch.setattr(near_copies, "links", lambda nodes, tau: seen.append((tau, {r.fp for r in nodes.collect()})) or links(nodes, tau))
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *rest: seen.append({(r.a, r.b) for r in pairs.collect()}) or verified(pairs, *rest))
    corpus_pipeline.without_near_copies(spark, docs, "").collect()
    fps = {near_copies.name(near_copies.shingles((t or "").encode())): simhash.fingerprint((t or "").encode(), 5) for t in texts}
    (tau, linked), first = seen[:2]
    assert tau == near_copies.TAU and linked == {f - (1 << 64) if f >> 63 else f for f in fps.values()}
    group = {sh: {sh} for sh in fps}

    def join(a, b):
        whole = group[a] | group[b]
        group.update(dict.fromkeys(whole, whole))

    for a, b in first:
        join(a, b)
    got = {frozenset(x) for x in group.values()}
    group = {sh: {sh} for sh in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= tau and b not in group[a]:
                join(a, b)
    assert first and got == {frozenset(x) for x in group.values()}


def test_workers_give_memory_back(monkeypatch):
    """When a task of an operator ends, its batches are gone and their memory is given back; idle workers stay."""
    import types
    import weakref

    import pyarrow as pa

    from millrace.llm import common

    held, state = [], []
    monkeypatch.setattr(common, "give_back", lambda: state.append([r() is None for r in held]))
    conf = types.SimpleNamespace(set=lambda *_: None)
    df = types.SimpleNamespace(sparkSession=types.SimpleNamespace(conf=conf), mapInArrow=lambda run, schema: run)

    def keep(b):
        array = b.column(0).to_numpy() + 1
        held.append(weakref.ref(array))
        return {"x": array}

    keep.__module__ = "millrace.llm.pieces"
    batches = (pa.record_batch({"x": pa.array([i], pa.int64())}) for i in range(3))
    rows, out = common.map_arrow(df, keep, "x long")(batches), []
    while (b := next(rows, None)) is not None:
        out.append(b.column(0).to_pylist())
        del b
    assert out == [[1], [2], [3]] and state == [[], [True] * 3]  # as a task begins, as it ends
