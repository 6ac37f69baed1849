"""URL filters, HTML extraction, chat formatting and the pipeline."""

from html.parser import HTMLParser
import re

import numpy as np
import pytest

from millrace.llm import chat, decontaminate, html_extract, simhash, toxicity, url_filter

# --- URL filters -----------------------------------------------------------------------------------------

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/1x?q#f", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a", "http://com/de/", "http://example.org", "http://example.org?x=/es/",
    "no scheme", "", None, "http://www.spam-farm.example.net/", "http://spam-farm.example.net", "http://notspam-farm.example.net/", "ftp://cheap-pills.example.org/en/9", "http://example.organic/es/", "http://ünï.org/ä#z",
]


def brute_judge(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in url_filter.RULES if under(r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    verdict = url_filter.RULES[rule] if rule else "block" if any(map(under, url_filter.blocked_hosts())) else "allow"
    return host, path, rule, verdict


def test_urls_brute_force(spark, sf):
    odd = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "x")], "page_id long, url string, host string")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (odd, pages):
        urls = df.select("page_id", "url").collect()
        got = url_filter.op6(df).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(repr, got)) == sorted(repr(got[0].__class__(page_id=r.page_id, **dict(zip(("host", "path", "rule", "verdict"), brute_judge(r.url), strict=True)))) for r in urls)
    assert url_filter.op6(pages.limit(0)).count() == 0


def test_collisions_decide_nothing(monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda keys: np.full(len(keys), 7, np.uint64))
    a = url_filter.DigestArray(url_filter.pack(url_filter.RULES.items()))
    for u in URLS:
        want = brute_judge(u)
        assert url_filter.judge_urls([a], [u])[0][:3] == want[:3]


def test_mapped_file(tmp_path):
    f = tmp_path / "digests"
    f.write_bytes(url_filter.pack((h, "block") for h in url_filter.blocked_hosts()))
    assert url_filter.judge_urls([url_filter.DigestArray(str(f))], ["http://m.adult-x.example.com"])[0][3] == "block"
    assert url_filter.judge_urls([url_filter.DigestArray(url_filter.pack([]))], ["http://a.b/"])[0][3] == "allow"


def test_lists_of_any_length(spark):
    """Tables of rules and hosts in many files: verdicts are those of a set lookup."""
    from pyspark.sql import functions as F

    hosts = spark.range(200_000).select(F.concat(F.lit("h"), "id", F.lit(".example.net")).alias("host")).union(spark.createDataFrame([(None,), ("h5.example.net",)], "host string"))
    rules = spark.createDataFrame([("h7.example.net/ok/", "allow"), ("h8.example.net/", "block"), ("h8.example.net/", "allow"), (None, "block")], "rule string, verdict string")
    urls = [f"http://www.h{i * 1009}.example.net/ok/x" for i in range(400)] + ["http://h7.example.net/ok/1", "http://h7.example.net/no", "https://h8.example.net/", "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules, hosts, shard_bytes=1 << 20).collect()}
    assert all((got[i].verdict == "block") == (i * 1009 < 200_000) for i in range(400))
    assert [got[i].verdict for i in range(400, 404)] == ["allow", "block", "block", "allow"]
    assert got[402].rule == "h8.example.net/" and got[401].listed == "h7.example.net"


# --- HTML ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><p>site</p></header><nav><ul><li><a href="/x">menu %d</a></ul></nav><div class="cookie-notice">ok?</div>
%s<div id="sidebar">side %d</div><section class="comments"><p>reader says %d</p></section><form><p>f</p></form><footer>&copy; us</footer></body></html>"""


def wrapped(sources):
    """The settled wrapper of a host's pages, as executors get it."""
    found = html_extract.align([html_extract.page_wrapper(html_extract.parse(s), s) for s in sources])
    return html_extract.Wrapper.load(found.dump()).settled()


def page(i, body):
    return PAGE % (i, body, i, i)


CASES = [
    (page(1, "<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four &#x41;&eacute;<aside>ad</aside><ul><li>x<li>y</ul></article>"), "A & B\none two three\nfour Aé\nx\ny"),
    (page(2, "<main><div>loose <b>bold</b> text<p>para</p>tail</div></main>"), "loose bold text\npara\ntail"),
    ("<p>one<p>two", "one\ntwo"), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<article><!-- c --><p>a<!-- </p> -->b</article>", "ab"), ("<article><p title='>'>x</p></article>", "x"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"), ("<script>only", ""), ("<article><p>unclosed", "unclosed"), ("<div><article>a</article><article>b</article></div>", "a\nb"),
    ('<article><h2 id="skip-lists">Skip lists</h2><p id="comment-is-free">x</p><div class="social history">y</div><div class="ad-hoc">z</div></article>', "Skip lists\nx\ny\nz"),
    ('<article><header><h1>T</h1></header><p>x</p><div class="comments-section">said</div><div class="ad ad-top">buy</div><footer>f</footer></article>', "T\nx"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_extraction(source, want):
    assert html_extract.extract(source, None) == want


def test_wrapper_finds_content_without_article():
    """Same-host pages: constant nodes are template, the slot that varies most is content."""
    made = [f"<html><body><div><b>Welcome</b> to us</div><div><p>Story {i}: {'lorem ' * (i + 5)}</p><p>More of {i}</p></div><div>All rights</div></body></html>" for i in range(5)]
    assert html_extract.extract(made[3], wrapped(made)) == "Story 3: " + " ".join(["lorem"] * 8) + "\nMore of 3"
    blocks = [f"<html><body><section><p>Sign in</p></section><div><p>Story {i} {'lorem ' * (i + 5)}</p></div></body></html>" for i in range(5)]
    assert html_extract.extract(blocks[2], wrapped(blocks)) == "Story 2 " + " ".join(["lorem"] * 7)


def test_template_within_the_content():
    """A constant node is template whatever its tag; where everything is constant, it is the content."""
    made = [f"<html><body><article><h2>Sign up now</h2><div><p>Same words.</p><p>{i}</p></div></article></body></html>" for i in range(4)]
    assert html_extract.extract(made[1], wrapped(made)) == "Same words.\n1"
    copies = [f"<html><body><nav>{i}</nav><article><h1>One title</h1><p>One text.</p></article></body></html>" for i in range(4)]
    assert html_extract.extract(copies[1], wrapped(copies)) == "One title\nOne text."


def test_wrappers_in_any_order():
    """Pages of many shapes give one wrapper, however they are dealt out and in whatever order they come."""
    import random

    rng = random.Random(2)
    parts = ["<div><p>a</p></div>", "<section><h2>h</h2><p>%d</p></section>", "<ul><li>x</li><li>%d</li></ul>", "<div><span>s</span></div>", "<p>t %d</p>"]
    made = [page_of for i in range(30) if (page_of := "<body>" + "".join(x % i if "%d" in x else x for x in rng.choices(parts, k=rng.randint(1, 5))) + "</body>")]
    first = [html_extract.page_wrapper(html_extract.parse(s), s) for s in made]
    want = html_extract.align([html_extract.Wrapper.load(w.dump()) for w in first]).dump()
    for _ in range(20):
        dealt = [html_extract.Wrapper.load(w.dump()) for w in first]
        rng.shuffle(dealt)
        half = rng.randint(1, 29)
        # tasks add up what is alike before wrappers are aligned
        tasks = []
        for some in (dealt[:half], dealt[half:]):
            by = {}
            for w in some:
                by[w.shape] = by[w.shape].add(w) if w.shape in by else w
            tasks += by.values()
        assert html_extract.align(tasks).dump() == want


class Gold(HTMLParser):
    """The text of ``article`` by the standard library's parser: blocks apart, blanks as one."""

    def __init__(self, source):
        super().__init__()
        self.inside, self.out, self.now = 0, [], []
        self.feed(source)
        self.close()
        self.cut()

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag == "br":
            self.now.append(" ")
        elif tag in html_extract.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCKS:
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_all_pages_against_gold(spark):
    """Every page whole; then without telling elements and classes, where only the wrapper can know."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: "\n".join(Gold(r.html or "").out) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.op4(pages).collect()} == want
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|main|nav|footer)\\b", "<$1div"), ' class="ad"', "")
    blind = pages.withColumn("html", bare)
    large = pages.withColumn("host", html_extract.host_of(F.col("url"))).groupBy("host").agg(F.collect_set("page_id").alias("of")).filter(F.size("of") >= 3)
    known = {i for r in large.collect() for i in r.of}
    got = {r.page_id: r.text for r in html_extract.op4(blind).collect()}
    assert len(known) > 150 and all(got[i] == want[i] for i in known)
    alone = {r.page_id: html_extract.extract(r.html, None) for r in blind.collect()}
    assert not any(alone[i] == want[i] for i in known)


def test_hosts_by_one_rule(spark):
    from pyspark.sql import functions as F

    urls = [*URLS, "http://ÄB.Com/x", "a\nb://C.d/e", "http://h\no.x/y", "x://", "http:///p", "://Q?z", "http://İ.com"]
    for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_extract.host_of(F.col("url")).alias("h")).collect():
        assert r.h == url_filter.split_url(r.url)[0], r.url


def test_tree_matching():
    a, b = (html_extract.skeleton(html_extract.parse(s)) for s in ("<div><p>x</p><ul><li>1</ul></div>", "<div><h1>t</h1><p>y</p><ul><li>1</ul></div>"))
    assert html_extract._score(a.children, b.children)[-1][-1] == 4
    merged = html_extract.match(a.children, b.children)[0]
    assert [(s.label, s.pages) for s in merged.children] == [("h1", 1), ("p", 2), ("ul", 2)] and merged.children[1].same is None and merged.children[2].children[0].same is not None


def test_pages_odd(spark, sf, monkeypatch):
    odd = spark.createDataFrame(
        [(1, "http://a.b/1", CASES[0][0], "x"), (1, "http://a.b/1", CASES[0][0], "x"), (2, None, CASES[1][0], "x"), (3, "http://a.b/2", None, "x"), (None, "http://a.b/3", "", "x"), (4, "http://a.b/4", "<p>" + "word " * 200_000, "x"), (5, "http://a.b/5", "<div>" * 3000 + "deep", "x")],
        "page_id long, url string, html string, text string",
    )
    got = html_extract.op4(odd).collect()
    assert len(got) == 7 and {r.text for r in got if r.page_id == 1} == {CASES[0][1]}
    assert {r.text for r in got if r.page_id in (3, None)} == {""} and next(r for r in got if r.page_id == 4).n_chars == 999_999
    assert html_extract.op4(odd.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    first = sorted(html_extract.op4(pages).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)  # the join for many hosts
    assert sorted(html_extract.op4(pages).collect()) == first and len(first) == pages.count()


# --- chats -----------------------------------------------------------------------------------------------


def brute_chats(rows):
    talks = {}
    for r in rows:
        if r[0] is not None:
            talks.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else "user", r[3] or ""))
    talks = {k: [(x[2], x[3]) for x in sorted(v)] for k, v in talks.items()}
    prefixes = {tuple(v[:n]) for v in talks.values() for n in range(1, len(v))}
    out = {}
    for k in sorted(talks):
        v = tuple(talks[k])
        if v not in prefixes and v not in {tuple(talks[o]) for o in out}:
            out[k] = (len(v), sum(tuple(x) == v for x in talks.values()), "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in v))
    return out


def test_chats_brute_force(spark, sf):
    logged = [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for k in range(1, 7) for t in range(k)]
    odd = [(20, 0, None, "hi"), (20, 0, None, "hi"), (21, 0, "user", None), (22, None, "user", "x"), (22, 1, "user", ""), (None, 0, "user", "lost"), (23, 0, "user", "hi"), (24, 5, "user", "hi"), (25, 0, "user", "z" * 300_000)]
    table = spark.createDataFrame([(*r, 1, "y") for r in logged + odd], "conv_id long, turn long, role string, text string, pos int, h1 string")
    rows = [tuple(r)[:4] for r in table.collect()]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.op2(table).collect()}
    assert got == brute_chats(rows) and set(range(1, 6)).isdisjoint(got) and got[20][0] == 2
    assert chat.op2(table.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf}/conversations.parquet")
    assert {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.op2(real).collect()} == brute_chats([tuple(r) for r in real.select("conv_id", "turn", "role", "text").collect()])


# --- the pipeline ----------------------------------------------------------------------------------------


def brute_near(texts):
    """The least id of each chain of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    having = {}
    for i, x in sets.items():
        for shingle in x or {None}:
            having.setdefault(shingle, []).append(i)
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for some in having.values():
        for a in some:
            for b in some:
                if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    least[y] = x
    return {root(i) for i in sets}


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns named like results; then no rows at all."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog again", "s1"), (2, "", "s2"), (3, None, "s3"), (None, "a text of no document", None), (None, None, None), (4, long, "s4")]
    rows += [(5, "same words in both of these two rows here", "s5")] * 2 + [(5, "other text under that id", "s5"), (6, " \t\n ", "s6"), (7, "Ünïcödé 日本 \U0001f600 text", "s7"), (9, "the quick brown fox jumps over the lazy dog again", "s9")]
    rows += [(20 + k, f"a line on all sites\nown line number {k} of this text only", f"site{k}") for k in range(8)]
    schema = "doc_id long, text string, source string, score string, th int, ids string, n_lines int, root string"
    docs = spark.createDataFrame([(*x, "s", 1, "i", 2, "r") for x in rows], schema)
    bench = spark.createDataFrame([(1, "text of no document"), (2, ""), (3, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for at, table in (("rows", docs), ("none", docs.limit(0))):
        sf = f"{tmp_path}/{at}"
        for name, df in (("documents", table), ("benchmark", bench), ("labels", labels if at == "rows" else labels.limit(0))):
            df.write.parquet(f"{sf}/{name}.parquet")
        frame = spark.read.parquet(f"{sf}/documents.parquet")
        from millrace.llm.common import materialize

        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = materialize(stage(spark, frame, sf), name)
            assert frame.columns == [x.split()[0] for x in schema.split(", ")]
        got = corpus_pipeline.run(spark, sf).collect()
        assert all(r.round_trip for r in got) and sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in frame.collect())
        if at == "none":
            assert not got
            continue
        # one of the empty texts and one of each text stay; the benchmark's passage goes, and the shared line but once
        by = {(r.doc_id, r.text) for r in got}
        assert {i for i, _ in by} == {1, 2, 4, 5, 7, *range(20, 28)} and (None, "a text of no document") not in by
        assert sum("a line on all sites" in (t or "") for _, t in by) == 1 and len(got) == len(by)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"  # enough labels to learn from
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "labels"))
    from millrace.llm.common import materialize

    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], sf), name))
    ids = [{r[0] for r in f.select("doc_id").collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[:5])
    toxic = {r.doc_id for r in toxicity.op8(docs, labels).filter("predicted = 1").collect()}
    assert toxic and ids[1] == ids[0] - toxic
    assert ids[2] == ids[1]
    assert ids[3] == brute_near({r.doc_id: r.text for r in frames[2].collect()})
    dirty = {r.doc_id for r in decontaminate.op3(frames[3], bench).filter("contaminated").collect()}
    assert dirty and ids[4] == ids[3] - dirty
    assert ids[5] == ids[4] and all(r.round_trip for r in frames[5].collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(ids[5])
