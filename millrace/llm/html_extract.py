"""HTML extraction by wrapper induction.

Pages of one host are aligned by simple tree matching: two trees match node by node, children in order, by the
best-scoring alignment of their child lists. Runs of like siblings count as one repeated node, so lists and
paragraphs of any number align. The aligned tree of a host (its wrapper) keeps for every node how many pages
have it and whether its text varies. Nodes with the same text on most of the host's pages are template; slots whose
text varies are content.

Pages of one shape align node by node, and their counts add up in any order; only wrappers of different shapes are
matched, in the order of the shapes' hashes. So a host's wrapper doesn't depend on how its pages are dealt out.

On a host of ``MIN_PAGES`` distinct pages or more the wrapper decides: the content root is the node that holds most of
the varying text, narrowed or widened to ``article`` or ``main`` elements where they agree with it, and template
nodes go whatever their tags. On smaller hosts those elements, or the body, are the root. Elements whose
kind, role or class says that they are menus, footers, forms, scripts, adverts or reader comments go everywhere; a
class or id says so only if all its words do.
"""

from __future__ import annotations

import html
import pickle
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, small_batches, texts, to_batch
from .url_filter import split_url

# --- fixed values of HTML --------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open ``p``.
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt option optgroup legend summary".split())
#: A start tag closes open elements of these kinds, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
BOILERPLATE = frozenset(
    "aside button canvas datalist dialog embed footer form head header iframe input label link menu meta nav noembed noframes "
    "noscript object option script select style svg template textarea title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TEXT_KINDS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li td th dd dt figcaption".split())
# ---------------------------------------------------------------------------------------------------------

#: Words of classes and ids that mark boilerplate, within the content too, ...
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription share sharing comment comments disqus reply replies related recommended recommendations pagination pager "
    "widget toolbar login signup".split()
)
#: ... and around it only.
OUTER_MARKS = MARKS | frozenset("banner aside footer header masthead skip copyright legal".split())
#: Words that may stand beside them.
BESIDE = frozenset(
    "area bar block blocks body bottom box btn button buttons container content fixed form group icon icons inline inner item "
    "items left link links list main media module outer page panel post posts primary reader right row secondary section "
    "site slot social text title top unit user users widgets wrap wrapper".split()
)
#: Elements that a content root can be in.
CONTAINERS = (BLOCKS | {"html"}) - TEXT_KINDS
#: Elements that a class or id can mark; headings, paragraphs and words in them say what they say.
MARKED_KINDS = frozenset("div section ul ol dl table span figure details ins center menu dir fieldset a".split())

#: Distinct pages of a host from which its wrapper tells template from content.
MIN_PAGES = 3
#: The content root is found by going down while one child holds so much of the varying text.
DOMINANT = 0.7
#: Template stands on so many of a host's pages, as a share.
TEMPLATE_SHARE = 0.5
#: A partial wrapper set of a task is passed on when it has so many hosts.
HOSTS = 2_000
#: Wrappers that are sent to all executors take so many bytes at most.
BROADCAST_BYTES = 32 << 20

# Trees are matched, merged and pickled whole, by recursion; parse() nests 400 elements at most.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)", re.S)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    marks: frozenset[str] = frozenset()
    role: str = ""
    told: int = 0  # by class or id: 1 boilerplate around the content, 2 within it too
    children: list = field(default_factory=list)  # of Node and str

    def boilerplate(self, within: bool = False) -> bool:
        """Furniture by kind, role or mark; ``within`` the content a header with a heading is the article's own."""
        if self.tag in BOILERPLATE:
            return not (within and self.tag == "header" and any(n.tag in ("h1", "h2") for n in _walk(self)))
        return self.role in ROLES or (self.told > within and self.tag in MARKED_KINDS)

    def label(self) -> str:
        return self.tag + "." + ".".join(sorted(self.marks)) if self.marks else self.tag


def _told(words: list[str]) -> int:
    """What the words of one class or id say: 2 boilerplate anywhere, 1 around the content, 0 nothing."""
    if not all(w in OUTER_MARKS or w in BESIDE for w in words):
        return 0
    return 2 if any(w in MARKS for w in words) else int(any(w in OUTER_MARKS for w in words))


def _attributes(source: str) -> tuple[frozenset[str], str, int]:
    marks: set[str] = set()
    role = ""
    told = 0
    for m in _ATTR.finditer(source):
        name = (m[1] or m[5] or "").lower()
        value = next((x for x in (m[2], m[3], m[4]) if x is not None), "")
        if name in ("class", "id"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", html.unescape(value)).lower()
            names = spaced.split() if name == "class" else [spaced]
            for one in names:
                found = [w for w in _WORD.findall(one) if not w.isdigit()]
                marks.update(found)
                told = max(told, _told(found))
        elif name == "role":
            role = value.strip().lower()
        elif name in ("hidden", "aria-hidden") and value.strip().lower() in ("", "hidden", "true"):
            role = role or "alert"  # isn't shown
    return frozenset(marks), role, told


def parse(source: str) -> Node:
    """A tolerant DOM: unclosed elements end with their parents, stray end tags are skipped."""
    root = Node("#root")
    stack = [root]
    at = 0

    def close_to(depth: int) -> None:
        del stack[max(1, depth) :]

    while True:
        m = _TAG.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            return root
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pass  # a comment in HTML
            continue
        tag = m[2].lower()
        if m[1]:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    close_to(d)
                    break
            continue
        if tag in CLOSES:
            kinds, fence = CLOSES[tag]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in fence:
                    break
                if stack[d].tag in kinds:
                    close_to(d)
                    break
        if tag in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    close_to(d)
                    break
                if stack[d].tag in ("td", "th", "li", "div", "article", "section", "button", "table"):
                    break
        node = Node(tag, *_attributes(m[3])) if m[3].strip(" /\n\t") else Node(tag)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW_TEXT:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            node.children.append(source[at:stop])
            at = stop
            if end:
                gt = source.find(">", stop)
                at = len(source) if gt < 0 else gt + 1
            continue
        if len(stack) < 400:  # deeper elements become siblings
            stack.append(node)


# --- wrappers --------------------------------------------------------------------------------------------


class Slot:
    """A node of a wrapper: on how many pages, the hash of its own text while that is the same, varying length."""

    __slots__ = ("label", "pages", "same", "varying", "children", "text", "fixed")

    def __init__(self, label: str, pages: int, same: int | None, varying: int, children: list[Slot]) -> None:
        self.label, self.pages, self.same, self.varying, self.children = label, pages, same, varying, children
        self.text, self.fixed = 0, False  # see ``settle``

    def __reduce__(self):
        return Slot, (self.label, self.pages, self.same, self.varying, self.children)


def _alike(x: Slot, y: Slot) -> bool:
    """Neighbours that repeat one node: of one label and, but for paragraphs, items and the like, with like children."""
    if x.label != y.label:
        return False
    return x.label.partition(".")[0] in TEXT_KINDS or x.label == "tr" or [c.label for c in x.children] == [c.label for c in y.children]


def _shape(slot: Slot) -> int:
    return _hash(f"{slot.label}({','.join([str(_shape(c)) for c in slot.children])})")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def skeleton(node: Node, runs: dict[int, list[list[Node]]] | None = None) -> Slot:
    """A page's tree for alignment: runs of like siblings are one node; each node knows its own text's hash.

    runs: gets, by the id of a node, its child elements as its skeleton's children have them.
    """
    own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
    children: list[Slot] = []
    of: list[list[Node]] = []
    for c in node.children:
        if isinstance(c, str):
            continue
        s = skeleton(c, runs)
        if children and _alike(children[-1], s):
            last = children[-1]
            last.same = _hash(f"{last.same} {s.same}")
            last.varying += s.varying
            last.children = match(last.children, s.children, run=True)
            of[-1].append(c)
        else:
            children.append(s)
            of.append([c])
    if runs is not None:
        runs[id(node)] = of
    return Slot(node.label(), 1, _hash(own) if own else 0, len(own), children)


def _score(a: list[Slot], b: list[Slot]) -> list[list[int]]:
    """Simple tree matching on child lists: best number of matched nodes for each pair of beginnings."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        row, above = table[i], table[i - 1]
        for j, y in enumerate(b, 1):
            best = above[j] if above[j] > row[j - 1] else row[j - 1]
            if x.label == y.label and (s := above[j - 1] + _weight(x, y)) > best:
                best = s
            row[j] = best
    return table


def _weight(x: Slot, y: Slot) -> int:
    return 1 + (_score(x.children, y.children)[-1][-1] if x.children and y.children else 0)


def match(a: list[Slot], b: list[Slot], run: bool = False) -> list[Slot]:
    """Both child lists as one: matched nodes merge, the others stay. run: within one page, counts aren't added."""
    if not a or not b:
        return a or b
    if [x.label for x in a] == [y.label for y in b]:
        return [merge(x, y, run) for x, y in zip(a, b, strict=True)]
    table = _score(a, b)
    out: list[Slot] = []
    i, j = len(a), len(b)
    while i and j:
        x, y = a[i - 1], b[j - 1]
        if x.label == y.label and table[i][j] == table[i - 1][j - 1] + _weight(x, y):
            out.append(merge(x, y, run))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            out.append(x)
            i -= 1
        else:
            out.append(y)
            j -= 1
    out += reversed(a[:i])
    out += reversed(b[:j])
    return out[::-1]


def merge(x: Slot, y: Slot, run: bool = False) -> Slot:
    if run:
        same = _hash(f"{x.same} {y.same}")
    else:
        same = x.same if x.same == y.same else None
    return Slot(x.label, max(x.pages, y.pages) if run else x.pages + y.pages, same, x.varying + y.varying, match(x.children, y.children, run))


def add_alike(x: Slot, y: Slot) -> Slot:
    """Two trees of one shape as one, node by node."""
    same = x.same if x.same == y.same else None
    children = [add_alike(c, d) for c, d in zip(x.children, y.children, strict=True)]
    return Slot(x.label, x.pages + y.pages, same, x.varying + y.varying, children)


class Wrapper:
    """Aligned pages: their tree, up to ``MIN_PAGES`` hashes of distinct pages (the least), and the hash of their shape.

    Wrappers of one shape add up in any order; ``align`` gives the same wrapper for the same set of wrappers.
    """

    def __init__(self, tree: Slot, pages: list[int], shape: int) -> None:
        self.tree, self.pages, self.shape = tree, pages, shape

    def add(self, other: Wrapper) -> Wrapper:
        tree = add_alike(self.tree, other.tree) if self.shape == other.shape else merge(self.tree, other.tree)
        return Wrapper(tree, sorted({*self.pages, *other.pages})[:MIN_PAGES], self.shape)

    def dump(self) -> bytes:
        return pickle.dumps((self.tree, self.pages, self.shape), 5)

    @staticmethod
    def load(data: bytes) -> Wrapper:
        return Wrapper(*pickle.loads(data))

    def settled(self) -> Wrapper:
        """With ``text`` and ``fixed`` of every slot, for extraction."""
        settle(self.tree)
        return self


def page_wrapper(root: Node, source: str) -> Wrapper:
    tree = skeleton(root)
    return Wrapper(tree, [_hash(source)], _shape(tree) >> 1)


def align(wrappers: list[Wrapper]) -> Wrapper:
    """One wrapper of all: alike ones first, then shape by shape."""
    shapes: dict[int, Wrapper] = {}
    for w in wrappers:
        shapes[w.shape] = shapes[w.shape].add(w) if w.shape in shapes else w
    first, *rest = (shapes[k] for k in sorted(shapes))
    for w in rest:
        first = first.add(w)
    return first


# --- extraction ------------------------------------------------------------------------------------------


def _aligned(a: list[Slot], b: list[Slot]) -> list[tuple[int, Slot]]:
    """Positions in ``a`` with the nodes of ``b`` that they match."""
    if [x.label for x in a] == [y.label for y in b]:
        return list(enumerate(b))
    table = _score(a, b)
    out = []
    i, j = len(a), len(b)
    while i and j:
        x, y = a[i - 1], b[j - 1]
        if x.label == y.label and table[i][j] == table[i - 1][j - 1] + _weight(x, y):
            out.append((i - 1, y))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def settle(slot: Slot) -> None:
    """Fill in ``text``, the varying text of a slot and below without what is furniture by kind or mark, and ``fixed``:
    the same text, below too, wherever it stands."""
    for c in slot.children:
        settle(c)
    tag, _, marks = slot.label.partition(".")
    furniture = tag in BOILERPLATE or marks and tag in MARKED_KINDS and _told(marks.split("."))
    slot.text = 0 if furniture else (slot.varying if slot.same is None else 0) + sum(c.text for c in slot.children)
    slot.fixed = slot.same is not None and all(c.fixed and c.pages == slot.pages for c in slot.children)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def _elements(root: Node) -> list[Node]:
    """The ``article`` elements, else the ``main`` ones, that aren't in furniture."""
    for kind in ("article", "main"):
        todo, found = [root], []
        while todo:
            n = todo.pop()
            if n.tag == kind or kind == "main" and n.role == "main":
                found.append(n)
            elif not (n.boilerplate() and n.tag != "#root"):
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if found:
            return found
    return []


class Aligned:
    """A page aligned with its host's wrapper: for each of its elements the slot, and which of them are template."""

    def __init__(self, root: Node, wrapper: Wrapper) -> None:
        self.slots: dict[int, Slot] = {}
        self.parents: dict[int, Node] = {}
        self.least = max(MIN_PAGES, TEMPLATE_SHARE * wrapper.tree.pages)
        runs: dict[int, list[list[Node]]] = {}
        todo = [(root, skeleton(root, runs), wrapper.tree)]
        while todo:
            node, shape, slot = todo.pop()
            self.slots[id(node)] = slot
            for i, y in _aligned(shape.children, slot.children):
                own = runs[id(node)][i]
                for n in own:
                    self.parents[id(n)] = node
                    self.slots[id(n)] = y
                if len(own) == 1:
                    todo.append((own[0], shape.children[i], y))

    def template(self, node: Node) -> bool:
        """The same text wherever it stands, and it stands on most pages."""
        slot = self.slots.get(id(node))
        return slot is not None and slot.fixed and slot.pages >= self.least

    def root(self, root: Node) -> Node:
        """Down from ``root``, as long as one child holds nearly all varying text."""
        node = root
        while (slot := self.slots.get(id(node))) is not None:
            kids = [c for c in node.children if isinstance(c, Node) and id(c) in self.slots and not c.boilerplate()]
            best = max(kids, key=lambda c: self.slots[id(c)].text, default=None)
            if best is None or best.tag in TEXT_KINDS or best.tag not in CONTAINERS:
                break
            held = self.slots[id(best)]
            if held.text < DOMINANT * slot.text or sum(self.slots[id(c)] is held for c in kids) > 1:
                break
            node = best
        return node


def content_roots(root: Node, aligned: Aligned | None) -> list[Node]:
    """Where a page's main text is."""
    found = _elements(root)
    body = next((n for n in _walk(root) if n.tag == "body"), root)
    if aligned is None:
        return found or [body]
    chosen = aligned.root(root)
    if not found:
        return [chosen]
    inside = {id(n) for n in _walk(chosen)}
    if any(id(n) in inside for n in found):
        return [n for n in found if id(n) in inside]
    above, n = [], chosen
    while (n := aligned.parents.get(id(n))) is not None:
        above.append(id(n))
    return [n for n in found if id(n) in above] or [chosen]


def blocks(node: Node, aligned: Aligned | None) -> list[str]:
    """Texts of the blocks in page order, without furniture and template."""
    out: list[str] = []
    now: list[str] = []
    within = node.tag not in ("body", "html", "#root")

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif x is None:
            close()
        elif x is node or not (x.boilerplate(within) or (aligned is not None and x.tag in BLOCKS and aligned.template(x))):
            if x.tag == "br":
                now.append(" ")
            elif x.tag in BLOCKS:
                close()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
    close()
    return out


def extract(source: str, wrapper: Wrapper | None) -> str:
    """The main text of a page, given its host's settled wrapper. A content root without any varying text has no template: it is all that tells."""
    root = parse(source)
    aligned = Aligned(root, wrapper) if wrapper is not None and len(wrapper.pages) >= MIN_PAGES else None
    found = []
    for node in content_roots(root, aligned):
        slot = aligned.slots.get(id(node)) if aligned is not None else None
        found += blocks(node, aligned if slot is not None and slot.text else None)
    return "\n".join(found)


# --- Spark -----------------------------------------------------------------------------------------------


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: one row for each host of ``pages`` (page_id, url, html)."""
    schema = "host string, shape long, wrapper binary"
    partial = arrow_schema(schema)

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Wrapper] = {}

        def flush() -> pa.RecordBatch:
            rows = {"host": [h for h, _ in held], "shape": [k for _, k in held], "wrapper": [w.dump() for w in held.values()]}
            held.clear()
            return to_batch(rows, partial)

        for b in batches:
            for url, source in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                root = parse(source)
                if all(isinstance(c, str) for c in root.children):
                    continue  # no elements: nothing to align, and no page that could lack a template
                w = page_wrapper(root, source)
                key = split_url(url)[0], w.shape
                held[key] = held[key].add(w) if key in held else w
            if len(held) >= HOSTS:
                yield flush()
        if held:
            yield flush()

    def together(batches: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
        """Wrappers of one host and salt as one; rows come by host, salt and shape."""
        now: tuple[str, int] | None = None
        held: Wrapper | None = None

        def close() -> pa.RecordBatch:
            return to_batch({"host": [now[0]], "shape": [held.shape], "wrapper": [held.dump()]}, partial)

        for b in batches:
            for host, shape, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w, key = Wrapper.load(data), (host, shape % salts if salts else shape)
                if key == now:
                    held = held.add(w)
                    continue
                if now is not None:
                    yield close()
                now, held = key, w
        if now is not None:
            yield close()

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(induce, schema)
    # pages of one shape add up first; a host of many shapes is matched in 16 places, then in one, always in the order of shapes
    for salts in (0, 16, 1):
        salt = F.col("shape") if not salts else F.col("shape") % salts
        by = ["host", salt] if salts != 1 else ["host"]
        rows = rows.repartition(*by).sortWithinPartitions("host", salt, "shape").mapInArrow(lambda b, salts=salts: together(b, salts), schema)
    return materialize(rows.select("host", "wrapper"), "wrappers")


def host_of(url: Column) -> Column:
    """The host that ``split_url`` finds."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), capitals, capitals.lower()), F.lit(""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``.

    Null or empty html gives an empty text; a null URL has the empty host, which is a host like any other.
    Repeated rows get a row each; they count once where a host's distinct pages are counted. Pages without elements
    aren't counted. A host with fewer
    than ``MIN_PAGES`` distinct pages has no template. Empty table: no rows. Other columns are not read. Pages
    of any length are read whole.
    """
    found = wrappers(pages)
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    host = host_of(F.col("url"))
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, text string"
    arrow = arrow_schema(schema)
    small_batches(pages.sparkSession)
    if size <= BROADCAST_BYTES:
        known = {r["host"]: r["wrapper"] for r in found.collect()}  # BROADCAST_BYTES at most
        shared = pages.sparkSession.sparkContext.broadcast(known)
        rows = picked.select("page_id", "url", "html", F.lit(None).cast("binary").alias("wrapper"))
    else:
        # many hosts: a join that adaptive execution splits where a host has many pages
        shared = None
        rows = picked.withColumn("_host", host).join(found.withColumnRenamed("host", "_host"), "_host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[bytes | str, Wrapper] = {}

        def wrapper_of(url: str | None, data: bytes | None) -> Wrapper | None:
            key = split_url(url)[0] if data is None else data
            if key not in loaded:
                source = data if shared is None else shared.value.get(key)
                if len(loaded) >= 500:
                    loaded.clear()
                loaded[key] = Wrapper.load(source).settled() if source is not None else None
            return loaded[key]

        for b in batches:
            urls = b.column(1).to_pylist()
            out = [extract(s, wrapper_of(u, w)) for u, s, w in zip(urls, texts(b.column(2)), b.column(3).to_pylist(), strict=True)]
            yield to_batch({"page_id": b.column(0), "url": b.column(1), "text": out}, arrow)

    return rows.mapInArrow(run, schema)


def op4(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
