"""Operator 9: main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's token streams, held as a tree: an element is
its start tag, the expression of what is inside, and its end tag. It starts as the first page. Each further
page is aligned to it: elements of one signature (tag, class, id) are paired in order, what stands on one
side alone becomes optional, neighbours of one shape, or of up to four shapes in turn, become a repeated
group, and texts that differ become a text slot, while texts that agree stay constants. All pages of a host
take part: tasks fold their pages into one expression for each host, and those are aligned to each other, at
first those of a salt, then those of a host, so a host with a third of all pages holds up no task. An
expression's size does not grow with the pages: groups hold repeats once, a slot counts its texts in a
summary of `KEPT` counters (which keeps every text that stands in more than 1 of KEPT of its pages), and
past `MAX_NODES` nodes no new optional part is added; texts in such parts go with the element they stand in.

`judge` then reads off which slots are the article: those inside the host's article or main element, or, if
its pages have none, inside the innermost element that holds most of the running text (not links) of the
pages it stands in, with the headings of the elements around it. In the second case repeated links and constants are not article text either, unless
constants make up most of it, as on a host of copies.

`extract` matches a page against its host's expression, which puts each text into a slot, and takes the
texts of the article's slots. Elements that are menus, headers, footers, sidebars, notices, adverts, forms
or comments by name, role or class are left out before that (`names`; the tests also hold results without). Inside
an article a class or id says so only by a whole name (`related-posts`, not `related-work`).

Defined cases: null or empty html gives an empty text; a page without a known host, or of a host of under
`MIN_PAGES` pages, is read by names and classes alone, as is a page none of whose texts falls into a slot
of the article; broken markup never fails (an unknown end tag is ignored, an end tag closes what is open
inside it; nothing recurses, so depth does not matter); repeated rows give a row each; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import discard, materialize

MIN_PAGES = 4
MAX_NODES = 4000
MAX_DEPTH = 200
KEPT = 32
MAIN_SHARE = 0.6
CONSTANT_SHARE = 0.5
SALTS = 64
HELD_NODES = 200_000
MAX_CELLS = 250_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title canvas object audio video annotation annotation-xml desc metadata".split())
DROPPED = frozenset("head nav footer aside form button select option label input dialog menu menuitem fieldset".split())
MATH = "math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle mspace mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics"
INLINE = frozenset(f"{MATH} svg tspan a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr data img".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: fixed values: words of class and id names that mark what is not the article
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar topbar sidebar side aside footer foot banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs pagination pager share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond reply replies widget toolbar skip search searchbox copyright masthead".split()
)
#: fixed values: words that say nothing of what an element holds, in names made of several
LAYOUT = frozenset("area bar block body bottom box button buttons card cards container content count footer form group header heading head holder inner item items left link links list main new on outer panel post posts right row section slot text thread title top unit us wrap wrapper".split())
HEADER = frozenset(("header",))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that hold text rather than parts of a page
TEXT_LEVEL = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tr td th figure figcaption address hr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*)>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPLIT = re.compile(r"[^a-z]+")


class Block:
    """A block element of a page: what is inside in page order, blocks and texts."""

    __slots__ = ("sig", "tag", "main", "items")

    def __init__(self, sig: str, tag: str, main: bool = False):
        self.sig, self.tag, self.main = sig, tag, main
        self.items: list = []  # Block, or (text, characters in links)


def is_boilerplate(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of an article, by its name, role, class or id; inside: in an article already."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("body", "html", "main"):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower()
    if inside:
        parts = [set(filter(None, _SPLIT.split(n))) for n in names.split()]
        return any(p & BOILERPLATE and p <= BOILERPLATE | LAYOUT for p in parts)
    words = set(_SPLIT.split(names))
    return bool(words & (BOILERPLATE | HEADER))


def signature(tag: str, a: dict[str, str]) -> str:
    name = " ".join(sorted(a.get("class", "").lower().split())[:3])
    ident = a.get("id", "").lower()
    return tag + (f".{name}" if name else "") + (f"#{ident}" if ident and not any(c.isdigit() for c in ident) else "")


def parse(page: str, names: bool = True) -> Block:
    """A tolerant tree of a page's blocks; white space is one space. Scripts, styles, comments and, with names, boilerplate are left out."""
    root = Block("#root", "#root")
    stack: list[tuple] = [("#root", root, False, False, False)]  # (tag, block around or of it, in a link, left out, in an article)
    depth: Counter = Counter()
    parts: list[str] = []
    links = at = 0

    def flush(block: Block) -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            block.items.append((text, min(links, len(text))))
        parts.clear()
        links = 0

    def close(to: int) -> None:
        while len(stack) > to:
            tag, block, *_ = stack.pop()
            depth[tag] -= 1
            if tag not in INLINE:
                flush(block)

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not stack[-1][3]:
            text = entities.unescape(text)
            parts.append(text)
            if stack[-1][2]:
                links += len(" ".join(text.split()))
        if not m:
            close(0)
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if depth[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
        while stack[-1][0] in SELF_CLOSING.get(tag, ()):
            close(len(stack) - 1)
        if tag in CLOSES_P and depth["p"]:
            to = len(stack) - 1
            while stack[to][0] in INLINE:
                to -= 1
            if stack[to][0] == "p":
                close(to)
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if tag == "br":
            parts.append(" ")
            continue
        _, around, link, out, inside = stack[-1]
        out = out or (names and is_boilerplate(tag, attrs, inside))
        block = around
        if tag not in INLINE:
            flush(around)
            if not out:
                main = tag in ARTICLE or attrs.get("role", "").lower() == "main"
                inside = inside or main
                block = Block(signature(tag, attrs), tag, main)
                around.items.append(block)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((tag, block, link or tag == "a", out, inside))
            depth[tag] += 1


# --- expressions ------------------------------------------------------------------------------------


class Part:
    """A part of an expression: an element, a group of parts in turn, or a text. On a page it also knows its texts' places."""

    __slots__ = ("sig", "unit", "kids", "optional", "repeated", "main", "pages", "chars", "links", "total", "texts", "places", "keep", "drop")

    def __init__(self, sig: str, unit: tuple[str, ...] = (), main: bool = False):
        self.sig, self.unit, self.main = sig, unit, main
        self.kids: list[Part] = []
        self.optional = self.repeated = self.keep = False
        self.pages, self.chars, self.links, self.total = 1, 0, 0, 0
        self.texts: dict[str, list[int]] = {}  # key: pages, characters
        self.places: list[int] = []
        self.drop: frozenset[str] = frozenset()


TEXT = "#text"


def text_key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def walk(root: Part) -> list[tuple[Part, int]]:
    """(part, place of what it is in) in order."""
    out, todo = [], [(root, -1)]
    while todo:
        part, up = todo.pop()
        out.append((part, up))
        todo += [(k, len(out) - 1) for k in reversed(part.kids)]
    return out


def add_texts(a: Part, b: Part, same_page: bool) -> None:
    for key, (n, size) in b.texts.items():
        if key in a.texts:
            a.texts[key][0] = max(a.texts[key][0], n) if same_page else a.texts[key][0] + n
        else:
            a.texts[key] = [n, size]
    if len(a.texts) > KEPT and not same_page:
        least = sorted((n for n, _ in a.texts.values()), reverse=True)[KEPT]
        a.texts = {key: [n - least, size] for key, (n, size) in a.texts.items() if n > least}


def grouped(kids: list[Part], units: set[tuple[str, ...]]) -> list[Part]:
    """kids with those that stand in turn as one of units put into a group."""
    out: list[Part] = []
    i = 0
    while i < len(kids):
        for unit in units:
            if len(kids) - i >= len(unit) and kids[i].sig == unit[0] and tuple(k.sig for k in kids[i : i + len(unit)]) == unit:
                group = Part(f"({','.join(unit)})", unit)
                group.kids, group.pages, group.total = kids[i : i + len(unit)], kids[i].pages, kids[i].total
                group.keep = all(k.keep for k in group.kids)
                out.append(group)
                i += len(unit)
                break
        else:
            out.append(kids[i])
            i += 1
    return out


def pairs(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of x and y that are aligned, in order."""
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    a, b = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if a and b and len(a) * len(b) <= MAX_CELLS:
        for i, j, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            out += [(lo + i + k, lo + j + k) for k in range(n)]
    elif a and b:  # too long for that: each of b with the next of its kind in a
        places: dict[str, list[int]] = {}
        for i in range(len(a) - 1, -1, -1):
            places.setdefault(a[i], []).append(i)
        at = -1
        for j, sig in enumerate(b):
            left = places.get(sig, [])
            while left and left[-1] <= at:
                left.pop()
            if left:
                at = left.pop()
                out.append((lo + at, lo + j))
    return out + [(len(x) - hi + k, len(y) - hi + k) for k in range(hi)]


def align(a: Part, b: Part, same_page: bool = False, room: int = MAX_NODES) -> None:
    """Make a the least expression of both; b is used up. room: how many parts of b alone may be added."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        p.pages = max(p.pages, q.pages) if same_page else p.pages + q.pages
        p.total = max(p.total, q.total) if same_page else p.total + q.total
        p.optional, p.repeated, p.main = p.optional or q.optional, p.repeated or q.repeated, p.main or q.main
        p.chars, p.links = p.chars + q.chars, p.links + q.links
        p.places += q.places
        if q.texts:
            add_texts(p, q, same_page)
        if not p.kids and not q.kids:
            continue
        mine, other = p.kids, q.kids
        if units := {k.unit for k in other if k.unit}:
            mine = grouped(mine, units)
        if units := {k.unit for k in mine if k.unit}:
            other = grouped(other, units)
        kids: list[Part] = []
        i = j = 0
        for x, y in [*pairs([k.sig for k in mine], [k.sig for k in other]), (len(mine), len(other))]:
            for k in mine[i:x]:
                k.optional = True
                kids.append(k)
            for k in other[j:y]:
                if same_page or room > 0:
                    k.optional = True
                    kids.append(k)
                    room -= 1
            if x < len(mine):
                kids.append(mine[x])
                todo.append((mine[x], other[y]))
            i, j = x + 1, y + 1
        p.kids = kids


def in_turn(kids: list[Part]) -> list[Part]:
    """kids with repeats folded into groups: neighbours of one signature, then two to four signatures in turn."""
    out: list[Part] = []
    for k in kids:
        if out and out[-1].sig == k.sig:
            align(out[-1], k, True)
            out[-1].repeated = True
        else:
            out.append(k)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(out):
            unit = tuple(k.sig for k in out[i : i + size])
            end = i + size
            while tuple(k.sig for k in out[end : end + size]) == unit:
                end += size
            if end > i + size:
                first, *more = grouped(out[i:end], {unit})
                for k in more:
                    align(first, k, True)
                first.repeated = True
                out[i:end] = [first]
            i += 1
    return out


def expression(root: Block) -> tuple[Part, list[str], list[bool]]:
    """A page as an expression, its texts in page order, and whether each is in an article."""
    texts: list[str] = []
    articles: list[bool] = []
    top = Part(root.sig)
    order: list[Part] = []
    todo: list[tuple] = [(root, top, 0, False)]
    while todo:
        item, part, depth, inside = todo.pop()
        if isinstance(item, tuple):
            text, links = item
            leaf = Part(TEXT)
            leaf.texts, leaf.chars, leaf.links, leaf.places = {text_key(text): [1, len(text)]}, len(text), links, [len(texts)]
            texts.append(text)
            articles.append(inside)
            part.kids.append(leaf)
            continue
        if item is not root and depth <= MAX_DEPTH:  # deeper blocks' texts go with the block at that depth
            own = Part(item.sig, main=item.main)
            part.kids.append(own)
            part = own
        if part is top or depth <= MAX_DEPTH:
            order.append(part)
        todo += [(x, part, depth + 1, inside or item.main) for x in reversed(item.items)]
    for part in reversed(order):
        part.kids = in_turn(part.kids)
    parts = walk(top)
    total = sum(p.chars - p.links for p, _ in parts)
    for p, _ in parts:
        p.total = total
    return top, texts, articles


def dump(root: Part, judged: bool = False) -> str:
    """An expression as JSON; judged: only what matching needs."""
    rows = []
    for p, up in walk(root):
        more = [p.keep, sorted(p.drop)] if judged else [p.pages, p.chars, p.links, p.total, p.texts]
        rows.append([up, p.sig, p.unit, p.optional, p.repeated, p.main, *more])
    return json.dumps(rows, separators=(",", ":"))


def load(data: str, judged: bool = False) -> Part:
    parts: list[Part] = []
    for up, sig, unit, optional, repeated, main, *more in json.loads(data):
        p = Part(sig, tuple(unit), main)
        p.optional, p.repeated = optional, repeated
        if judged:
            p.keep, p.drop = more[0], frozenset(more[1])
        else:
            p.pages, p.chars, p.links, p.total, p.texts = more
        if up >= 0:
            parts[up].kids.append(p)
        parts.append(p)
    return parts[0]


def tag_of(p: Part) -> str:
    return re.match(r"#?[^.#]*", p.sig)[0]


def judge(root: Part, names: bool = True) -> None:
    """Set keep on the parts of the article, and drop, the keys of constants that are none of it, on its texts."""
    parts = walk(root)
    if root.pages < MIN_PAGES:
        return
    running = [p.chars - p.links for p, _ in parts]
    held = [p.chars for p, _ in parts]
    for i in range(len(parts) - 1, 0, -1):
        running[parts[i][1]] += running[i]
        held[parts[i][1]] += held[i]
    named = [i for i, (p, _) in enumerate(parts) if names and p.main and 2 * p.pages >= root.pages]
    mains = set(named)
    if not named:
        for i, (p, _) in enumerate(parts):
            if p.sig != TEXT and not p.unit and not p.repeated and tag_of(p) not in TEXT_LEVEL and p.pages >= MIN_PAGES and running[i] >= MAIN_SHARE * p.total:
                mains.add(i)
        for i in sorted(mains, reverse=True):  # only the innermost stay
            up = parts[i][1]
            while up >= 0:
                mains.discard(up)
                up = parts[up][1]
        heads = {i for i, (p, _) in enumerate(parts) if tag_of(p) in HEADINGS}
        for i in list(mains):  # headings of the elements around the innermost one
            up = parts[i][1]
            while up > 0 and tag_of(parts[up][0]) not in ("html", "body"):
                mains |= {k for k in heads if k < i and parts[k][1] == up}
                up = parts[up][1]
    constants: list[tuple[Part, frozenset[str], int]] = []
    article = 0
    listed = [False] * len(parts)
    for i, (p, up) in enumerate(parts):
        p.keep = i in mains or (up >= 0 and parts[up][0].keep)
        listed[i] = up >= 0 and listed[up] or p.repeated and held[i] > 0 and running[i] <= 0.2 * held[i]
        if not named and p.sig == TEXT and p.keep:
            article += p.chars
            if listed[i]:
                p.keep = False
            else:
                often = {k: n * size for k, (n, size) in p.texts.items() if n >= max(MIN_PAGES, CONSTANT_SHARE * root.pages)}
                constants.append((p, frozenset(often), sum(often.values())))
    if sum(x[2] for x in constants) <= 0.5 * article:
        for p, keys, _ in constants:
            p.drop = keys


def slots(page: Part, wrapper: Part, texts: int) -> list[Part | None]:
    """The part of the wrapper that each text of the page falls into: its slot, or else the innermost element that is matched."""
    out: list[Part | None] = [None] * texts
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        for place in p.places:
            out[place] = w
        mine, other = w.kids, p.kids
        if units := {k.unit for k in mine if k.unit}:
            other = grouped(other, units)
        if units := {k.unit for k in other if k.unit} - units:
            mine = grouped(mine, units)
        met = pairs([k.sig for k in mine], [k.sig for k in other])
        todo += [(mine[i], other[j]) for i, j in met]
        for j in set(range(len(other))) - {j for _, j in met}:
            for q, _ in walk(other[j]):
                for place in q.places:
                    out[place] = w
    return out


def extract(page: str, wrapper: Part | None = None, names: bool = True) -> str:
    """Main text of one page under its host's wrapper."""
    top, texts, articles = expression(parse(page, names))
    if wrapper is not None:
        kept = [t for t, w in zip(texts, slots(top, wrapper, len(texts)), strict=True) if w is not None and w.keep and not (w.drop and text_key(t) in w.drop)]
        if kept:
            return " ".join(kept)
    if any(articles):
        texts = [t for t, inside in zip(texts, articles, strict=True) if inside]
    return " ".join(texts)


# --- over all pages ---------------------------------------------------------------------------------


def fold_pages(pages: list[str], names: bool = True) -> Part | None:
    """The expression of some pages of a host."""
    out: Part | None = None
    for page in pages:
        out = _joined(out, expression(parse(page, names))[0])
    return out


def _joined(a: Part | None, b: Part) -> Part:
    for p, _ in walk(b):
        p.places = []
    if a is None:
        return b
    align(a, b, room=MAX_NODES - len(walk(a)))
    return a


def wrappers(pages: DataFrame, names: bool = True) -> DataFrame:
    """(host, wrapper as JSON) for each host of MIN_PAGES pages or more, from all its pages. pages has host and html."""
    schema = "host string, salt int, part string"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "salt", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}
        size = 0
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = expression(parse(page.as_py(), names))[0]
                size += 1 if host in held else len(walk(new))
                held[host] = _joined(held.get(host), new)
            if size > HELD_NODES:
                yield batch_of([(h, salt, dump(p)) for h, p in held.items()])
                held, size = {}, 0
        if held:
            yield batch_of([(h, salt, dump(p)) for h, p in held.items()])

    def merge(last: bool):
        def reduce(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Part | None = None
            for batch in batches:
                for x in batch.column(batch.schema.get_field_index("part")):
                    out = _joined(out, load(x.as_py()))
            if last:
                judge(out, names)
                if out.pages < MIN_PAGES:
                    return
            yield batch_of([(key[0].as_py(), 0, dump(out, last))])

        return reduce

    parts = pages.select("host", "html").mapInArrow(run, schema)
    salted = parts.groupBy("host", "salt").applyInArrow(merge(False), schema)
    return salted.groupBy("host").applyInArrow(merge(True), schema).select("host", F.col("part").alias("wrapper"))


def main_text(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. names: leave out what is boilerplate by name, role or class."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)).alias("host"),
    )
    known = materialize(wrappers(rows.where("host != '' and html != ''"), names), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Part] = {}
        for batch in batches:
            text = []
            for page, w in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if w and w not in cache:
                    if len(cache) > 256:
                        cache.clear()
                    cache[w] = load(w, True)
                text.append(extract(page.as_py(), cache[w] if w else None, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
