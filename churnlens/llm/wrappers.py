"""Main text by wrappers: union-free regular expressions of a host's pages (operator 6).

A page is a stream of tags and texts. Matching tags nest, so the expression of a stream
is held level by level: the expression of an element's content is a sequence of units, each
one item, an optional item (?), or a repeated group of items (+). There are no
alternatives (union-free). Two expressions of one host are aligned by their longest common
blocks of items (difflib), and each mismatch is resolved: a text that differs becomes a slot;
an item that only one side has becomes optional; an item that comes again makes a
repeated group of all from its first to its last place. Within a level each item
then stands once, so a wrapper's size depends on the host's layouts, not on its pages, and
a page is matched by walking down the expression.

Each task aligns its own pages by host and hands on one expression per host; these are
aligned in turn, one at a time, so a host with a third of all pages costs a row per task.
All pages take part in inference and in extraction. The wrappers table has one row per host;
the planner joins it to the pages and broadcasts it only while it is small.

The content is what stands inside <article> (or main, or role=main), or without these in
the body, less the template and less boilerplate elements. The wrapper decides on both,
inside regions as outside. Template are the texts that are the same on (nearly) all
different pages of a host with three different pages or more, so none that is optional or
stands below an optional element; inside a region headings and other names of what follows stay, though every
page has them. Copies of a page count as one page, pages without text as
none, and a page of template texts only keeps them. Boilerplate elements are those of fixed lists of elements and of
words in class, id or role, which must make up a whole word ("site-header", not "social-science"); a form that holds
most of the host's text in slots is the page's layout and is read. Text that differs from page to page, reader comments say, is told from
main text by the lists only, and so is all else on a host with one or two pages.

Rows: null or empty html gives an empty text; pages whose url is null or has no host
form one host; repeated rows are each returned; an unclosed or truncated page is
closed at its end; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common

HOSTS_HELD = 2000
MAX_DEPTH = 100
#: a constant text on this share of a host's different pages is template: with fewer than 20 pages, on all
NEARLY_ALL = 0.95
#: a form around this share of a host's characters in slots is the page's layout and is read
MOST = 0.8
TEXT = "#"
LEX = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# HTML elements without content, elements that end an open paragraph, and elements that set a block apart
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
# Elements that never hold main text; elements, and words in class, id or role, that rarely do
SILENT = frozenset("head script style select option button".split())
BOILERPLATE = frozenset("head nav header footer aside form button select option label dialog menu script style".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent notice share sharing social related recommended comment comments disqus "
    "reply replies footer header masthead newsletter subscribe signup popup modal widget toolbar pagination pager login".split())
# Words that only say where or how large such an element is, so "site-header" names one and "social-science" none
PLACE_WORDS = frozenset(
    "area bar block body bottom box button buttons card cell col column container content element fixed float floating form "
    "global group holder icon icons inner item items label layer layout left line link links list lower main mini mobile "
    "outer overlay page panel placeholder primary region right row secondary section side site slot small sticky strip tab "
    "text thread title tool top unit upper view wrap wrapper zone".split())
# Elements whose text names what follows; it may be the same on every page of a host
NAMES = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption summary".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table article section div main body".split())


class Node:
    """An element of a page; children are nodes and texts."""

    __slots__ = ("children", "key", "tag")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.children = tag, key, []


def _key(tag: str, attrs: str) -> str:
    """The tag with its class, id and role words; digits are dropped, so that running numbers agree."""
    if not attrs or "=" not in attrs:
        return tag
    words = " ".join(x for m in MARKS.findall(attrs) for x in m if x).lower()
    parts = sorted({w for w in re.sub(r"\d+", "", words).split()})
    return f"{tag}.{'.'.join(parts)}" if parts else tag


def parse(source: str | None) -> Node:
    """The element tree of a page; missing end tags are supplied."""
    root = Node("html", "html")
    path = [root]
    flat: dict[str, int] = {}  # open elements below MAX_DEPTH: they part blocks, and their content stays on that level
    for m in LEX.finditer(source or ""):
        text = m["text"]
        if text is not None:
            if text.strip():
                path[-1].children.append(text)
            elif path[-1].children and isinstance(path[-1].children[-1], str):
                path[-1].children[-1] += " "
            else:  # white space between two elements parts their texts
                path[-1].children.append(" ")
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if flat.get(tag):
                flat[tag] -= 1
                path[-1].children.append(Node(tag, _key(tag, "")))
                continue
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag == tag:
                    del path[i:]
                    break
                if path[i].tag in BARRIER and tag not in BARRIER and tag not in BLOCKS:
                    break
            continue
        if tag == "html":
            continue
        # an open paragraph ends where a block starts; list items and cells end at the next
        ends = SAME_LEVEL.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for i in range(len(path) - 1, 0, -1):
            if path[i].tag in ends:
                del path[i:]
                break
            if path[i].tag in BARRIER:
                break
        node = Node(tag, _key(tag, m["attrs"]))
        path[-1].children.append(node)
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            if len(path) < MAX_DEPTH:
                path.append(node)
            else:
                flat[tag] = flat.get(tag, 0) + 1
    return root


# An item is [key, what, optional]: what is the content's units of an element, or for a text the checksum
# of the one text seen, None for a slot. A text also has the number of different pages that hold it, and its characters on these. A unit is a list of items: one, or several or one with a leading "+".

def _items(unit: list) -> list:
    return unit[1:] if unit[0] == "+" else unit


def _join_items(a: list, b: list, same_page: bool) -> list:
    optional = a[2] or b[2]
    if a[0] == TEXT:
        return [TEXT, a[1] if a[1] == b[1] else None, optional, max(a[3], b[3]) if same_page else a[3] + b[3],
                a[4] + b[4]]
    return [a[0], align(a[1], b[1], same_page), optional]


def collapse(units: list, same_page: bool) -> list:
    """Make repeated groups, so that every key stands once in the sequence."""
    first: dict[str, int] = {}
    spans: list[list[int]] = []
    for i, unit in enumerate(units):
        for item in _items(unit):
            if item[0] in first:
                at = first[item[0]]
                while spans and spans[-1][1] >= at:
                    at = min(at, spans.pop()[0])
                spans.append([at, i])
            else:
                first[item[0]] = i
    if not spans:
        return units
    out, done = [], 0
    for a, b in spans:
        out += units[done:a]
        merged: dict[str, list] = {}
        for unit in units[a:b + 1]:
            for item in _items(unit):
                merged[item[0]] = _join_items(merged[item[0]], item, same_page) if item[0] in merged else item
        single = len(merged) == 1
        out.append(["+", *[[k, w, o if single else True, *n] for k, w, o, *n in merged.values()]])
        done = b + 1
    return out + units[done:]


def expression(node: Node, share: float = 1.0) -> list:
    """The expression of one element's content; of n copies of a page, each counts with a share of 1/n."""
    units = [[[TEXT, zlib.crc32(" ".join(c.split()).encode()), False, share, share * len(c)]] if isinstance(c, str)
             else [[c.key, expression(c, share), False]] for c in node.children if not isinstance(c, str) or c.strip()]
    return collapse(units, True)


def align(a: list, b: list, same_page: bool = False) -> list:
    """An expression for all that ``a`` or ``b`` stands for: places of one page, or different pages."""
    keys_a, keys_b = ([tuple(i[0] for i in _items(u)) for u in x] for x in (a, b))
    out: list = []

    def optional(units: list) -> list:
        return [[u[0], *[[k, w, True, *n] for k, w, _, *n in u[1:]]] if u[0] == "+"
                else [[k, w, True, *n] for k, w, _, *n in u] for u in units]
    codes = ([("equal", 0, len(a), 0, len(b))] if keys_a == keys_b
             else SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes())
    for op, i, j, k, m in codes:
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                joined = [_join_items(p, q, same_page) for p, q in zip(_items(x), _items(y), strict=True)]
                out.append(["+", *joined] if "+" in (x[0], y[0]) else joined)
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return out if keys_a == keys_b else collapse(out, same_page)


def _has_text(node: Node) -> bool:
    return any(c.strip() if isinstance(c, str) else _has_text(c) for c in node.children)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, float]] = {}
    for batch in batches:
        for host, source, copies in zip(*(batch.column(c) for c in ("host", "html", "copies")), strict=True):
            page, share = parse(source.as_py()), 1 / copies.as_py()
            own, n = expression(page, share), share if _has_text(page) else 0.0
            known = held.get(host := host.as_py())
            held[host] = (align(known[0], own), known[1] + n) if known else (own, n)
            if len(held) >= HOSTS_HELD:
                yield _wrapper_rows(held)
                held = {}
    if held:
        yield _wrapper_rows(held)


def _wrapper_rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.string()), pa.array([json.dumps(w) for w, _ in held.values()], pa.string()),
         pa.array([n for _, n in held.values()], pa.float64())], names=["host", "wrapper", "n_pages"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host = whole = None
    n = 0.0
    for batch in batches:  # rows of a host stand together
        for h, w, k in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "n_pages")), strict=True):
            if whole is not None and h != host:
                yield _wrapper_rows({host: (whole, n)})
                whole = None
            whole, n = (json.loads(w), k) if whole is None else (align(whole, json.loads(w)), n + k)
            host = h
    if whole is not None:
        yield _wrapper_rows({host: (whole, n)})


WRAPPERS = "host string, wrapper string, n_pages double"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), n_pages (different pages with text) for every host of ``pages``.

    Only the pages that have copies are written with their counts; the join leaves the pages
    where they are while that table is small.
    """
    own = pages.select(host_of(F.col("url")).alias("host"), "html", F.md5(F.coalesce("html", F.lit(""))).alias("page"))
    copies = common.stored(own.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "page-copies")
    counted = own.join(copies, ["host", "page"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    parts = counted.mapInArrow(_infer, WRAPPERS)
    together = parts.repartition("host").sortWithinPartitions("host", "wrapper")
    return common.stored(together.mapInArrow(_merge, WRAPPERS), "page-wrappers")


def boilerplate(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in BOILERPLATE or any(map(_names_boilerplate, words))


@lru_cache(maxsize=4096)
def _names_boilerplate(word: str) -> bool:
    """Whether a whole class, id or role word names boilerplate: every part of it must, or say a place."""
    parts = {p for p in re.split(r"[^a-z]+", word) if p}
    return not parts.isdisjoint(BOILER_WORDS) and parts <= BOILER_WORDS | PLACE_WORDS


def is_region(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in ("article", "main") or "main" in words


class Wrapper:
    """A host's expression, ready to walk pages along it."""

    def __init__(self, text: str, n_pages: float):
        self.units, self.n_pages = json.loads(text), n_pages
        self.levels: dict[int, dict] = {}
        self.varying: dict[int, float] = {}
        self._index(self.units)
        self.has_region = self._regions(self.units)

    def _index(self, units: list) -> float:
        """Items by key of each level, and the characters in slots at and below it."""
        known = self.levels[id(units)] = {item[0]: item for unit in units for item in _items(unit)}
        total = 0.0
        for key, item in known.items():
            if key == TEXT:
                total += item[4] if item[1] is None else 0.0
            else:
                below = self._index(item[1])
                total += 0.0 if key.split(".")[0] in SILENT else below
        self.varying[id(units)] = total
        return total

    def _left_out(self, key: str, item: list | None) -> bool:
        """Whether an element is boilerplate: the lists say so, and it is no form in which the wrapper finds most of the slots."""
        if not boilerplate(key):
            return False
        if key != "form" or item is None:
            return True
        return not 0 < self.varying[id(self.units)] * MOST <= self.varying[id(item[1])]

    def _regions(self, units: list) -> bool:
        return any(key != TEXT and not self._left_out(key, item) and (is_region(key) or self._regions(item[1]))
                   for key, item in self.levels[id(units)].items())

    def _has_region(self, node: Node, units: list) -> bool:
        known = self.levels.get(id(units), {})
        for c in node.children:
            if not isinstance(c, str) and not self._left_out(c.key, item := known.get(c.key)) and (
                    is_region(c.key) or self._has_region(c, item[1] if item else [])):
                return True
        return False

    def _template(self, item: list | None) -> bool:
        """Whether a text stands the same on nearly all of three different pages or more; n_pages is a sum of shares."""
        return (self.n_pages > 2.5 and item is not None and item[1] is not None
                and item[3] >= NEARLY_ALL * self.n_pages)

    def main_text(self, source: str | None) -> str:
        root = parse(source)
        return self._read(root, True) or self._read(root, False)

    def _read(self, root: Node, drop_template: bool) -> str:
        blocks: list[list[str]] = [[]]
        regional = self.has_region and self._has_region(root, self.units)  # a page without a region is read like a host without one

        def walk(node: Node, units: list, inside: bool, named: bool) -> None:
            known = self.levels.get(id(units), {})
            for child in node.children:
                if isinstance(child, str):
                    if inside:
                        template = drop_template and not named and self._template(known.get(TEXT))
                        blocks[-1].append(" " if template else child)
                    continue
                item = known.get(child.key)
                if self._left_out(child.key, item):
                    continue
                apart = child.tag in BLOCKS
                if apart:
                    blocks.append([])
                elif child.tag == "br":
                    blocks[-1].append(" ")
                within = inside or is_region(child.key)
                walk(child, item[1] if item else [], within, named or (regional and inside and child.tag in NAMES))
                if apart:
                    blocks.append([])
        walk(root, self.units, not regional, False)
        lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


@lru_cache(maxsize=512)
def _wrapper(text: str, n_pages: float) -> Wrapper:
    return Wrapper(text, n_pages)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("html", "wrapper", "n_pages")]
        texts = [_wrapper(w, n).main_text(source) for source, w, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page."""
    wrappers = infer_wrappers(pages)
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return own.join(wrappers, "host").select("page_id", "url", "html", "wrapper", "n_pages").mapInArrow(
        _extract, "page_id bigint, url string, text string")


def op6_page_wrappers(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
