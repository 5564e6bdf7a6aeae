"""Operator 9: main-text extraction by consensus paths of a host."""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cuts, column, near, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas object select button menu dialog head textarea title math video audio".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCKS = frozenset("div section ul ol dl table tr td aside form fieldset center details figure".split())
#: Words of class names, ids and roles of what is not main text. The first list counts as a name's first or last word;
#: the second only on blocks, alone, as the last word, or before a word of the third.
NOISE = frozenset("nav navbar navigation menu sidebar footer header masthead banner advert adverts advertisement ad ads adsense promo promotion sponsor sponsored cookie cookies consent gdpr popup modal overlay comment comments disqus replies respond social sharing related recommended breadcrumb breadcrumbs newsletter subscribe subscription pagination pager toolbar widget widgets skip".split())
WEAK = frozenset("notice notices alert alerts reply share signup login search copyright form feedback disclaimer".split())
HOLDERS = frozenset("area bar block box button buttons container field form group holder inner item items link links list panel row slot strip wrap wrapper".split())
READERS = frozenset("comment comments disqus replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_STARTS = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_ENDS = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words before "header" that make it the head of the article.
HEADED = frozenset("article content entry post story".split())
#: Shares of a page's text from which an element stays whatever its name says, unless it holds readers' comments: with an article in it, and without.
HALF, MASS = 0.5, 0.9


class _Node:
    __slots__ = ("chars", "dropped", "main", "noise", "path", "tag", "up")

    def __init__(self, tag: str, path: str, up: _Node | None, noise: int):
        self.tag, self.path, self.up, self.noise, self.chars, self.main, self.dropped = tag, path, up, noise, 0, False, False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def _name_is_noise(name: str, block: bool) -> str:
    """The noise word that a class name or id is about, or nothing. What is with, or has, a sidebar is not one."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or {"with", "has", "no", "without"} & set(words):
        return ""
    for w in (words[0], words[-1]):
        if w in NOISE and not (w == "header" and words[0] in HEADED):
            return w
    if block and (words[-1] in WEAK or words[0] in WEAK and words[1] in HOLDERS):
        return words[0]
    return ""


def _noise(tag: str, a: dict[str, str], within: bool) -> int:
    """0: nothing against an element; 1: never main text; 2: not, by its name; 3: readers' comments. ``within``: inside an article."""
    if tag in DROPPED and not (tag == "header" and within):
        return 1
    if not a or tag in ("html", "body", "main"):
        return 0
    if tag == "article":
        return 3 * any(_name_is_noise(x, False) in READERS for x in f"{a.get('class', '')} {a.get('id', '')}".split())
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return 1
    if a.get("role", "").lower() in ROLES:
        return 2
    for x in f"{a.get('class', '')} {a.get('id', '')}".split():
        if w := _name_is_noise(x, tag in BLOCKS):
            return 3 if w in READERS else 2 * (w != "header" or not within)
    return 0


def _step(tag: str, a: dict[str, str]) -> str:
    """A tag and its first class, digits generalised."""
    first = (a.get("class") or "").split()
    return tag + (f".{re.sub(r'[0-9]+', '#', first[0].lower())}" if first else "")


def path_of(up: str, step: str) -> str:
    """The path of an element by that of the nearest container above it: the step, and a digest of all steps. Its size is bounded."""
    return f"{step[:80]}#{hashlib.blake2b(f'{up}>{step}'.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def marks(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", tag name or "", attributes) of a page's markup, in time linear in its length.

    Quotes count behind an equals sign. Where a tag's quotes never let it end, the page's quotes are broken: from there on they
    are ignored. Text behind the last > is text.
    """
    at, n, quotes = 0, len(page), True
    while m := _STARTS.search(page, at):
        if m[1]:
            to = page.find("-->", m.end())
            at = n if to < 0 else to + 3
            yield m.start(), at, "", "", ""
            continue
        to, place = -1, m.end()
        while quotes and m[3]:
            q = _ENDS.search(page, place)
            if not q:
                quotes = False
            elif not q[1]:
                to = q.start()
                break
            else:
                close = page.find(q[1], q.end())
                place = q.end() if close < 0 else close + 1
        if to < 0:
            to = page.find(">", m.end())
            if to < 0:
                return
        at = to + 1
        yield m.start(), at, m[2] or "", (m[3] or "").lower(), page[m.end() : to]


def events(page: str) -> list[tuple[str, object, _Node | None, bool]]:
    """('text', piece, element, in a link), ('open' or 'close', element, -, -) and ('break', ...) of the kept part of a page, in order.

    One pass with one stack. End tags without a start are ignored, elements left open end with the page, and a paragraph ends
    where a block starts. Then what is not main text goes: elements by their tags; by their names, unless they hold an article,
    or nearly all of the page's text and no comments.
    """
    out: list[tuple[str, object, _Node | None, bool]] = []
    stack: list[_Node] = []
    solid: list[int] = []  # places in the stack of what is not inline
    opened: Counter = Counter()
    at = 0

    def pop() -> _Node:
        x = stack.pop()
        if solid and solid[-1] == len(stack):
            solid.pop()
        opened[x.tag] -= 1
        if x.up:
            x.up.chars += x.chars * (x.noise != 1)
            x.up.main |= x.main
        out.append(("close", x, None, False))
        return x

    def text(piece: str) -> None:
        up = stack[-1] if stack else None
        if up and not opened["a"]:
            up.chars += len(piece.strip())
        out.append(("text", piece, up, opened["a"] > 0))

    for start, end, closing, tag, rest in marks(page):
        if start < at:
            continue
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                while pop().tag != tag:
                    pass
            if tag not in INLINE:
                out.append(("break", None, None, False))
            continue
        if tag in CLOSES_P and solid and stack[solid[-1]].tag == "p":
            for _ in range(len(stack) - solid[-1]):
                pop()
        if tag not in INLINE:
            out.append(("break", None, None, False))
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        a = _attributes(rest)
        up = stack[-1] if stack else None
        path = up.path if up else ""
        if tag in CONTAINERS or tag == "html":
            path = path_of(path, _step(tag, a))
        x = _Node(tag, path, up, _noise(tag, a, opened["article"] > 0))
        x.main = tag in ("article", "main")
        if tag not in INLINE:
            solid.append(len(stack))
        stack.append(x)
        opened[tag] += 1
        out.append(("open", x, None, False))
    if at < len(page):
        text(page[at:])
    total = stack[0].chars if stack else 0
    while stack:
        total = max(total, pop().chars)
    total = max([total, *(x.chars for k, x, _, _ in out if k == "open" and x.up is None)])  # type: ignore[attr-defined]
    kept = []
    for e in out:
        kind, x, up, _ = e
        if kind == "open":
            spared = x.noise == 2 and x.chars >= (HALF if x.main else MASS) * max(1, total)  # type: ignore[attr-defined]
            x.dropped = bool(x.up and x.up.dropped) or x.noise > 0 and not spared  # type: ignore[attr-defined]
        if not (x.dropped if kind in ("open", "close") else kind == "text" and up is not None and up.dropped):  # type: ignore[attr-defined]
            kept.append(e)
    return kept


def container_scores(kept: list) -> dict[str, float]:
    """What each container path of a page's events holds: characters of text outside links, whole to the nearest container, half to the next."""
    out: dict[str, float] = {}
    stack: list[_Node] = []
    for kind, x, _, linked in kept:
        if kind == "open" and x.tag in CONTAINERS:
            stack.append(x)
        elif kind == "close" and stack and stack[-1] is x:
            stack.pop()
        elif kind == "text" and stack:
            got = len(x.strip()) * (-1.0 if linked else 1.0)
            if got:
                for k, share in ((-1, 1.0), (-2, 0.5)):
                    if len(stack) >= -k:
                        out[stack[k].path] = out.get(stack[k].path, 0.0) + share * got
    return {k: v for k, v in out.items() if v > 0}


def best_path(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda k: (scores[k], k), default=None)


def text_at(kept: list, path: str | None) -> str:
    """The text of a page's events under a path, in page order: references decoded, white space one space, blocks joined by one space.

    Without a path: all of it.
    """
    out: list[str] = []
    inside: list[object] = []
    for kind, x, _, _ in kept:
        if kind == "open" and path is not None and x.tag in CONTAINERS and x.path == path:
            inside.append(x)
        elif kind == "close" and inside and inside[-1] is x:
            inside.pop()
            out.append(" ")
        elif inside or path is None:
            out.append(_html.unescape(x) if kind == "text" else " " if kind == "break" else "")
    return " ".join("".join(out).split())


def main_text(page: str | None, path: str | None) -> str:
    """A page's text under its host's path; else under its own best container; else all kept text."""
    kept = events(page or "")
    return (text_at(kept, path) if path else "") or text_at(kept, best_path(container_scores(kept)))


def host(url: Column) -> Column:
    """The lower-cased host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): of each host, the container path of the largest summed share over its pages (of equals, the last by code point)."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in sliced(batches):
            total: Counter = Counter()
            for h, page in zip(rb.column(0), rb.column(1), strict=True):
                s = container_scores(events(page.as_py() or ""))
                for k, v in s.items():
                    total[h.as_py(), k] += round(1_000_000 * v / max(s.values()))
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in total], pa.string()), "path": pa.array([k for _, k in total], pa.string()), "votes": pa.array(list(total.values()), pa.int64())})

    cast = pages.select(host(column(url_col)).alias("host"), column(html_col).alias("html")).mapInArrow(votes, "host string, path string, votes long")
    total = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return total.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("w")).select("host", "w.path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and n_chars, the text under its host's winning path.

    A page without that path gives its own best container, or all its kept text where it has none. Null html is empty and gives
    empty text; a null or odd url belongs to the host ''. Whole pages are read; repeated rows give the same text each; an empty
    table gives an empty result; other columns, of any name, are not read. Votes are summed before they are shuffled, so a host
    with a third of all pages is a few rows; winners of measured size are broadcast, more are joined by a shuffle.
    """
    cut = Cuts(pages.select(column(id_col), column(url_col), column(html_col)))
    paths = cut(winning_paths(pages, url_col, html_col))
    rows = pages.select(column(id_col).alias("i"), column(url_col).alias("u"), column(html_col).alias("html"), host(column(url_col)).alias("host"))
    joined = rows.join(near(paths), "host", "left").select("i", "u", "html", "path")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in sliced(batches):
            out = [main_text(page.as_py(), path.as_py()) for page, path in zip(rb.column(2), rb.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["i", "u", "t", "n"])

    schema = T.StructType([joined.schema["i"], joined.schema["u"], T.StructField("t", T.StringType()), T.StructField("n", T.LongType())])
    out = joined.mapInArrow(texts, schema)
    return cut.done(out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("t").alias("text"), F.col("n").alias("n_chars")))
