"""Main text of web pages by tag-path ratios.

A block is the text of one block-level element between two block-level tags; its
path is the chain of block-level elements from the root. Per path the blocks' text
outside links and their punctuation are totalled; each block takes its path's means;
both sequences are smoothed along the page, fused as a product, and lessened by
the share of the path's text that lies in links. Paths whose fused ratio reaches a
share of the page's spread are content: their blocks are the main text, with the
other blocks (headings, short paragraphs, lists, tables) that stand in the same
container, unless their path is mostly links. Where a page has an ``article`` or
``main`` element, that element settles what the ratios leave open: its blocks are
the main text but for paths of links.

Some elements hold no main text whatever their ratios. By tag: menus, the page's
footer, sidebars, scripts, styles. Headers and forms, and what a role, class or id
names (adverts, notices, comments, shares, …), are only suspected. A suspected
element stays out unless it holds the page's article, or most of the text of the
page or article it is in and no comments; where nothing else is left, those stay
whose mark is only part of a longer class name. An ``article`` or ``main`` element
is no comment unless a whole class name says so. Inside them a ``header`` is a
heading and stays.

Defined results: NULL, empty and text-free pages give the empty text; a page whose
text lies in links alone, outside menus, gives that text; unclosed, crossed and
stray tags are closed as browsers do for paragraphs, items, rows and cells; ties
between paths are both content; repeated rows get equal answers; other columns are
ignored; an empty table gives an empty table. Paths are numbered with a link to
their parent, so pages may be of any depth; work and memory are linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import whole_texts

#: A path is content if its fused ratio is at least this many standard deviations of the page's blocks.
SPREAD = 0.5
#: Weights of a block and its neighbours on either side.
KERNEL = (0.25, 0.5, 0.25)
#: Share of a path's text in links from which it is a list of links.
LINKS = 0.6
#: Share of the text from which a suspected element is the page's body after all.
MOST = 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these names, up to the nearest of the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_BOUND = frozenset("article aside blockquote body button div figure footer form header html li main nav section table td th".split())
_P_ENDS = _BLOCK - frozenset("br head html body caption tbody td tfoot th thead tr li dd dt option".split())
_SECTION = frozenset("article main section div body td html".split())

#: What stands in a container of text.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption address hr center details summary".split())
_NEVER = frozenset("nav aside footer button select menu audio video canvas applet head".split())
_DOUBTED = frozenset("form dialog label object header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist".split())
_MARKED = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bno)[_\-])(ads?|adverts?|advertisements?|adsense|adslot|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|side-?bar|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|gdpr|notices?|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|widget|toolbar|pagination|pager|search|"
    r"copyright|disclaimer|skip-?link|toc)(?=$|[\s_\-])",
    re.I,
)
#: Of these, the ones that name a heading inside an article.
_HEADINGS = frozenset(("header", "masthead", "banner", "search"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TAG = re.compile(
    r"<!--(?:>|->|[\s\S]*?(?:-->|\Z))|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))"
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")


#: Marks of what readers wrote.
_COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
_LIVE, _SUSPECT, _DEAD = 0, 1, 2


class _Element:
    __slots__ = ("name", "parent", "state", "weak", "comment", "path", "article", "main", "linked", "holder", "size", "free", "largest", "lenient")

    def __init__(self, name: str, parent: _Element | None):
        self.name, self.parent, self.state, self.weak, self.comment = name, parent, _LIVE, False, False
        self.article = name == "article" or bool(parent and parent.article)
        self.main = name == "main" or bool(parent and parent.main)
        self.linked = name == "a" or bool(parent and parent.linked)
        #: The container of the text: the nearest block that does not itself stand in one.
        self.holder = self if parent is None or name in _BLOCK and name not in _FLOW else parent.holder
        self.path, self.size, self.free, self.largest, self.lenient = 0, 0, 0, None, False


def _judge(element: _Element, rest: str) -> None:
    """Mark an element that holds no main text, or is suspected of it."""
    name, inside = element.name, element.parent.article or element.parent.main
    if name in _NEVER:
        element.state = _DEAD
    elif name in _DOUBTED and not (name == "header" and inside):
        element.state, element.weak = _SUSPECT, name == "form"
    if "=" not in rest or element.state == _DEAD:
        return
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    if values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
        element.state = _DEAD
        return
    if values.get("role", "").lower() in _ROLES:
        element.state = _SUSPECT
    names = f"{values.get('class', '')} {values.get('id', '')}".lower()
    if name in ("article", "main"):
        element.comment = name == "article" and not _COMMENT.isdisjoint(names.split())
        if element.comment:
            element.state = _SUSPECT
    elif element.state == _LIVE and name not in ("body", "html"):
        marks = {m.lower() for m in _MARKED.findall(names)}
        marks = marks - _HEADINGS if inside else marks
        if marks:
            element.state, element.weak = _SUSPECT, marks.isdisjoint(names.split())
            element.comment = not _COMMENT.isdisjoint(marks)


class _Page:
    """Elements of one page, each after its parent, and text nodes ``(element, block number, text)``."""

    def __init__(self, page: str):
        self.root = _Element("#root", None)
        self.elements, self.nodes, self.block = [self.root], [], 0
        #: Open elements, and where the open ones of each name stand.
        self.stack, self.open = [self.root], {}
        self.paths: dict[tuple[int, str], int] = {}
        at = 0
        while at < len(page):
            found = _TAG.search(page, at)
            if found is None:
                self._text(page[at:])
                break
            if found.start() > at:
                self._text(page[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                if found[0].startswith("<![CDATA["):
                    self._text(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
                continue
            name = name.lower()
            if name in _BLOCK:
                self.block += 1
            if found["end"]:
                self._close(name)
                continue
            if name in _RAW:
                if not found["rest"].endswith("/>") or name != "svg":
                    end = _raw_end(name).search(page, at)
                    at = end.end() if end else len(page)
                continue
            self._imply(name)
            if name in _VOID:
                continue
            self._push(name, found["rest"])

    def _push(self, name: str, rest: str) -> None:
        above = self.stack[-1]
        element = _Element(name, above)
        _judge(element, rest)
        element.path = self.paths.setdefault((above.path, name), len(self.paths) + 1) if name in _BLOCK else above.path
        self.elements.append(element)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(element)

    def _cut(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        while len(self.stack) > place:
            self.open[self.stack.pop().name].pop()

    def _last(self, names) -> int:
        """Where the innermost open element of these names stands; 0 if there is none."""
        return max((places[-1] for n in names if (places := self.open.get(n))), default=0)

    def _text(self, text: str) -> None:
        if text:
            self.nodes.append((self.stack[-1], self.block, html.unescape(text)))

    def _close(self, name: str) -> None:
        place = self._last((name,))
        if place and (name in _SECTION or name in ("table", "tr", "tbody") or place >= self._last(_WALLS)):
            self._cut(place)

    def _imply(self, name: str) -> None:
        """Close what ``name`` cannot stand in."""
        if name in _P_ENDS and (place := self._last(("p",))) > self._last(_P_BOUND):
            self._cut(place)
        names, bounds = _CLOSES.get(name, ((), ()))
        if names and (place := self._last(names)) > self._last(bounds):
            self._cut(place)


_WALLS = ("td", "th", "table", "article", "main", "body")


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def _settle(page: _Page) -> None:
    """Decide about the suspected elements; what lies below a dead one is dead."""
    elements = page.elements
    for element, _, text in page.nodes:
        element.size += len(text) - text.count(" ")
    clear = {page.root}
    for e in elements[1:]:
        if e.parent.state == _DEAD:
            e.state = _DEAD
        if e.state == _LIVE and e.parent in clear:
            clear.add(e)
    for e in reversed(elements):
        if e.state == _DEAD:
            e.size = e.free = 0
            continue
        e.free += e.size if e.largest is None else 0
        own = e.parent
        if own is not None and own.state != _DEAD:
            if own.largest is None:
                own.free += own.size
                own.largest = e
            elif e.size > own.largest.size:
                own.largest = e
            own.size += e.size
            own.free += e.free if e.state == _LIVE else 0
    homes = [e for e in elements if e.name in ("article", "main") and e.state != _DEAD and e.size and not e.comment]
    scopes = [e for e in homes if e in clear]
    if homes and not scopes:
        # all stand in suspected elements: those around the one with most text are none
        scopes = [max(homes, key=lambda e: e.size)]
        around = scopes[0]
        while around is not None:
            around.state, around = _LIVE, around.parent
    for scope in scopes or [page.root]:
        if scope.free < (1 - MOST) * scope.size:
            inner, rescued = scope.largest, False
            while inner is not None and inner.size >= MOST * scope.size and not inner.comment:
                rescued = rescued or inner.state == _SUSPECT
                inner.state, inner = _LIVE, inner.largest
            scope.lenient = scope.free == 0 and not rescued
    for e in elements[1:]:
        e.lenient = e.lenient or e.parent.lenient
        if e.state == _SUSPECT:
            e.state = _LIVE if e.lenient and e.weak and not e.comment else _DEAD
        if e.parent.state == _DEAD:
            e.state = _DEAD


def _content_paths(paths: list[int], lengths: list[int], marks: list[int], links: list[int]) -> tuple[set[int], set[int]]:
    """The paths whose smoothed, fused ratios reach the threshold, and those that are mostly links."""
    total: dict[int, list[int]] = {}
    for path, *counts in zip(paths, lengths, marks, links):
        t = total.setdefault(path, [0, 0, 0, 0])
        for i, c in enumerate((*counts, 1)):
            t[i] += c
    share = {p: link / max(n, 1) for p, (n, _, link, _) in total.items()}
    ratio = np.array([[(total[p][0] - total[p][2]) / total[p][3], 1 + total[p][1] / total[p][3]] for p in paths], dtype=float)
    padded = np.pad(ratio, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[i : i + len(paths)] for i, w in enumerate(KERNEL))
    fused = smooth[:, 0] * smooth[:, 1] * np.array([1 - share[p] for p in paths])
    mean: dict[int, list[float]] = {}
    for path, f in zip(paths, fused.tolist()):
        s = mean.setdefault(path, [0.0, 0])
        s[0] += f
        s[1] += 1
    score = {p: s[0] / s[1] for p, s in mean.items()}
    bound = min(SPREAD * float(fused.std()), max(score.values()))
    return {p for p, s in score.items() if s >= bound}, {p for p, s in share.items() if s >= LINKS}


def main_text(page: str | None) -> str:
    """The article of one page as plain text."""
    if not page:
        return ""
    parsed = _Page(page)
    _settle(parsed)
    nodes = [n for n in parsed.nodes if n[0].state == _LIVE]
    solid = [n for n in nodes if n[2].strip()]
    for kind in ("article", "main"):
        if any(getattr(e, kind) for e, _, _ in solid):
            nodes = [n for n in nodes if getattr(n[0], kind)]
            break
    else:
        kind = None
    blocks: dict[int, list] = {}
    for e, b, t in nodes:
        block = blocks.setdefault(b, [None, [], 0])
        if t.strip():
            block[0] = block[0] or e
            block[2] += len(" ".join(t.split())) if e.linked else 0
        block[1].append(t)
    found = [(e, " ".join("".join(parts).split()), link) for e, parts, link in blocks.values() if e is not None]
    if not found:
        return ""
    paths, texts = [e.path for e, _, _ in found], [t for _, t, _ in found]
    content, listed = _content_paths(paths, [len(t) for t in texts], [len(_PUNCTUATION.findall(t)) for t in texts], [link for _, _, link in found])
    headings = {p for (_, name), p in parsed.paths.items() if name in ("h1", "h2", "h3", "h4", "h5", "h6")}
    holders = {e.holder for e, _, _ in found if e.path in content and e.path not in headings} or {e.holder for e, _, _ in found if e.path in content}
    near = [kind is not None or e.holder in holders for e, _, _ in found]
    kept = [n and (p in content or p not in listed) for n, p in zip(near, paths)]
    if any(k and p not in headings for k, p in zip(kept, paths)):
        # a linked heading is a heading
        kept = [k or n and p in headings for k, n, p in zip(kept, near, paths)]
    else:
        kept = near
    return " ".join(t for k, t in zip(kept, texts) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return whole_texts(rows).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
