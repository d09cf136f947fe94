"""Main text of web pages by tag-path ratios.

A page becomes text nodes with their root-to-leaf tag paths. Nodes inside
elements that never hold article text (scripts, menus, hidden elements, ...; by
tag or role) are set aside. For each remaining path the text length and the
punctuation of all its nodes are added up; the two ratios are smoothed over the
neighbouring nodes of the page, fused by a product, and paths over a threshold
are content. Words of class or id, forms and headers are evidence that an
element is no part of the article; how much of the page's content paths it
holds decides: a wrapper of the whole page is one of its article as well,
whatever its class tells of cookies. The ratios are then worked out again for
what is left. All nodes of content paths give text, with the short blocks beside
them: those in the same article or main element if such elements hold the
content, or else those in the elements that hold content blocks, and headings
before them.

Blocks are what block elements and line breaks delimit; inline elements don't
part words. White space in a block becomes one space; blocks are joined by one
space in page order. Time and memory are linear in a page, however deep it
nests. Edge cases: a null, empty or markup-free page gives an empty text or its
own text; unclosed or stray tags and quotes are mended as they come; a page
without any content path gives the text that remains; extra columns are
ignored; null ids, repeated rows and empty tables pass through.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav aside button select option fieldset head menu dialog input object applet canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class and id attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner promo promotion promoted sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar "
    "comment comments disqus reply replies respond discussion related recommended recommendations share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login toolbar pagination pager tags copyright legal disclaimer skip".split()
)
#: Those of them that also name layouts around an article ("with-sidebar"): an article inside is one all the same.
LAYOUT = frozenset("sidebar aside menu nav navbar navigation banner widget widgets topbar toolbar skip ads ad".split())
#: Those of them that mark what readers wrote: it is never the article beside other text.
READERS = frozenset("comment comments disqus reply replies respond discussion".split())
#: Those of them that also name chapters, which hold their paragraphs directly.
CHAPTERS = frozenset(("discussion",))
#: Words beside a mark that make it a state ("comments-open", "no-sidebar"), which says nothing of the element itself.
STATES = frozenset("with without no none has have is open closed enabled disabled on off allowed count".split())
ARTICLES = frozenset(("article", "main"))
#: Kinds of elements, by words of class or id, whose articles count no more than they do.
FIRM = frozenset(("mark", "reader", "chapter"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are blocks of a text rather than what holds its blocks.
TEXTUAL = INLINE | HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot table ul ol dl blockquote pre figure figcaption address caption center details summary header".split())
#: Elements between a paragraph's words and what holds the paragraph.
PROSE = INLINE | HEADINGS | frozenset("p blockquote pre figure figcaption".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A new block element ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# a quote counts only after an equals sign, and only if it ends before the next tag or where a value may end
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    r"((?:[^>=]|=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s>]*))*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_STRONG = ("table", "article", "main", "body")
_PUNCT = re.compile(r"[.,;:!?…、。，！？；：]")


@dataclass(frozen=True)
class HtmlParams:
    #: Paths at least so many standard deviations of the fused ratio over zero are content.
    threshold: float = 0.5
    #: Neighbours on each side over which ratios are smoothed.
    smooth: int = 2
    #: Articles, or elements that hold content blocks, give text if they hold this share of what the largest one holds.
    least: float = 0.1
    #: An element that looks like no part of the article is one if it holds so many times the content outside of such.
    most: float = 3.0
    #: A content node outside of those elements gives text from so many characters on, if it has punctuation.
    sentence: int = 40


class Page:
    """Elements as parallel lists, each after its parent, and text nodes (element, text, whether a block ends before it).

    Element 0 is the page itself. ``keep`` is False under what never holds
    article text. ``kind`` tells what an element looks like, if not like a part
    of the article: "side" of a layout, "header", or "mark", "reader" and
    "chapter" by words of its class or id. ``soft`` is the nearest such element
    around (or the element), or -1; ``firm`` that of the last three kinds.
    """

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.path, self.keep, self.kind, self.soft, self.firm = [""], [-1], [0], [True], [""], [-1], [-1]
        self.nodes: list[tuple[int, str, bool]] = []
        self._paths: dict[tuple[int, str], int] = {}
        #: For each tag, where its open elements are in the stack.
        self._open: dict[str, list[int]] = defaultdict(list)
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [0]
        at, brk, size = 0, True, len(page)
        while at < size:
            m = _TAG.search(page, at)
            text = page[at : m.start() if m else size]
            if text:
                self.nodes.append((stack[-1], text, brk))
                brk = False
            if not m:
                return
            at = m.end()
            if m[1]:
                self.nodes.append((stack[-1], m[1].replace("&", "&amp;"), brk))
                brk = False
            if not m[3]:
                continue
            tag = m[3].lower()
            brk = brk or tag not in INLINE
            if m[2]:
                # a stray end tag doesn't close what stands around it
                self._close(stack, {tag}, () if tag in _STRONG or tag == "html" else _STRONG)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag in _ENDS_P:
                self._close(stack, {"p"}, ("div", "article", "section", "td", "body", "li", "blockquote", "main"))
            if tag in _CLOSES:
                self._close(stack, _CLOSES[tag], ("ul", "ol", "dl", "table", "tbody", "thead", "select"))
            if tag not in VOID:
                self._add(stack, tag, m[4])

    def _close(self, stack: list[int], tags: set, until: tuple) -> None:
        """End the innermost element of these tags, and all inside it, unless one of ``until`` is further in."""
        at = max((self._open[t][-1] for t in tags if self._open[t]), default=0)
        if not at or any(self._open[t] and self._open[t][-1] > at for t in until):
            return
        for e in stack[at:]:
            self._open[self.tag[e]].pop()
        del stack[at:]

    def _add(self, stack: list[int], tag: str, attrs: str) -> None:
        up, e = stack[-1], len(self.tag)
        self._open[tag].append(len(stack))
        own = _kept(tag, attrs, bool(self._open["article"] or self._open["main"])) if self.keep[up] else None
        self.tag.append(tag)
        self.parent.append(up)
        # inline steps don't make a path of their own
        self.path.append(self.path[up] if tag in INLINE else self._paths.setdefault((self.path[up], tag), len(self._paths) + 1))
        self.keep.append(own is not None)
        self.kind.append(own or "")
        self.firm.append(e if own in FIRM else self.firm[up])
        # an article in a side of the layout is one all the same
        self.soft.append(e if own else self.firm[up] if tag in ARTICLES else self.soft[up])
        stack.append(e)

    def sums(self, weight: dict[int, int]) -> list[int]:
        """For each element the weight of itself and all inside it."""
        out = [weight.get(e, 0) for e in range(len(self.tag))]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def under(self, chosen: set[int]) -> list[bool]:
        """Whether each element is, or is inside, a chosen one."""
        out = []
        for e, up in enumerate(self.parent):
            out.append(e in chosen or up >= 0 and out[up])
        return out

    def holders(self, tags: frozenset) -> list[int]:
        """For each element the innermost one around it, or itself, that has none of these tags."""
        out = [0]
        for e in range(1, len(self.tag)):
            out.append(out[self.parent[e]] if self.tag[e] in tags else e)
        return out

    def admitted(self, content: set[int], params: HtmlParams) -> list[bool]:
        """Whether each element's text may be the article's, by the content that elements of a kind hold."""
        if not any(self.kind):
            return self.keep
        own: dict[int, int] = defaultdict(int)
        for k, (e, text, _) in enumerate(self.nodes):
            if self.keep[e] and (k in content or not content):
                own[e] += len(text.strip())
        held, inside = self.sums(own), self.under({e for e, t in enumerate(self.tag) if t in ARTICLES})
        by_firm: dict[int, int] = defaultdict(int)
        found: set[int] = set()
        for e, n in own.items():
            by_firm[self.firm[e]] += n
            if inside[e] and n:
                found.add(self.firm[e])
        passed = self._passed(own, held, inside, params)
        plain = sum(by_firm[e] for e in passed)
        articles = self.sums({e: 1 for e, t in enumerate(self.tag) if t in ARTICLES})
        firm = sorted((e for e, s in enumerate(self.firm) if s == e and self.kind[e] != "chapter" and e not in passed), key=lambda e: (self.kind[e] == "reader", -held[e], e))
        for e in firm:  # outer ones before those inside, which hold no more
            # beside an article, what holds others lists them
            other = bool(articles[e] and found & passed)
            if held[e] > plain * (1 if articles[e] else params.most) and not other and (self.kind[e] != "reader" or not plain):
                passed.add(e)
                plain += by_firm[e]
        marked = any(inside[e] and self.keep[e] and self.soft[e] in passed and not text.isspace() for e, text, _ in self.nodes)
        return self._open_to(passed, own, held, marked)

    def _passed(self, own: dict[int, int], held: list[int], inside: list[bool], params: HtmlParams) -> set[int]:
        """-1 and the chapters of articles: content paths lead from them to paragraphs, without an element for each comment."""
        out, direct, holder = {-1}, [0] * len(self.tag), self.holders(PROSE)
        for e, n in own.items():
            direct[holder[e]] += n
        for e, kind in enumerate(self.kind):
            if kind != "chapter":
                continue
            if inside[e] and direct[e] and direct[e] >= (1 - params.least) * held[e]:
                out.add(e)
            else:
                self.kind[e] = "reader"
        return out

    def _open_to(self, passed: set[int], own: dict[int, int], held: list[int], marked: bool) -> list[bool]:
        """``keep``, without what lies in an element of a kind that doesn't pass.

        Without an article or main element, sides of the layout that hold most of
        the content pass; headers do if they and the content have one parent.
        """
        direct, holder = [0] * len(self.tag), self.holders(TEXTUAL - {"header"})
        size: dict[int, int] = defaultdict(int)
        for e, n in own.items():
            direct[holder[e]] += n
            size[self.soft[e]] += n
        open_, plain = {-1}, sum(size[e] for e in passed)
        for e, kind in enumerate(self.kind):
            if not kind or self.soft[self.parent[e]] not in open_:
                continue
            up = self.parent[e]
            if kind == "side":
                ok = not marked and held[e] > plain
                plain += size[e] if ok else 0
            elif kind == "header":
                ok = self.tag[up] not in ("", "html", "body") and 2 * direct[up] > held[up] - held[e]
            else:
                ok = e in passed
            if ok:
                open_.add(e)
        return [k and s in open_ for k, s in zip(self.keep, self.soft)]


def _kept(tag: str, attrs: str, in_article: bool) -> str | None:
    """What an element looks like by its tag and attributes (as Page.kind); None if its text is never the article's."""
    if tag in NEVER or tag == "footer":
        return None
    kind = "header" if tag == "header" and not in_article else "side" if tag == "form" else ""
    if not attrs or tag in ("html", "body"):
        return kind
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return None
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return None
        if name in ("class", "id"):
            for token in value.split():
                words = {x.lower() for x in re.split(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])", token) if x}
                marks = words & MARKS
                # an article's own class names many things that it has; only "comment" and the like say what it is
                if not marks or words & STATES or tag in ARTICLES and words - MARKS:
                    continue
                if marks - LAYOUT:
                    found = "chapter" if tag == "section" and marks <= CHAPTERS else "reader" if marks & READERS else "mark"
                    kind = found if kind not in FIRM or found == "reader" else kind
                elif tag not in ARTICLES and kind not in FIRM:
                    kind = "side"
    return kind


def main_text(page: str | None, params: HtmlParams = HtmlParams()) -> str:
    if not page:
        return ""
    p = Page(page)
    kept = [k for k, (e, t, _) in enumerate(p.nodes) if p.keep[e] and not t.isspace()]
    content = _content(p, kept, params)
    may = p.admitted(content, params)
    if may is not p.keep:
        kept = [k for k in kept if may[p.nodes[k][0]]]
        content = _content(p, kept, params)
    wanted = _wanted(p, content, params) if content else [True] * len(p.tag)
    out: list[str] = []
    block: list[str] = []
    for k, (e, t, brk) in enumerate(p.nodes):
        if brk and block:
            out += block_text(block)
            block = []
        if may[e] and (wanted[e] or k in content):
            block.append(t)
    return " ".join(out + block_text(block))


def _content(p: Page, kept: list[int], params: HtmlParams) -> set[int]:
    """Those of the kept nodes whose tag path has a fused ratio over the threshold."""
    chars: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    paths = [p.path[p.nodes[k][0]] for k in kept]
    for k, path in zip(kept, paths):
        t = p.nodes[k][1]
        chars[path] += len(t)
        marks[path] += len(_PUNCT.findall(t))
        count[path] += 1
    length = _smoothed([chars[x] / count[x] for x in paths], params.smooth)
    punct = _smoothed([marks[x] / count[x] for x in paths], params.smooth)
    fused: dict[int, list] = defaultdict(list)
    for path, a, b in zip(paths, length, punct):
        fused[path].append(math.log1p(a) * math.log1p(b))
    score = {x: sum(y) / len(y) for x, y in fused.items()}
    if not score:
        return set()
    mean = sum(score.values()) / len(score)
    spread = math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score))
    return {k for k, path in zip(kept, paths) if score[path] > params.threshold * spread and score[path] > 0}


def _wanted(p: Page, content: set[int], params: HtmlParams) -> list[bool]:
    """The elements whose text goes with the content, short blocks included."""
    weight: dict[int, int] = defaultdict(int)
    for k in content:
        weight[p.nodes[k][0]] += len(p.nodes[k][1])
    held = p.sums(weight)
    inside = p.under({e for e, t in enumerate(p.tag) if t in ARTICLES})
    outer = [e for e, t in enumerate(p.tag) if t in ARTICLES and held[e] and not inside[p.parent[e]]]
    most = max((held[e] for e in outer), default=0)
    outer = [e for e in outer if held[e] >= params.least * most]
    if sum(held[e] for e in outer) * 2 >= held[0]:
        for k in [k for k in content if not inside[p.nodes[k][0]]]:
            content.discard(k)
        return p.under(set(outer))
    # the element around each content block
    direct: dict[int, int] = defaultdict(int)
    holder = p.holders(TEXTUAL)
    for e, n in weight.items():
        direct[holder[e]] += n
    most = max(direct.values())
    chosen = {e for e, n in direct.items() if n >= params.least * most}
    # smoothing lets scraps beside long texts pass; alone, only sentences count
    for k in list(content):
        e, t, _ = p.nodes[k]
        if len(t) < params.sentence or not _PUNCT.search(t):
            content.discard(k)
    # the page or its body holds all else too: there, just what isn't an element of another kind
    whole = {e for e in chosen if p.tag[e] in ("", "html", "body")}
    out = p.under(chosen - whole)
    around = p.sums({e: 1 for e in chosen})
    beside = [e in whole for e in range(len(p.tag))]
    heading = [False] * len(p.tag)
    for e in range(1, len(p.tag)):
        up = p.parent[e]
        beside[e] = beside[e] or beside[up] and p.tag[e] in TEXTUAL
        # headings of the elements around
        heading[e] = heading[up] or p.tag[e] in HEADINGS and around[up] > 0
        out[e] = out[e] or beside[e] or heading[e]
    out[0] = beside[0]
    return out


def block_text(block: list[str]) -> list[str]:
    return "".join(map(entities.unescape, block)).split()


def _smoothed(x: list[float], width: int) -> list[float]:
    if len(x) <= 2 * width or not width:
        return x
    total, out = [0.0], []
    for v in x:
        total.append(total[-1] + v)
    for k in range(len(x)):
        a, b = max(0, k - width), min(len(x), k + width + 1)
        out.append((total[b] - total[a]) / (b - a))
    return out


def extracted(pages: DataFrame, params: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages(page_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, params) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
