"""Main text of web pages by tag-path ratios.

A block's tag path is the list of open elements from the root down to it. Over a page, the paths of the article hold
most of the text and most of the punctuation; those of menus, notices and lists of links hold little, however a single
one of them may look. Per path, text and punctuation are summed. Both sums are smoothed along the page and fused by
their product into one score, linked text lowers it, and the paths that score above a threshold are content. A telling
class halves a score and a marked article doubles it, so names decide where sums are close and nowhere else.

Elements that HTML itself sets apart (navigation, asides, footers, scripts, what is hidden) are not read. Readers'
comments are prose like the article, so no sum tells them; what names itself so, and forms, is left out beside other
text."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barloom.deploy import ship
from barloom.llm.common import reject_clash, text_batches

#: HTML's elements without content, of raw text, and those that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are not the article's text.
APART = frozenset("nav aside footer script style noscript template svg button select option textarea iframe object canvas dialog menu head title input audio video map search".split())
#: Which open elements a start tag closes, up to the nearest of the second list.
CLOSES = {
    "p": (("p",), ()),
    "li": (("li", "p"), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words of a class or role, or of the id of a DIVISION, that tell what an element is. A heuristic list.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertisements adslot adsense banner breadcrumb breadcrumbs cookie cookies consent copyright gdpr dialog footer foot header legal masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices alert pager pagination popup promo promotion related recommended share sharing sidebar skip social sponsor sponsored subscribe tags "
    "toolbar topbar widget complementary contentinfo search".split()
)
#: Words of which alone the name of readers' comments is made, one of the first at least. A heuristic list.
COMMENTS = frozenset("comment comments commentlist commentary reply replies respond responses discussion disqus".split())
OF_COMMENTS = COMMENTS | frozenset("area block body box container content form item list section thread text wrap wrapper reader readers user".split())
#: Elements whose id names a part of the page. Other ids are mostly made from headings.
DIVISION = frozenset("div ul ol table form span td".split())
#: Elements that belong to the text of what holds them. A heuristic list.
STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption section header hgroup".split())
#: These are the article, whatever their class.
NEVER = frozenset("html body article main".split())

#: What a score is multiplied with below an element with a telling word, and in a marked article.
TOLD, PRIOR = 0.5, 2.0
#: Share of the page's largest score above which a path is content.
SHARE = 0.15
HEADINGS = ("h1", "h2")
#: What the sums of a container count by if another's heading is the page's title.
ELSEWHERE = 0.02
#: Share of the page's text that what lies outside of comments and forms must have for these to be left out.
BESIDE = 0.01

_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
#: What follows a tag's name up to its `>`, where every quote opens after a `=` and closes before a space or the end.
_TAG_END = re.compile(r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|=\s*+(?![\"'\s]))*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…·。，、；：！？¿¡]")
_TITLE = re.compile(r"<title(?:\s[^>]*)?>([^<]*)", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    """An open or closed element. path numbers its tag path, one number for all elements of that path with the
    same weight; block is its nearest element, itself included, that makes a block."""

    tag: str
    parent: Element | None
    path: int
    weight: float = 1.0
    #: How many forms and lists of comments it lies in.
    level: int = 0
    apart: bool = False
    link: bool = False
    article: bool = False
    block: Element | None = None
    #: First and last of the content blocks that it holds as their own element or the one above.
    first: int = -1
    last: int = -1
    #: Whether it, or an element that it is structured text of, holds content so.
    near: bool = False


@dataclass(slots=True)
class Block:
    """One block's text: its element, own length, marks, linked length."""

    element: Element
    parts: list[str] = field(default_factory=list)
    own: int = 0
    marks: int = 0
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def _names(tag: str, attributes: list[tuple[str, str]]) -> list[list[str]]:
    """The words of each name that tells what an element is."""
    own = [v for n, v in attributes if n in ("class", "role") or (n == "id" and tag in DIVISION)]
    return [[p.lower() for p in _PARTS.findall(token)] for value in own for token in value.split()]


def told(names: list[list[str]]) -> float:
    """The weight of an element's own names: of some, telling words are half or more."""
    return TOLD if any((n := sum(p in TELLING for p in parts)) and 2 * n >= len(parts) for parts in names) else 1.0


def _of_readers(names: list[list[str]]) -> bool:
    """Whether a name says that an element holds readers' comments."""
    return any(COMMENTS.intersection(parts) and OF_COMMENTS.issuperset(parts) for parts in names)


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(n == "hidden" or (n == "aria-hidden" and v.lower() == "true") or (n == "style" and re.search(r"display\s*:\s*none", v, re.I)) for n, v in attributes)


class _Tags:
    """Reads a page's tags in one pass: what is looked for and isn't there is not looked for again."""

    def __init__(self, page: str):
        self.page, self._none_after = page, {}

    def find(self, what: str, at: int) -> int:
        if at >= self._none_after.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self._none_after[what] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """Where the tag's `>` is, -1 if there is none. Quoted values may hold it; a quote that isn't closed, or
        is by the quote of a later tag, opens nothing."""
        plain = _TAG_END.match(self.page, at)
        if plain:
            return plain.end() - 1
        close = first = self.find(">", at)
        while close >= 0:
            quotes = [(q, c) for c in "\"'" if 0 <= (q := self.find(c, at)) < close]
            if not quotes:
                return close
            opened, mark = min(quotes)
            at = opened + 1
            if self.page[max(0, opened - 50) : opened].rstrip().endswith("="):
                end = self.find(mark, at)
                if end < 0 or (end > close and not re.match(r"[\s/>]", self.page[end + 1 : end + 2])):
                    return first
                at = end + 1
                if end > close:
                    close = self.find(">", at)
        return first


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order, outside of elements set apart. Missing and stray end tags are made up
    for as browsers do in common cases: a paragraph ends at the next block, an item at the next item."""
    tags, size, at = _Tags(page), len(page), 0
    paths: dict[tuple, int] = {}
    root = Element("", None, 0)
    root.block = root
    stack, places = [root], defaultdict(list)
    block_places = [0]
    out: list[Block] = []
    current: Block | None = None

    def text(piece: str, decode: bool = True) -> None:
        nonlocal current
        top = stack[-1]
        if not piece or top.apart:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(top.block)
            out.append(current)
        piece = html.unescape(piece) if decode else piece
        current.parts.append(piece)
        n = len(piece.strip())
        if top.link:
            current.linked += n
        else:
            current.own += n
            current.marks += len(_PUNCTUATION.findall(piece))

    def push(element: Element) -> None:
        places[element.tag].append(len(stack))
        if element.tag in BLOCK:
            block_places.append(len(stack))
        stack.append(element)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    def close(own: tuple[str, ...], until: tuple[str, ...]) -> None:
        """The outermost of the open elements to close that no other block but them and no boundary lies above."""
        bound = max([0, *(places[t][-1] for t in until if places[t])])
        if own == ("p",):  # a paragraph ends only if it is the innermost block
            bound = max(bound, block_places[-1] - 1)
        found = [p for t in own for p in places[t][-1:] if p > bound]
        while found:
            cut(min(found))
            found = [p for t in own for p in places[t][-1:] if p > bound]

    while at < size:
        start = tags.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        follows = page[start + 1 : start + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", start):
                end = tags.find("-->", start + 2)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", start):
                end = tags.find("]]>", start)
                at = end + 3 if end >= 0 else size
            else:
                end = tags.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        closing = follows == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if closing:  # no element's end: as a comment
                end = tags.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                text("<")
                at = start + 1
            continue
        end = tags.end_of_tag(name.end())
        if end < 0:  # the page ends within a tag
            break
        at = end + 1
        tag = name[0].lower()
        if tag in BLOCK:
            current = None
        if closing:
            if places[tag] and (tag in BLOCK or places[tag][-1] > block_places[-1]):
                cut(places[tag][-1])
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag in BLOCK:  # an inline element left open does not reach into the next block
            cut(block_places[-1] + 1)
            close(*CLOSES.get(tag, CLOSES["p"]))
            cut(block_places[-1] + 1)
        top, inside = stack[-1], page[name.end() : end]
        attributes = [(n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(inside)] if "=" in inside or "hidden" in inside.lower() else []
        names = [] if tag in NEVER else _names(tag, attributes)
        weight, deeper = told(names), int(tag == "form" or _of_readers(names))
        path = paths.setdefault((top.path, tag, weight, deeper), len(paths) + 1)
        element = Element(tag, top, path, top.weight * weight, top.level + deeper, top.apart or tag in APART or (tag == "header" and not top.article) or (tag not in NEVER and _hidden(attributes)), top.link or tag == "a", top.article or tag in ("article", "main"))
        element.block = element if tag in BLOCK else top.block
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            push(element)
            text(page[at : stop.start() if stop else size], tag in ("textarea", "title"))
            cut(len(stack) - 1)
            if not stop:
                break
            shut = tags.find(">", stop.end())
            at = shut + 1 if shut >= 0 else size
            continue
        push(element)
    return [b for b in out if b.own or b.linked]


_KERNEL = np.exp(-2.0 * np.arange(-2, 3) ** 2)
_KERNEL /= _KERNEL.sum()


def _smooth(values: list[float]) -> np.ndarray:
    return np.convolve(np.pad(np.array(values, float), 2, mode="edge"), _KERNEL, mode="valid")


def _says(block: Block, title: str) -> bool:
    """Whether a block's text and the title are one, or one begins or ends with the other."""
    own = block.text().lower()
    a, b = sorted((own, title), key=len)
    return bool(a) and len(block.parts) <= 20 and (b.startswith(a) or b.endswith(a))


def scores(found: list[Block], title: str = "") -> np.ndarray:
    """Each block's score. Text outside of links and punctuation are summed per tag path, and per path of the container
    that holds a block; the sums are smoothed along the page's blocks by a Gaussian and fused by their product. A path's
    score is the mean over its blocks, less what links hold of its text, or nothing if that is more than half. If a
    heading says what the page's title says, the sums of containers other than its own count by ELSEWHERE."""
    text, marks, linked, count, total = (defaultdict(float) for _ in range(5))
    places = [(b.element.path, ("in", b.element.parent.block.path) if b.element.parent else ("in", -1)) for b in found]
    titled = {place[1] for b, place in zip(found, places, strict=True) if b.element.tag in HEADINGS and _says(b, title)}
    for b, place in zip(found, places, strict=True):
        for path, share in zip(place, (1.0, ELSEWHERE if titled and place[1] not in titled else 1.0), strict=True):
            text[path] += b.own * share
            marks[path] += b.marks * share
        linked[place[0]] += b.linked
        count[place[0]] += 1
    fused = np.ones(len(found))
    for paths in zip(*places, strict=True):
        fused *= _smooth([text[p] for p in paths]) * _smooth([1 + marks[p] for p in paths])
    for (path, _), v in zip(places, fused, strict=True):
        total[path] += float(v)
    share = {p: linked[p] / (text[p] + linked[p]) for p in count}
    return np.array([total[p] / count[p] * (1 - share[p] if share[p] <= 0.5 else 0.0) for p, _ in places])


def _belongs(found: list[Block], chosen: list[bool]) -> list[bool]:
    """Whether each block stands between chosen ones of one container, or in structured text (lists, tables,
    headings, code) of a container that holds chosen blocks itself."""
    depth = [0] * (len(found) + 1)
    held = []
    for i, b in enumerate(found):
        if chosen[i]:
            for e in (b.element, b.element.parent.block if b.element.parent else None):
                if e is not None:
                    if e.first < 0:
                        e.first = i
                        held.append(e)
                    e.last = i
    for e in held:
        e.near = True
        if e.first + 1 < e.last:
            depth[e.first + 1] += 1
            depth[e.last] -= 1
    between, open_ = [], 0
    for d in depth[:-1]:
        open_ += d
        between.append(open_ > 0)
    known: dict[int, bool] = {}
    out = []
    for i, b in enumerate(found):
        e, chain = b.element, []
        while id(e) not in known and not e.near and e.tag in STRUCTURE and e.parent is not None:
            chain.append(e)
            e = e.parent.block
        answer = known.get(id(e), e.near)
        known.update((id(x), answer) for x in chain)
        out.append(between[i] or answer)
    return out


def title_of(page: str) -> str:
    """The text of the page's title, its words in lower case."""
    found = _TITLE.search(page)
    return " ".join(html.unescape(found[1]).lower().split()) if found else ""


def _beside(found: list[Block]) -> list[Block]:
    """The blocks in as few forms and lists of comments as the page's own text lies in."""
    text = defaultdict(int)
    for b in found:
        text[b.element.level] += b.own
    least = BESIDE * sum(text.values())
    level = min((k for k, n in text.items() if n >= least and n), default=0)
    return [b for b in found if b.element.level <= level]


def main_text(page: str | None, share: float = SHARE, prior: float | None = None) -> str:
    """The content blocks' text, one line each, in page order. A path is content if its score is above `share` of the
    page's largest score. So are lists, tables, headings, sections and the like beside content, and whatever
    stands between content of one container; but for what a telling name is on, and lists of links outside of a
    marked article. The first heading that says what the page's title says stays, or
    else the page's only h1. A page without text, or of links alone, or null, gives an empty text."""
    found = _beside(blocks(page or ""))
    if not found:
        return ""
    title = title_of(page)
    weight = np.array([b.element.weight for b in found])
    value = scores(found, title) * weight * np.where([b.element.article for b in found], PRIOR if prior is None else prior, 1.0)
    of_path = defaultdict(list)
    for b, v in zip(found, value.tolist(), strict=True):
        of_path[b.element.path].append(v)
    mean = {path: sum(of) / len(of) for path, of in of_path.items()}
    threshold = share * max(mean.values())
    chosen = [mean[b.element.path] > threshold for b in found]
    top = weight.max()
    heads = [b for b in found if b.element.tag in HEADINGS and not b.linked]
    first = [b for b in heads if b.element.tag == "h1"]
    kept, heading = [], next((b for b in heads if _says(b, title)), first[0] if len(first) == 1 else None)
    for b, c, belongs in zip(found, chosen, _belongs(found, chosen), strict=True):
        if c or b is heading or (belongs and b.element.weight == top and (b.element.article or b.linked <= b.own)):
            kept.append(b.text())
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: key, the columns in keep, text, n_chars. Pages are read whole, a batch's at a
    time. A null page has an empty text; a null key or repeated row stays as it is; an empty table gives an
    empty one; other columns of pages are not read."""
    ship(pages.sparkSession)
    text_batches(pages.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p if isinstance(p, str) else None) for p in batch[page]]
            yield batch.drop(columns=[page]).assign(text=texts, n_chars=[len(t) for t in texts]).convert_dtypes()

    chosen = reject_clash(pages, key, *keep, page)
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != page)
    return chosen.mapInPandas(rows, f"{schema}, text string, n_chars long")


def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
