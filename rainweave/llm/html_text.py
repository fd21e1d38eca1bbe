"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each under its root-to-leaf tag path. Per path the text length, the punctuation and
the number of blocks are summed; the ratios of both to the blocks are fused, smoothed along the page, and
compared with a threshold from their spread. Blocks above it show which element holds the article. What that
element holds is kept whole, short paragraphs and headings too, apart from parts that the markup itself
calls something else (menus, notices, adverts, forms, comments) and lists of nothing but links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

SPREAD = 0.8  # of the standard deviation: the threshold of the fused ratios
MASS = 0.8  # of the text above the threshold: an element with this share holds the article
YIELD_CHARS = 4 << 20

# fixed values: names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes noscript textarea title xmp".split())
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li listing main menu nav noscript ol optgroup option p pre script search section select
style summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg math datalist output""".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = BLOCK - {"body", "html", "head", "button", "caption", "iframe", "legend", "noscript", "script", "style", "template", "textarea", "title", "select", "option",
                  "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "video", "audio", "canvas", "object", "svg", "math", "datalist", "output"}
ENDED_BY = {  # an open element of the key ends at these start tags, up to the barrier
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}), "option": ({"option", "optgroup"}, {"select"}),
}
SCOPE = {"html", "table", "td", "th", "caption", "object", "template"}

NEVER = set("""head nav aside footer menu form label legend button select option optgroup datalist output textarea script style
noscript template iframe object video audio canvas svg math dialog search title""".split())
CALLED = set("""ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar aside widget widgets
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer cookie cookies consent gdpr notice notices alert popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended recommendations form search toolbar masthead
contentinfo complementary dialog disclaimer copyright toc""".split())
SAID = set("comment comments disqus reply replies respond responses".split())
HEAD = {"header", "banner", "masthead"}

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/=>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。！，：；？]")


@dataclass
class Element:
    name: str
    parent: int
    path: str
    hard: bool = False  # dropped by its name, or as a comment
    soft: bool = False  # dropped by what its class, id or role says, unless it holds the article
    head: bool = False
    region: bool = False
    holder: int = 0  # the nearest block element, itself included
    link: bool = False


@dataclass
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _called(attributes: str) -> tuple[set[str], bool, dict[str, str]]:
    """Words of class, id and role, whether the element is hidden, and the attributes."""
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    said = " ".join(html.unescape(found.get(k, "")) for k in ("class", "id", "role"))
    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", said)} | {w.lower() for w in re.findall(r"[A-Za-z]+", said)}
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    return words, hidden, found


class _Page:
    """Elements and blocks of one page, in page order."""

    def __init__(self, source: str):
        self.elements = [Element("", -1, "")]
        self.stack = [0]
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self._read(source)

    def _text(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        if self.current is None:
            if not text.strip():
                return
            self.current = Block(self.elements[self.stack[-1]].holder)
            self.blocks.append(self.current)
        self.current.parts.append(text)
        if self.elements[self.stack[-1]].link:
            self.current.linked += len(text.strip())

    def _pop_to(self, place: int) -> None:
        if any(self.elements[i].name in BLOCK for i in self.stack[place:]):
            self.current = None
        del self.stack[place:]

    def _find(self, names: set[str], barrier: set[str]) -> int | None:
        for place in range(len(self.stack) - 1, 0, -1):
            name = self.elements[self.stack[place]].name
            if name in names:
                return place
            if name in barrier:
                return None
        return None

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.current is not None:
                self.current.parts.append(" ")
            return
        if name in ENDS_P:
            place = self._find({"p"}, SCOPE | {"button"})
            if place is not None:
                self._pop_to(place)
        for ended, (by, barrier) in ENDED_BY.items():
            if name in by:
                place = self._find({ended}, barrier)
                if place is not None:
                    self._pop_to(place)
        if name in BLOCK:
            self.current = None
        if name in VOID or (attributes.endswith("/") and self._find({"svg", "math"}, set()) is not None):
            return
        words, hidden, found = _called(attributes) if attributes.strip() else (set(), False, {})
        above = self.elements[self.stack[-1]]
        own = len(self.elements)
        element = Element(name, self.stack[-1], f"{above.path}/{name}" if name in BLOCK else above.path)
        element.holder, element.link = own if name in BLOCK else above.holder, name == "a" or above.link
        wraps = name in ("html", "body")
        article = name in ("article", "main") or "articlebody" in found.get("itemprop", "").lower() or (words & {"main"} and found.get("role") == "main")
        if article and any(self.elements[i].name == "article" for i in self.stack) and name == "article":
            element.hard = True  # an article within an article is a comment on it
        element.hard |= name in NEVER or hidden or (not wraps and bool(words & SAID))
        element.head = name == "header" or (not wraps and not article and bool(words & HEAD))
        element.soft = not wraps and not article and not element.head and bool(words & CALLED)
        if name in BLOCK and (element.soft or words & {"content", "article", "post", "entry", "story", "main"}):
            element.path += "." + "-".join(sorted(words))  # what the class says tells paths of one tag apart
        if article and not element.hard:
            element.region = True
            for i in self.stack:  # a wrapper of the article is none of the things that its class may name
                self.elements[i].soft = self.elements[i].head = False
                if self.elements[i].name == "form":
                    self.elements[i].hard = False
        self.elements.append(element)
        self.stack.append(own)

    def _end(self, name: str) -> None:
        if name == "br":
            self._start("br", "")
            return
        barrier = SCOPE - {name} if name in BLOCK else BLOCK
        place = self._find({name} if name not in HEADINGS else HEADINGS, barrier)
        if place is not None and name not in ("body", "html"):
            self._pop_to(place)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            token = TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                return
            self._text(source[at:token.start()])
            at = token.end()
            if not token[2]:
                continue
            name = token[2].lower()
            if token[1]:
                self._end(name)
                continue
            self._start(name, token[3])
            if name in RAW and not (name == "title" and self._find({"svg"}, set()) is not None):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._end(name)


def path_scores(paths: Sequence[str], lengths: Sequence[int], marks: Sequence[int]) -> np.ndarray:
    """Fused and smoothed ratio of each block: text and punctuation of its tag path to the blocks of that path."""
    if not len(paths):
        return np.zeros(0)
    _, group = np.unique(np.array(paths, dtype=object).astype(str), return_inverse=True)
    blocks = np.bincount(group)
    text = np.bincount(group, weights=lengths) / blocks
    punctuation = np.bincount(group, weights=marks) / blocks
    fused = (text * (1 + punctuation))[group]
    padded = np.pad(fused, 1, mode="edge")
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def main_blocks(source: str | None) -> list[str]:
    """The blocks of the article, in page order."""
    page = _Page(source or "")
    size = len(page.elements)
    gone, headed, titled, depth = [False] * size, [False] * size, [False] * size, [0] * size
    region, article, listed = [-1] * size, [-1] * size, [-1] * size  # the outermost of each kind around an element
    for i, e in enumerate(page.elements):
        up = e.parent
        depth[i] = depth[up] + 1 if i else 0
        gone[i] = e.hard or e.soft or (i > 0 and gone[up])
        headed[i] = e.head or (i > 0 and headed[up])
        titled[i] = e.name in HEADINGS or (i > 0 and titled[up])
        region[i] = region[up] if i and region[up] >= 0 else (i if e.region else -1)
        article[i] = article[up] if i and article[up] >= 0 else (i if e.region and e.name == "article" else -1)
        listed[i] = i if e.name in ("ul", "ol", "dl") else (listed[up] if i else -1)

    # what the markup drops; of a header only the headings of an article stay
    blocks = [(b.element, b.text(), b.linked) for b in page.blocks if not gone[b.element] and (not headed[b.element] or (region[b.element] >= 0 and titled[b.element]))]
    links: dict[int, list[bool]] = {}
    for e, text, linked in blocks:
        links.setdefault(listed[e], []).append(0 < 0.9 * len(text.replace(" ", "")) <= linked)
    menus = {owner for owner, all_links in links.items() if owner >= 0 and len(all_links) > 1 and all(all_links)}
    blocks = [block for block in blocks if listed[block[0]] not in menus]
    if not blocks:
        return []

    own = [max(0, len(text) - linked) for _, text, linked in blocks]
    score = path_scores([page.elements[e].path for e, _, _ in blocks], own, [len(PUNCTUATION.findall(text)) for _, text, _ in blocks])
    above = score >= SPREAD * score.std()
    for holders in (article, region):
        found = {holders[e] for (e, _, _), high in zip(blocks, above) if high} - {-1}
        if found:
            return [text for e, text, _ in blocks if holders[e] in found]

    # no article element: down to the last element that still has most of the text above the threshold
    mass = [0] * size
    for (e, _, _), high, chars in zip(blocks, above, own):
        mass[e] += chars if high else 0
    for i in range(size - 1, 0, -1):
        mass[page.elements[i].parent] += mass[i]
    holder = max((i for i in range(size) if mass[i] >= MASS * mass[0]), key=lambda i: depth[i])
    while page.elements[holder].name == "p" or page.elements[holder].name in HEADINGS:
        holder = page.elements[holder].parent
    inside = [False] * size
    for i in range(holder, size):
        inside[i] = i == holder or (i > 0 and inside[page.elements[i].parent])
    held = [k for k, (e, _, _) in enumerate(blocks) if inside[e]]
    if page.elements[holder].name in ("", "html", "body"):  # no element of its own: from the first to the last block above the threshold
        strong = [k for k in held if above[k]]
        first = strong[0]
        while first > 0 and page.elements[blocks[first - 1][0]].name in HEADINGS:
            first -= 1
        held = [k for k in held if first <= k <= strong[-1]]
    return [blocks[k][1] for k in held]


def extract_text(pages: DataFrame, html_column: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` (main text, blocks joined by a space) and ``n_chars`` (code points), per row.

    Character references are decoded, white space inside a block is one space, nothing is cut. A NULL, empty or
    text-less page gives an empty text. Repeated rows are repeated; unclosed tags end as HTML lets them, an unclosed comment, script or
    tag goes to the end of the page. Other columns are ignored.
    """
    picked = pages.select(*keep, pages[html_column].cast("string").alias("_html"))
    schema = StructType([*picked.schema.fields[:-1]]).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, size = 0, [], 0
            for k, source in enumerate(batch.column(len(keep))):
                texts.append(" ".join(main_blocks(source.as_py())))
                size += len(texts[-1])
                if size >= YIELD_CHARS or k + 1 == len(batch):
                    columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)
                    at, texts, size = k + 1, [], 0

    return picked.mapInArrow(run, schema)
