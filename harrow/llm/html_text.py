"""Main text of web pages by line-block distribution.

Markup is stripped in one pass over the page; what stands between block elements is a line, with its characters outside of
links as its weight. Lines in menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments (by
element, role, or a word of class or id) weigh nothing. Weights are summed over windows of three lines: a sum that rises
over the threshold is a surge, the first empty window after it a dive, and the text between belongs together. Where the page
marks its article, only lines in it have weight and any text is a surge; lines that are barred inside it don't make it dive.
Elsewhere the threshold is 86 characters, or half of the page's largest sum if that is less, and what is barred between two
containers is a gap; the heaviest stretch is the article, with the lines right before it in the same container and other
stretches in that container, or in sections beside it.

Defined results: null, empty and unmarked text-free pages give ''. Rows are treated one by one, repeated ones alike. References
are decoded, white space within a block is one space, br counts as white space, blocks are joined by one line feed. Whole pages
are read. Other columns pass through, but for those named like the one added, which it replaces.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.bpe import slices
from harrow.llm.shared import tidy, with_fields

WINDOW = 3
SURGE = 86  # characters in a window
DEEPEST = 512  # open elements that are told apart
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table caption tbody td tfoot th thead tr ul select button noscript template svg math object video audio canvas".split()
)
#: An element that ends when one of its kind starts, unless one of these is open in between.
IMPLIED = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BARRED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "select", "button", "noscript", "template", "svg", "math", "object", "video", "audio", "canvas"}
BARRED_ROLES = {"navigation", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
BARRED_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer ad ads adv advert adverts advertisement advertisements advertising adslot adsense adbox "
    "sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond reply replies discussion related recommended recommendations share sharing social toolbar form "
    "banner banners popular trending skip paywall announcement announcements".split()
)
#: Of these a part of a word is enough.
BARRED_PARTS = re.compile("sidebar|footer|navbar|navigation|advert|cookie|newsletter|comments|breadcrumb|sponsor|popup|subscri|disqus")
HEAD_WORDS = {"header", "masthead", "topbar"}
BODY_NAMES = {"articlebody", "article-body", "article-content", "article-text", "post-content", "post-body", "entry-content", "story-body", "story-content"}
COMMENTS = re.compile(r"\W*(\d+\s+)?((reader|user|leave (a|your)|post a|all|latest)\s+)?(comments?|replies|repl(y|ies)|kommentare?|commentaires?|comentarios?)\W*(\(?\d+\)?)?\W*", re.I)

_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # characters in links
    inside: int  # its container, by number
    bars: int  # barred elements open around it
    content_bars: int  # those opened since the article began
    article: int  # the outermost open article's number, or -1
    main: bool
    heading: int  # 1 to 6, or 0

    @property
    def weight(self) -> int:
        return len(self.text) - self.linked


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _named(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".split()


def _barred(name: str, attributes: dict[str, str], in_content: bool) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name in BARRED or (name == "header" and not in_content) or "hidden" in attributes:
        return True
    role = attributes.get("role", "").lower()
    if role in BARRED_ROLES or (role == "banner" and not in_content) or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    for token in _named(attributes):
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or words[0] in ("no", "has", "with", "without") or "with" in words:
            continue  # a layout's name says what else is on the page
        if not BARRED_WORDS.isdisjoint(words) or BARRED_PARTS.search(token.lower()) or (not in_content and not HEAD_WORDS.isdisjoint(words)):
            return True
    return False


class _Page:
    """Lines of a page, gathered in one pass."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parents = [-1]  # of each container; 0 is the page
        self.depths = [0]
        self.names = [""]
        self.articles = 0
        self.stack: list[tuple[str, bool, int, int, bool, int]] = []  # name, barred, container, article, main, bars in content before
        self.open: dict[str, int] = {}
        self.bars = self.content_bars = self.links = self.heading = 0
        self.article, self.main = -1, False
        self.parts: list[str] = []
        self.linked: list[str] = []

    @property
    def inside(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def data(self, text: str) -> None:
        if text:
            self.parts.append(html.unescape(text) if "&" in text else text)
            if self.links:
                self.linked.append(self.parts[-1])

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                linked = min(len(text), len(_SPACE.sub(" ", "".join(self.linked)).strip())) if self.linked else 0
                self.lines.append(Line(text, linked, self.inside, self.bars, self.content_bars, self.article, self.main, self.heading))
            self.parts, self.linked = [], []

    def push(self, name: str, attributes: dict[str, str], barred: bool) -> None:
        parent = self.inside
        if name in BLOCKS and name != "p" and not (len(name) == 2 and name[0] == "h") and len(self.stack) < DEEPEST:
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.names.append(name)
            parent = len(self.parents) - 1
        self.stack.append((name, barred, parent, self.article, self.main, self.content_bars))
        self.open[name] = self.open.get(name, 0) + 1
        self.bars += barred
        if self.article >= 0 or self.main:
            self.content_bars += barred
        starts = name == "article" or attributes.get("itemprop", "").lower() == "articlebody" or not BODY_NAMES.isdisjoint(x.lower() for x in _named(attributes))
        if self.article < 0 and starts and not (barred and name != "article"):
            self.article, self.articles, self.content_bars = self.articles, self.articles + 1, int(barred)
        if not self.main and (name == "main" or attributes.get("role", "").lower() == "main"):
            self.main = True
            if self.article < 0:
                self.content_bars = 0

    def pop(self) -> None:
        name, barred, _, self.article, self.main, self.content_bars = self.stack.pop()
        self.open[name] -= 1
        self.bars -= barred

    def start(self, name: str, text: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            self.heading = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0
            if name == "body":
                while self.stack and self.open.get("head"):
                    self.pop()
            while self.open.get("p") and self.stack[-1][0] not in BLOCKS - {"p"}:
                last = self.stack[-1][0]
                self.pop()
                if last == "p":
                    break
            if name in IMPLIED and self.open.get(name):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in IMPLIED[name]:
                        break
                    if self.stack[k][0] == name:
                        while len(self.stack) > k:
                            self.pop()
                        break
        elif name == "br":
            self.parts.append(" ")
        if name == "a":
            self.links = 1
        if name in VOID or text.endswith("/") and name in ("svg", "math", "object"):
            return
        attributes = _attributes(text) if text else {}
        barred = _barred(name, attributes, self.article >= 0 or self.main)
        if block or barred:
            if barred and not block:
                self.flush()
            self.push(name, attributes, barred)

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in BLOCKS or self.open.get(name):
            self.flush()
            self.heading = 0
        if self.open.get(name):
            while True:
                last = self.stack[-1][0]
                self.pop()
                if last == name:
                    return


def lines_of(page: str) -> _Page:
    out, done, at, quoted = _Page(), 0, 0, True
    last = page.rfind(">")
    while m := _MARK.search(page, at):
        at = m.start()
        if page.startswith("<!--", at):
            out.data(page[done:at])
            end = page.find("-->", at + 4)
            done = at = len(page) if end < 0 else end + 3
            continue
        if at > last:
            break
        tag = (_TAG if quoted else _PLAIN).match(page, at)
        if tag is None and quoted and page[at + 1].isalpha():  # a quote that doesn't end: from here on any > ends a tag
            quoted, tag = False, _PLAIN.match(page, at)
        out.data(page[done:at])
        if tag is None:  # a declaration, or the end of no element
            end = page.find(">", at)
            done = at = end + 1
            continue
        done = at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            out.end(name)
            continue
        if name in RAW:
            over = _ENDS[name].search(page, at)
            done = at = over.end() if over else len(page)
            continue
        out.start(name, tag[3].strip())
    out.data(page[done:] if at <= last or "<" not in page[done:] else page[done : page.index("<", done)])
    out.flush()
    return out


def stretches(weights: list[int], threshold: int) -> list[tuple[int, int]]:
    """From each surge to the dive that follows, as line numbers, the end left out."""
    n = len(weights)
    total = [0] * (n + 1)
    for i, w in enumerate(weights):
        total[i + 1] = total[i] + w
    window = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if weights[i] and window[i] >= threshold:
            j = i
            while j < n and window[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _in_article(lines: list[Line]) -> list[Line] | None:
    """The lines of the page's article as it is marked, or None."""
    for bars in ("bars", "content_bars"):  # an article in a barred element counts where there is no other
        weights: dict[int, int] = {}
        for x in lines:
            if x.article >= 0 and not getattr(x, bars):
                weights[x.article] = weights.get(x.article, 0) + x.weight + 1
        if weights:
            best = max(weights, key=lambda k: (weights[k], -k))
            own = [x for x in lines if x.article == best and not getattr(x, bars)]
            if not any(x.heading == 1 for x in own):  # its title may stand before it
                first = next(i for i, x in enumerate(lines) if x is own[0])
                own = [x for x in lines[:first] if x.main and x.article < 0 and x.heading == 1 and not x.bars] + own
            return own
        if own := [x for x in lines if x.main and not getattr(x, bars)]:
            return own
    return None


def _common(page: _Page, lines: list[Line]) -> int:
    """The deepest container of all lines."""
    out = lines[0].inside
    for x in lines[1:]:
        other = x.inside
        while out != other:
            if page.depths[out] >= page.depths[other]:
                out = page.parents[out]
            else:
                other = page.parents[other]
    return out


def _within(page: _Page, inner: int, outer: int) -> bool:
    while page.depths[inner] > page.depths[outer]:
        inner = page.parents[inner]
    return inner == outer


def _bar_comments(page: _Page) -> list[Line]:
    """The page's lines; from a heading that says comments on they are barred until its container ends."""
    under = None
    for x in page.lines:
        if under is not None and not _within(page, x.inside, under):
            under = None
        if under is None and x.heading > 1 and COMMENTS.fullmatch(x.text):
            under = x.inside
        if under is not None:
            x.bars += 1
            x.content_bars += 1
    return page.lines


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines_of(page)
    lines = _bar_comments(found)
    marked = _in_article(lines)
    if marked is not None:
        kept = [x for start, end in stretches([len(x.text) for x in marked], 1) for x in marked[start:end]]
        return "\n".join(x.text for x in kept)
    # what is barred inside a container is passed over; between containers it is a gap
    line: list[Line | None] = []
    gap = False
    for x in lines:
        if x.bars:
            gap = True
            continue
        if gap and line and _common(found, [line[-1], x]) not in (line[-1].inside, x.inside):
            line += [None] * WINDOW
        line.append(x)
        gap = False
    weights = [0 if x is None else x.weight for x in line]
    largest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    runs = stretches(weights, max(1, min(SURGE, largest // 2)))
    if not runs:
        return ""
    best = max(runs, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))
    some = {r: [x for x in line[r[0] : r[1]] if x is not None] for r in runs}
    inside = _common(found, some[best])
    own = found.depths[inside] > 2  # more than the page's body

    def belongs(r: tuple[int, int]) -> bool:
        if r == best or not own:
            return all(x.inside == inside for x in some[r]) or r == best
        other = _common(found, some[r])
        part = found.names[inside] == "section" == found.names[other] and found.parents[inside] == found.parents[other]  # of one text
        return part or _within(found, other, inside)

    out: list[str] = []
    after = 0
    for start, end in runs:
        if not belongs((start, end)):
            continue
        while start > after and weights[start - 1] and (line[start - 1].heading or line[start - 1].inside == line[start].inside):
            start -= 1
        out += [x.text for x in line[start:end] if x is not None]
        after = end
    return "\n".join(out)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each added."""
    kept = [c for c in pages.columns if c.lower() != text.lower() or c == page]
    pages = pages.select(kept)
    schema = with_fields(pages.select([c for c in kept if c != text]).schema, **{text: "string"})

    def run(batches):
        for whole in batches:
            for batch in slices(whole, page):
                texts = pa.array([main_text(x) for x in batch.column(page).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), texts], names=schema.names)

    return pages.mapInArrow(tidy(run), schema)


def op12_html_text(spark, sf_dir) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_html_text": op12_html_text}
ORACLE: dict = {}
