"""Web pages as tables. Text work is done by regular expressions in the JVM; one small parser turns a page into a table of its elements,
and lists, columns and navigation are then found by grouping and joining that table."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import WS, clean, is_junk, text
from harrow.functions.web import bare_host, clean_linkedin, clean_website, host_of, path_of
from harrow.session import joined, written

# Elements without visible text, those that begin a line, and those around navigation.
SCRIPT = r"(?is)<(script|style|noscript|template|iframe|object|embed|svg)\b[^>]*>.*?</\1\s*>"
BLOCKS = r"(?i)</?(p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|br|dt|dd|address|header|footer|main|aside|nav|blockquote|figcaption)\b[^>]*>"
CHROME = r"(?is)<(nav|header|footer|aside)\b[^>]*>.*?</\1\s*>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "nav", "body"}
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def inert(html) -> Column:
    """A page that does nothing: no scripts or frames, event attributes, script addresses or comments."""
    s = F.regexp_replace(F.regexp_replace(text(html), "(?s)<!--.*?-->", ""), SCRIPT, "")
    s = F.regexp_replace(s, r"(?i)<(script|iframe|object|embed)\b[^>]*>", "")
    s = F.regexp_replace(s, r"(?i)\s+on[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    s = F.regexp_replace(s, r"(?i)(href|src|action)\s*=\s*([\"'])\s*javascript:[^\"']*\2", "$1=$2$2")
    return F.regexp_replace(s, r"(?i)(<img\b[^>]*?)\sdata-src=", "$1 src=")


def entities(c: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def page_text(html) -> Column:
    """The words of a page on one line."""
    s = F.regexp_replace(F.regexp_replace(text(html), "(?s)<!--.*?-->", " "), SCRIPT, " ")
    return F.trim(F.regexp_replace(entities(F.regexp_replace(s, "<[^>]+>", " ")), f"[{WS}]+", " "))


def page_lines(html, content_only: bool = False) -> Column:
    """The visible lines of a page, one for each block; content_only leaves navigation, headers and footers out."""
    s = F.regexp_replace(F.regexp_replace(text(html), "(?s)<!--.*?-->", ""), SCRIPT, "")
    s = F.regexp_replace(s, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    if content_only:
        s = F.regexp_replace(s, CHROME, "\n")
    s = entities(F.regexp_replace(F.regexp_replace(s, BLOCKS, "\n"), "<[^>]+>", ""))
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, f"[{WS}]+", " ")))
    return F.filter(lines, lambda x: x != "")


NAV_OPEN, NAV_END = "\ue002", "\ue003"


def flagged_lines(html) -> Column:
    """The visible lines of a page as page_lines has them, each with whether it is content: outside of navigation, headers and footers. One pass over the page."""
    s = F.regexp_replace(F.regexp_replace(F.translate(text(html), NAV_OPEN + NAV_END, "  "), "(?s)<!--.*?-->", ""), SCRIPT, "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?is)<head\b[^>]*>.*?</head\s*>", ""), CHROME, f"{NAV_OPEN}$0{NAV_END}")

    def lines(part: Column, k: Column) -> Column:
        said = entities(F.regexp_replace(F.regexp_replace(part, BLOCKS, "\n"), "<[^>]+>", ""))
        tidy = F.transform(F.split(said, "\n"), lambda x: F.trim(F.regexp_replace(x, f"[{WS}]+", " ")))
        return F.transform(F.filter(tidy, lambda x: x != ""), lambda x: F.struct(x.alias("line"), (k % 2 == 0).alias("content")))

    return F.flatten(F.transform(F.split(s, f"[{NAV_OPEN}{NAV_END}]"), lines))


def anchors(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(…, pos, href, label): the links of each page in order; href as written, entities resolved."""
    whole = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    found = pages.select(*keep, F.posexplode(whole).alias("pos", "a"))
    href = F.replace(F.regexp_extract("a", r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("&amp;"), F.lit("&"))
    label = clean(F.regexp_replace(F.regexp_replace("a", "<[^>]+>", " "), "&nbsp;", " "))
    return found.select(*keep, "pos", href.alias("href"), label.alias("label")).where("href <> ''")


def resolved(href, base) -> Column:
    """An absolute http address of a link on a page; null for mail, telephone and script links."""
    h, b = F.trim(F.col(href)), F.col(base)
    origin = F.regexp_extract(b, r"(?i)^https?://[^/?#]*", 0)
    folder = F.concat(origin, F.regexp_extract(F.concat(path_of(b), F.lit("")), "^(.*/)", 1))
    relative = F.concat(F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder), h)
    whole = F.when(h.rlike("(?i)^https?://"), h).when(h.rlike("^//"), F.concat(F.regexp_extract(b, "^[a-zA-Z]+:", 0), h)).when(h.rlike("^/"), F.concat(origin, h))
    return F.when(h.rlike(r"(?i)^(#|[a-z][a-z0-9+.-]*:)") & ~h.rlike("(?i)^https?://"), None).otherwise(F.coalesce(whole, relative))


# What pages about the company itself are called; the first kind that fits counts.
LINK_KINDS = [
    (1, r"(?iu)impressum|imprint|legal[-_ ]?notice|anbieterkennzeichnung|mentions[-_ ]?l[ée]gales|note[-_ ]?legali|aviso[-_ ]?legal|informaci[óo]n[-_ ]?legal|colofon|colophon|stopka[-_ ]?redakcyjna"),
    (2, r"(?iu)team|management|ueber[-_ ]?uns|[uü]ber[-_ ]?uns|about|wir[-_ ]?ueber|leitung|vorstand|people|unternehmen|company|who[-_ ]we[-_ ]are|verlag|[ée]quipe|qui[-_ ]sommes[-_ ]nous|chi[-_ ]siamo|quienes[-_ ]somos|qui[ée]nes[-_ ]somos|nosotros|over[-_ ]ons|o[-_ ]nas|redazione|staff"),
    (3, r"(?iu)kontakt|contact|contatti|contacto"),
]


def company_pages(links: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, target, kind): up to so many links of a page to the same site's legal, team and contact pages, the best kinds first."""
    url = resolved("href", "url")
    kind = F.coalesce(*[F.when(F.col("_path").rlike(p) | F.substring("label", 1, 80).rlike(p), k) for k, p in LINK_KINDS])
    found = links.withColumn("_url", url).withColumn("_path", path_of("_url")).where("_url IS NOT NULL")
    own = found.where((bare_host("_url") == bare_host("url")) & ~F.col("_path").rlike(r"(?i)\.(pdf|jpe?g|png|zip|docx?)$"))
    target = F.concat(F.regexp_extract("_url", r"(?i)^https?://[^/?#]*", 0), F.regexp_replace("_path", "/$", ""))
    scored = own.withColumn("kind", kind).withColumn("target", target).where(F.col("kind").isNotNull() & (F.col("target") != F.regexp_extract("url", r"(?i)^https?://[^/?#]*", 0)))
    once = scored.groupBy("page_id", "target").agg(F.min("kind").alias("kind"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "pos"))
    return once.withColumn("_r", rank).where(F.col("_r") <= most).select("page_id", "target", "kind")


# What controls for a next page, and for more of the same page, are called.
NEXT = r"(?iu)^(next|next page|›|»|>|→|weiter|nächste|nächste seite|suivant|siguiente|próxima|avanti|volgende|następna|dalej)$"
NEXT_HINT = r"(?iu)(?<![A-Za-z0-9_])next(?![A-Za-z0-9_])|nächste|suivant|siguiente"
MORE = r"(?iu)^(load more|show more|more results|see more|view more|mehr laden|mehr anzeigen|weitere laden|plus de résultats|cargar más|ver más)$"
ARROWS = "[→›»>←‹«<]+"


def controls(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(…, pos, href, label, rel, hint): the links and buttons of each page in order that are not disabled; hint: what their aria-label and title say."""
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:a|button)\b[^>]*>.*?</(?:a|button)\s*>"), F.lit(0))).alias("pos", "e"))
    tag = F.regexp_extract("e", "^<[^>]*>", 0)
    attr = lambda name: F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = clean(F.regexp_replace(entities(F.regexp_replace("e", "<[^>]+>", " ")), ARROWS, " "))
    shown = F.when((label == "") & F.regexp_replace("e", "<[^>]+>", " ").rlike("[→›»]|&gt;"), "›").otherwise(label)
    live = ~tag.rlike(r"(?i)\sdisabled(\s|=|>|/)") & (attr("aria-disabled") != "true")
    return found.where(live).select(*keep, "pos", F.replace(attr("href"), F.lit("&amp;"), F.lit("&")).alias("href"), shown.alias("label"), attr("rel").alias("rel"), F.concat_ws(" ", attr("aria-label"), attr("title")).alias("hint"))


def next_links(found: DataFrame) -> DataFrame:
    """(page_id, control, href): of controls, the first that leads to a next page, else the first that loads more."""
    kind = F.when((F.col("rel") == "next") | F.col("label").rlike(NEXT) | F.col("hint").rlike(NEXT_HINT), 1).when(F.col("label").rlike(MORE), 2)
    best = found.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("page_id").agg(F.min(F.struct("kind", "pos", "href")).alias("x"))
    return best.select("page_id", F.when(F.col("x.kind") == 1, "next").otherwise("more").alias("control"), "x.href")


# How links of a landing page to a directory are worded and addressed.
DIRECTORY_TEXT = r"(?iu)(?<![A-Za-z0-9_])(((open|go to|view|search|browse|explore|show|see|find|launch|to the|zum|zur)\s+(the\s+)?(exhibitor|company|vendor|publisher|member|participant|speaker)s?\s*(directory|list|search|catalogue|catalog|database|marketplace|finder|overview|verzeichnis|suche|liste|katalog)?)|((exhibitor|company|vendor|publisher|member|participant)\s+(directory|search|database|catalogue|catalog|marketplace|finder))|(ausstellerverzeichnis|ausstellersuche|ausstellerkatalog|firmenverzeichnis))(?![A-Za-z0-9_])"
DIRECTORY_PATH = r"(?i)/(marketplace/)?(exhibitors|exhibitor-directory|exhibitor-search|company-directory|companies)/?$"
DIRECTORY_WORD = r"(?i)(?<![A-Za-z0-9_])(exhibitor|company|directory|marketplace|catalogue|catalog|search|aussteller|verzeichnis|suche|katalog)(?![A-Za-z0-9_])"


def directory_links(links: DataFrame, most: int = 4) -> DataFrame:
    """(page_id, target, label): links of a landing page to the directory itself, those whose words say so first."""
    found = links.withColumn("target", resolved("href", "url")).where("target IS NOT NULL").withColumn("_path", path_of("target"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(path_of(c), r"(?i)^/(de|en|fr|es|it)(/|$)", "/"), "/+$", "")
    other = (host_of("target") != host_of("url")) | (bare("target") != bare("url"))
    named = F.col("label").rlike(DIRECTORY_TEXT)
    placed = F.col("_path").rlike(DIRECTORY_PATH) & ((F.col("label") == "") | F.col("label").rlike(DIRECTORY_WORD))
    language = F.col("label").rlike("(?i)^(de|en|fr|es|it|deutsch|english)$")
    kept = found.where(other & ~language & (named | placed)).withColumn("priority", F.when(named, 2).otherwise(1))
    once = kept.withColumn("_o", F.row_number().over(Window.partitionBy("page_id", "target").orderBy("pos"))).where("_o = 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("priority"), "pos"))
    label = F.when((F.col("label") != "") & (F.length("label") <= 70), F.col("label")).otherwise("Open exhibitor directory")
    return once.withColumn("_r", rank).where(F.col("_r") <= most).select("page_id", "target", label.alias("label"))


def profile_links(links: DataFrame, fair_host: str | None = None) -> DataFrame:
    """(page_id, website, linkedin) of profile pages: the first outside link that shows its own address or is called a website, and the first profile link."""
    asset = r"(?i)(^|\.)(fonts|gstatic|googleapis|cdnjs|cloudflare|jsdelivr|unpkg|w3|schema|sentry|cdnfonts|gravatar|typekit|bootstrapcdn|youtube-nocookie|vimeo|maps)\."
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("label"), "^https?://", ""), r"^www\.", ""), "/$", "")
    named = F.lower("label").rlike("^(website|webseite|homepage|web|visit website|zur website)$") | ((F.col("label") != "") & shown.startswith(bare_host("href")))
    origin = F.regexp_extract("href", r"(?i)^https?://[^/?#]*", 0)
    linkedin = clean_linkedin("href")
    outside = links.where(F.col("href").rlike("(?i)^https?://")).withColumns({"_l": linkedin, "_w": F.when(linkedin.isNull() & named & ~F.concat(host_of("href"), F.lit(".")).rlike(asset), clean_website(origin, fair_host))})
    return outside.groupBy("page_id").agg(F.min_by("_w", F.when(F.col("_w").isNotNull(), F.col("pos"))).alias("website"), F.min_by("_l", F.when(F.col("_l").isNotNull(), F.col("pos"))).alias("linkedin"))


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, feature, n): hooks (t:), style ids (s:), classes (c:) and the size of the text (text) of each page."""
    h = F.col(html)
    found = lambda mark, attr: F.transform(F.regexp_extract_all(h, F.lit(rf"\s{attr}=[\"']([^\"']{{1,60}})[\"']"), F.lit(1)), lambda x: F.concat(F.lit(mark), x))
    classes = F.flatten(F.transform(F.regexp_extract_all(h, F.lit(r"\sclass=[\"']([^\"']{0,300})[\"']"), F.lit(1)), lambda x: F.split(F.trim(x), r"\s+")))
    names = F.transform(F.filter(classes, lambda x: (x != "") & (F.length(x) < 60)), lambda x: F.concat(F.lit("c:"), x))
    each = pages.select("page_id", F.explode(F.concat(found("t:", "data-testid"), found("s:", "data-styleid"), names)).alias("feature"))
    sizes = pages.select("page_id", F.lit("text").alias("feature"), F.length(page_text(html)).cast("long").alias("n"))
    return each.groupBy("page_id", "feature").agg(F.count("*").alias("n")).unionByName(sizes)


def deepest_pages(features: DataFrame) -> DataFrame:
    """(feature, page_id, n): of each hook that some page has twice or more, the page with the most of it."""
    hooks = features.where("feature LIKE 't:%' AND n >= 2")
    return hooks.groupBy("feature").agg(F.max_by("page_id", F.struct("n", -F.col("page_id"))).alias("page_id"), F.max("n").alias("n"))


BARE_START, BARE_END = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
RAW_TEXT_TAGS = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Open:
    """An element that is still open: what its row will hold, and the groups of siblings met in it."""

    __slots__ = ("node", "tag", "sig", "texts", "whole", "link", "hook", "itemtype", "hint", "full", "aria", "chrome", "chain", "sigs", "groups", "ords", "kinds")


class _Elements(HTMLParser):
    """The elements of a page with their ancestors, own text and what tells siblings apart; end tags that pages leave out are understood. Closed elements
    wait in done as rows, with the groups of siblings in place of their sizes, which are known at the page's end; keep: whether rows are made at all."""

    def __init__(self, base: str, keep: bool = True):
        super().__init__(convert_charrefs=True)
        self.base, self.keep, self.count, self.mute = base, keep, 0, 0
        self.open, self.full, self.done, self.sizes = [], [], [], array("i")
        self.top: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs} if attrs else {}
        closed = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            above = self.open[i].tag
            if above in closed:
                self.shut(i)
                break
            if above in SCOPES:
                break
        names = sorted(c for c in a["class"].split() if not any(x.isdigit() for x in c))[:3] if "class" in a else ()
        x, up = _Open(), self.open[-1] if self.open else None
        x.node, x.tag, x.kinds = self.count, tag, {}
        x.sig = ".".join([tag, *names]) + (f"[{a['data-testid']}]" if a.get("data-testid") else "")
        kinds = up.kinds if up else self.top
        group = kinds.setdefault(x.sig, len(self.sizes))
        if group == len(self.sizes):
            self.sizes.append(0)
        self.sizes[group] += 1
        self.count += 1
        if self.keep:
            link = a.get("href") if tag == "a" else a.get("src") or a.get("data-src")
            x.link = link.split(":", 1)[1].split("?")[0] if link and link.lower().startswith(("mailto:", "tel:")) else urljoin(self.base, link) if link and not link.lower().startswith("javascript:") else None
            x.hint = " ".join(filter(None, map(a.get, ("data-testid", "data-styleid", "itemtype", "class")))) if a else ""
            x.hook, x.itemtype, x.aria = a.get("data-testid"), a.get("itemtype") if "itemscope" in a else None, a.get("aria-label")
            x.full = a.get("title") or a.get("data-title") or a.get("data-full-text")
            inherited = up.chrome if up else None
            x.chrome = inherited if inherited is not None else len(self.open) if tag in CHROME_TAGS else None
            own = x.node, x.sig, group, self.sizes[group]
            if up:
                x.chain, x.sigs, x.groups, x.ords = [*up.chain, own[0]], [*up.sigs, own[1]], [*up.groups, own[2]], [*up.ords, own[3]]
            else:
                x.chain, x.sigs, x.groups, x.ords = ([c] for c in own)
            x.texts, x.whole = [], [] if tag in FULL_TEXT_TAGS else None
        if tag in ("script", "style"):
            self.mute += 1
        self.open.append(x)
        if tag in VOID:
            self.shut(len(self.open) - 1)
        elif tag in FULL_TEXT_TAGS:
            self.full.append(x)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                if tag in ("script", "style"):
                    self.mute -= 1
                self.shut(at)
                break

    def handle_data(self, data):
        if self.keep and self.open and not self.mute:
            self.open[-1].texts.append(data)
            for x in self.full:
                x.whole.append(data)

    def parse_starttag(self, i):
        """Most tags are a bare name, which needs no search for attributes."""
        m = BARE_START.match(self.rawdata, i)
        if not m or (tag := m[1].lower()) in RAW_TEXT_TAGS:
            return super().parse_starttag(i)
        self.handle_starttag(tag, ())
        return m.end()

    def parse_endtag(self, i):
        m = BARE_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not m:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def shut(self, at):
        """Closes the element at a depth, and those in it."""
        for x in self.open[at:]:
            if x.tag in FULL_TEXT_TAGS:
                self.full.remove(x)
            if self.keep:
                own = " ".join(" ".join(x.texts).split())
                whole = " ".join("".join(x.whole).split()) if x.whole is not None else None
                self.done.append((x.node, x.chain[-2] if len(x.chain) > 1 else -1, self.count - 1, x.tag, x.sig, own, whole, x.link, x.chrome is not None, x.hook, x.itemtype, x.hint, x.full, x.aria, x.chrome, x.chain, x.sigs, x.groups, x.ords))
        del self.open[at:]

    def close(self):
        super().close()
        self.shut(0)


CHROME_TAGS = {"nav", "header", "footer", "aside"}
TAG = re.compile("[a-z0-9]+")  # of a signature
FULL_TEXT_TAGS = {"h1", "th", "td", "dt", "dd"}  # whose text is wanted with that of the elements inside
NODES = "page_id long, node int, parent int, last int, tag string, sig string, own string, whole string, link string, chrome boolean, hook string, itemtype string, hint string, full string, aria string, chrome_depth int, chain array<int>, sigs array<string>, items array<int>, ords array<int>"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in NODES.split(", "))])
_GROUPS = _SCHEMA.get_field_index("items") - 1  # in a row without its page
LONG_PAGE, PIECE = 1_000_000, 100_000  # characters from which on a page is parsed twice, and read in pieces of


def page_elements(base: str, html: str, long: int = LONG_PAGE, piece: int = PIECE) -> Iterator[list[tuple]]:
    """The rows of a page's elements, in parts. A long page is parsed twice, first for the sizes of its groups of siblings, then in pieces that end before a tag, so that only open elements are held."""
    sized = lambda rows, sizes: [(*x[:_GROUPS], list(map(sizes.__getitem__, x[_GROUPS])), x[_GROUPS + 1]) for x in rows]
    first = _Elements(base, keep=len(html) <= long)
    first.feed(html)
    first.close()
    if first.keep:
        yield sorted(sized(first.done, first.sizes))
        return
    second, start = _Elements(base), 0
    while start < len(html):
        end = html.find("<", start + piece)
        end = len(html) if end < 0 else end
        second.feed(html[start:end])
        start = end
        yield sized(second.done, first.sizes)
        second.done.clear()
    second.close()
    yield sized(second.done, first.sizes)


def _parsed(pages: DataFrame, html: str, read: Callable[[str, str], Iterator[list[tuple]]], schema: pa.Schema, kinds: str, based: bool, each: int) -> DataFrame:
    """The rows that read makes of each page, behind its page_id. Pages of the same text (and, if based, address) are read once as long as no more than some thousand rows have been met; their rows are then
    picked from these by number. Some thousand rows are held at a time, however long a page is."""
    own = pa.schema([f for f in schema if f.name != "page_id"])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own)

    def behind(ids: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([ids, *rows.columns], schema=schema)
        for k in range(0, whole.num_rows, each):
            yield whole.slice(k, each)

    def run(batches):
        met: dict = {}  # of a page's text, the place of its rows and their number
        rows, made = [], None  # what was read, and as a batch
        asked, count = [], 0  # pages whose rows are due: page_id, place and number

        def due():
            nonlocal made, count
            if count:
                if made is None or made.num_rows < len(rows):
                    made = batch(rows)
                sizes = np.array([n for _, _, n in asked])
                ends = np.cumsum(sizes)
                places = np.arange(count) + np.repeat(np.array([at for _, at, _ in asked]) - ends + sizes, sizes)
                ids = pa.array([page_id for page_id, _, _ in asked], pa.int64()).take(pa.array(np.repeat(np.arange(len(asked)), sizes)))
                yield from behind(ids, made.take(pa.array(places)))
            asked.clear()
            count = 0

        for whole in batches:
            for i in range(whole.num_rows):
                page_id, url, body = (whole.column(k)[i].as_py() for k in range(3))
                url, body = url or "", body or ""
                if len(body) > LONG_PAGE:
                    yield from due()
                    for part in read(url, body):
                        if part:
                            yield from behind(pa.array([page_id] * len(part), pa.int64()), batch(part))
                    continue
                key = (url, body) if based else body
                if key not in met:
                    if len(rows) + len(met) >= each:
                        yield from due()
                        met, rows, made = {}, [], None
                    at = len(rows)
                    for part in read(url, body):
                        rows += part
                    met[key] = at, len(rows) - at
                at, n = met[key]
                asked.append((page_id, at, n))
                count += n
                if count >= each:
                    yield from due()
        yield from due()

    return pages.select("page_id", "url", html).mapInArrow(run, kinds)


def elements(pages: DataFrame, html: str = "html", each: int = 5000) -> DataFrame:
    """A row for each element, in document order unless its page is long: its page, number, parent and last element inside; tag, signature, own text (for headings and cells the whole text too), address, hooks and attributes; whether it
    is navigation and from which depth on; and, from the root to itself, the elements it lies in, their signatures, how many siblings share them and
    the place among those. Lists, their items and cells are then read off without a join. Some thousand rows are held at a time, however long a page is."""
    return _parsed(pages, html, page_elements, _SCHEMA, NODES, True, each)


TABLE_PARTS = "page_id long, node int, is_row boolean, table int, head boolean, row int, text string"


def page_table_parts(base: str, html: str) -> Iterator[list[tuple]]:
    """Of page_elements, the rows of tables with their table and whether they lie in a thead, and the cells with their row, its table and their text."""
    at = {name: i for i, name in enumerate(_SCHEMA.names[1:])}
    node, tag, whole, chain, sigs = (at[c] for c in ("node", "tag", "whole", "chain", "sigs"))
    for part in page_elements(base, html):
        found = []
        for x in part:
            if x[tag] in ("tr", "td", "th"):
                near = {TAG.match(s)[0] if TAG.match(s) else "": (n, k) for k, (n, s) in enumerate(zip(x[chain][:-1], x[sigs][:-1], strict=True))}
                if x[tag] == "tr":
                    found.append((x[node], True, near.get("table", (None,))[0], "thead" in near, None, None))
                elif "tr" in near:
                    row, k = near["tr"]
                    table = next((n for n, s in zip(reversed(x[chain][:k]), reversed(x[sigs][:k]), strict=True) if TAG.match(s) and TAG.match(s)[0] == "table"), None)
                    found.append((x[node], False, table, None, row, x[whole]))
        yield found


def table_parts(pages: DataFrame, html: str = "html", each: int = 5000) -> DataFrame:
    """(page_id, node, is_row, table, head, row, text): the rows and cells of the tables of each page, without its other elements."""
    kinds = [c.split() for c in TABLE_PARTS.split(", ")]
    return _parsed(pages, html, page_table_parts, pa.schema([(name, _TYPES[kind]) for name, kind in kinds]), TABLE_PARTS, False, each)


def sibling_lists(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, parent, sig, items, first, last, chrome): siblings of one signature, three or more."""
    many = nodes.where(F.element_at("items", -1) >= least)
    return many.groupBy("page_id", "parent", "sig").agg(F.count("*").alias("items"), F.min("node").alias("first"), F.max("node").alias("last"), F.max("chrome").alias("chrome"))


ITEM = ["page_id", "parent", "sig", "items", "chrome", "item", "item_ord"]


def in_items(nodes: DataFrame, least: int = 3) -> DataFrame:
    """nodes once for each list item that they are or lie in, at any depth, with the list (parent, sig, items, chrome), the item and its number, and their path from
    the item down: signatures, with the place of steps that repeat, but not of the last, whose repeats are one field (cells of a table are fields of their own).
    Read off each element's own chain: one pass, no join."""
    levels = F.filter(F.sequence(F.lit(1), F.size("chain")), lambda i: F.element_at("items", i) >= least)
    at = lambda c: F.element_at(c, F.col("_i"))
    each = nodes.withColumnsRenamed({"parent": "own_parent", "sig": "own_sig", "chrome": "own_chrome"}).withColumn("_i", F.explode(levels))
    below = F.slice(F.arrays_zip("sigs", "items", "ords"), F.col("_i") + 1, F.size("sigs"))

    def step(x: Column, k: Column) -> Column:
        apart = (x["items"] > 1) & ((k < F.size("sigs") - F.col("_i") - 1) | x["sigs"].rlike(r"^t[dh](?![a-z0-9])"))
        return F.concat(F.lit(">"), x["sigs"], F.when(apart, F.concat(F.lit(":"), x["ords"])).otherwise(""))

    list_of = {
        "parent": F.when(F.col("_i") > 1, F.element_at("chain", F.greatest(F.col("_i") - 1, F.lit(1)))).otherwise(-1),
        "sig": at("sigs"),
        "item": at("chain"),
        "item_ord": at("ords"),
        "chrome": F.coalesce(F.col("chrome_depth") < F.col("_i"), F.lit(False)),
        "path": F.array_join(F.transform(below, step), ""),
    }
    return each.withColumns(list_of).withColumn("items", at("items"))


def list_leaves(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, parent, sig, items, chrome, item, item_ord, node, path, attr, value): the texts and links inside each item of each list, however deep."""
    attrs = F.filter(F.array(F.struct(F.lit("own").alias("attr"), F.when(F.col("own").rlike(r"[\p{L}\p{N}]"), F.col("own")).alias("value")), F.struct(F.lit("link").alias("attr"), F.col("link").alias("value"))), lambda x: x["value"].isNotNull())
    return in_items(nodes.where(F.size(attrs) > 0), least).select(*ITEM, "node", "path", F.explode(attrs).alias("x")).select(*ITEM, "node", "path", "x.attr", "x.value")


def listed(nodes: DataFrame, least: int = 3) -> DataFrame:
    """nodes that are or lie in an item of a list, with what list_candidates and list_leaves read, written once: pages are parsed for both together."""
    inside = nodes.where(F.exists("items", lambda n: n >= least))
    return written(inside.select("page_id", "node", "parent", "last", "sig", "own", "link", "chrome", "chrome_depth", "chain", "sigs", "items", "ords"), "listed")


LIST, COLUMN = ["page_id", "parent", "sig"], ["page_id", "parent", "sig", "path", "attr"]


def list_cells(leaves: DataFrame) -> DataFrame:
    """(page_id, parent, sig, path, attr, item_ord, value, multi, node, item, items, chrome): a cell for each item and column. All values that an item repeats stand in it,
    in the page's order, with a comma between."""
    each = leaves.groupBy(*COLUMN, "item_ord").agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("_v"), F.min("item").alias("item"), F.max("items").alias("items"), F.max("chrome").alias("chrome"))
    values = F.array_join(F.transform("_v", lambda x: x["value"]), ", ")
    return each.select(*COLUMN, "item_ord", values.alias("value"), (F.size("_v") > 1).alias("multi"), F.get("_v", 0)["node"].alias("node"), "item", "items", "chrome")


LABEL_END = r"[:：]\s*$"


def cell_columns(cells: DataFrame) -> DataFrame:
    """(page_id, parent, sig, path, attr, items, chrome, first, hits, fill, sample, multi, label, label_strong, place): the columns of each list. A column needs a quarter of the
    items, and two. A text that is the same in every item is a label: it names the next text among the three columns after it and goes. Of columns with the same cells the first
    stays (by a sum of hashes, not the cells)."""
    prints = F.sum(F.xxhash64("item_ord", "value").cast("decimal(38,0)")).alias("_print")
    same = (F.col("items") > 2) & (F.col("hits") == F.col("items")) & F.col("_same") & (F.col("attr") == "own")
    stats = cells.groupBy(*COLUMN).agg(F.max("items").alias("items"), F.max("chrome").alias("chrome"), F.min("item").alias("first"), F.count("*").alias("hits"), F.min_by("value", "item_ord").alias("sample"), (F.min("value") == F.max("value")).alias("_same"), F.max("multi").alias("multi"), F.min("node").alias("node"), prints)
    kept = stats.where(F.col("hits") >= F.greatest(F.lit(2), F.ceil(F.col("items") * 0.25))).withColumn("_const", same)
    order = Window.partitionBy(*LIST).orderBy("node", F.col("attr") == "own", "path")  # an element's address comes before its text
    placed = kept.withColumn("place", F.row_number().over(order))
    before = F.last(F.when(F.col("attr") == "own", F.struct("_const", "sample", "place")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    name = F.regexp_replace("_before.sample", LABEL_END, "")
    names = (F.col("attr") == "own") & F.col("_before._const") & (F.col("place") - F.col("_before.place") <= 3) & (F.length(name) <= 30)
    named = placed.withColumn("_before", before).withColumns({"label": F.when(names, name), "label_strong": F.when(names, F.col("_before.sample").rlike(LABEL_END))}).where(~F.col("_const"))
    out = named.withColumn("_r", F.row_number().over(Window.partitionBy(*LIST, "attr", "_print").orderBy("place"))).where("_r = 1")
    return out.where(~is_junk("sample")).select(*COLUMN, "items", "chrome", "first", "hits", (F.col("hits") / F.col("items")).alias("fill"), "sample", "multi", "label", "label_strong", "place")


def list_columns(leaves: DataFrame) -> DataFrame:
    return cell_columns(list_cells(leaves))


def made_lists(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """columns with items, hits and fill of the items that hold something: an item whose main columns (the first six filled by half, texts unless there are three or fewer; else
    the texts; else all) are all empty is a slot, not a row. A list without any row that holds something stays as it is. cells and columns: as by list_cells and cell_columns."""
    text = F.col("attr") == "own"
    whole, order = Window.partitionBy(*LIST), Window.partitionBy(*LIST, "_main").orderBy("place")
    marked = columns.withColumn("_main", (F.col("fill") >= 0.5) & (text | (F.count("*").over(whole) <= 3))).withColumn("_rank", F.row_number().over(order))
    marked = marked.withColumns({"_any": F.max("_main").over(whole), "_text": F.max(text).over(whole)})
    main = F.when(F.col("_any"), F.col("_main") & (F.col("_rank") <= 6)).when(F.col("_text"), text).otherwise(True)
    own = cells.select(*COLUMN, "item_ord", "value").join(marked.select(*COLUMN, main.alias("_checked")), COLUMN).where(F.length(F.trim("value")) > 0)
    rows = own.groupBy(*LIST, "item_ord").agg(F.max("_checked").alias("_kept"), F.collect_list(F.struct("path", "attr")).alias("_cells"))
    counts = rows.where("_kept").select(*LIST, F.explode("_cells").alias("x")).groupBy(*LIST, "x.path", "x.attr").agg(F.count("*").alias("_hits"))
    sizes = rows.where("_kept").groupBy(*LIST).agg(F.count("*").cast("int").alias("_items"))
    joined = columns.join(sizes, LIST, "left").join(counts, COLUMN, "left")
    hits = F.when(F.col("_items").isNull(), F.col("hits")).otherwise(F.coalesce("_hits", F.lit(0)))
    items = F.coalesce("_items", "items")
    return joined.withColumns({"hits": hits, "fill": hits / items, "items": items}).select(columns.columns)


#: What makes a list: an item's text counts up to so much, its leaves up to so many; small texts with few leaves are menus.
TEXT_MOST, LEAVES_MOST, MENU_LEAVES, MENU_TEXT = 400, 30, 2, 25
IN_CHROME, IN_MENU = 0.15, 0.35
SUBLIST = 8  # a list inside one item of a better one is offered from so many entries on


def list_candidates(nodes: DataFrame) -> DataFrame:
    """(page_id, parent, sig, items, spans, text, weight, score) of siblings that look like records: how long the texts of all their items are and how many texts and links they hold, less in
    navigation and for menus. spans: first and last element of each item."""
    size = F.when(F.col("own") != "", F.length("own") + 1).otherwise(0)
    leaves = F.when(F.col("own").rlike(r"[\p{L}\p{N}]"), 1).otherwise(0) + F.when(F.col("link").isNotNull(), 1).otherwise(0)
    each = in_items(nodes).groupBy(*LIST, "item_ord", "item").agg(F.max(F.when(F.col("node") == F.col("item"), F.col("last"))).alias("last"), F.greatest(F.sum(size) - 1, F.lit(0)).alias("_text"), F.sum(leaves).alias("_leaves"), F.max("chrome").alias("chrome"))
    lists = each.groupBy(*LIST).agg(
        F.count("*").cast("int").alias("items"), F.array_sort(F.collect_list(F.struct(F.col("item").alias("first"), "last"))).alias("spans"),
        F.avg(F.least("_text", F.lit(TEXT_MOST))).alias("text"), F.avg(F.least("_leaves", F.lit(LEAVES_MOST))).alias("_leaves"), F.max("chrome").alias("chrome"),
    )
    menu = (F.col("_leaves") <= MENU_LEAVES) & (F.col("text") < MENU_TEXT)
    weight = F.when(F.col("chrome"), IN_CHROME).otherwise(1.0) * F.when(menu, IN_MENU).otherwise(1.0)
    told = lists.where((F.col("text") >= 2) | (F.col("_leaves") >= 1)).withColumn("weight", weight)
    score = F.pow("items", F.lit(0.6)) * F.log(F.col("text") + 3) * F.least("_leaves", F.lit(12.0)) * F.col("weight")
    return told.select(*LIST, "items", "spans", "text", "weight", score.alias("score"))


def outermost(spans: list[np.ndarray], parents: list[int], most: int | None = None) -> list[int]:
    """Which lists of a page stay, best first, all or so many: not those whose items lie in, or around, those of a better one of the same length, nor short ones inside one item of a better one.
    Items are siblings, nested or apart: the lists around a list are found by one pass over all items, and no pairs of lists are tried but those of one length whose first items are nested."""
    lengths = [len(x) for x in spans]
    items, owners = np.concatenate(spans), np.repeat(np.arange(len(spans)), lengths)
    order = np.argsort(items[:, 0])
    firsts, lasts, owners = items[order, 0].tolist(), items[order, 1].tolist(), owners[order].tolist()
    around, open_items, at = [-1] * len(spans), [], 0  # the list whose item is nearest around each list
    for i in sorted(range(len(spans)), key=parents.__getitem__):
        while at < len(firsts) and firsts[at] <= parents[i]:
            while open_items and open_items[-1][0] < firsts[at]:
                open_items.pop()
            open_items.append((lasts[at], owners[at]))
            at += 1
        while open_items and open_items[-1][0] < parents[i]:
            open_items.pop()
        around[i] = open_items[-1][1] if open_items else -1

    nested = lambda x, y: ((x[..., 0] <= y[..., 0]) & (y[..., 1] <= x[..., 1])) | ((y[..., 0] <= x[..., 0]) & (x[..., 1] <= y[..., 1]))
    heads = {n: np.empty((many, 2), dtype=items.dtype) for n, many in Counter(lengths).items()}  # first items of the chosen, by length
    peers: dict[int, list[int]] = {n: [] for n in heads}
    chosen: list[int] = []
    stays = bytearray(len(spans))
    for i, own in enumerate(spans):
        n = lengths[i]
        if n < SUBLIST:
            k = around[i]
            while k >= 0 and not (stays[k] and lengths[k] != n):
                k = around[k]
            if k >= 0:
                continue
        same = peers[n]
        if any(nested(spans[same[k]], own).all() for k in np.flatnonzero(nested(heads[n][: len(same)], own[0])).tolist()):
            continue
        heads[n][len(same)] = own[0]
        same.append(i)
        stays[i] = 1
        chosen.append(i)
        if len(chosen) == most:
            break
    return chosen


def best_lists(candidates: DataFrame, columns: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, parent, sig, items, columns, score, rank): the lists that a page offers, all of them unless most is given, each once, with a text column at least; by entries, length of text and, now that they are
    known, columns. Areas and visibility on screen don't count, for there is no screen. candidates: as by list_candidates; columns: as by list_columns or made_lists."""

    # one row for each page, with its lists in order
    order = F.struct((-F.round("score", 9)).alias("_by"), *LIST[1:], "text", "weight", F.transform("spans", lambda x: x["first"]).alias("_first"), F.transform("spans", lambda x: x["last"]).alias("_last"))
    pages = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("_lists"))

    def choose(parents: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        each = zip(parents, firsts, lasts, strict=True)
        return pd.Series([outermost([np.stack(x, 1) for x in zip(f, n, strict=True)], list(p), most) for p, f, n in each])

    picks = F.pandas_udf(choose, "array<int>")(*[f"_lists.{c}" for c in ("parent", "_first", "_last")])
    kept = pages.select("page_id", F.explode(F.transform(picks, lambda i: F.get("_lists", i))).alias("x")).select("page_id", "x.parent", "x.sig", "x.text", "x.weight")
    known = columns.groupBy(*LIST).agg(F.count("*").alias("columns"), F.max("items").alias("items"), F.min("first").alias("first"), F.max(F.col("attr") == "own").alias("_text")).where("_text")
    score = F.pow("items", F.lit(0.6)) * F.log(F.col("text") + 3) * F.pow("columns", F.lit(0.8)) * F.col("weight")
    ranked = joined(kept, known, LIST).withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.round("score", 9)), "first")))
    return ranked.select(*LIST, "items", "columns", "score", "rank")
