"""From what a scan captured to the finished table: base rows by scope, item pages read for the chosen fields only, and their cells joined in.

What isn't chosen isn't read: a table without item fields parses no page, one without entries of lists reads no lists, and of rows only the chosen columns, the anchors and what makes their
addresses are scanned.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import filled, text
from harrow.operators import assembly as A
from harrow.operators import catalog as K
from harrow.operators import matching as M
from harrow.operators import pages as H
from harrow.operators.model import visible_rows
from harrow.session import shared_folder, table, written

QUERIES: dict = {}
ORACLE: dict = {}


@dataclass(frozen=True)
class Choice:
    """A column of the finished table: what fills it, and whether it is wanted. page and feed name columns; item names a single field of item pages; entry gives (sig, path, attr) of a cell in a list of theirs."""

    name: str
    page: str | None = None
    feed: str | None = None
    item: str | None = None
    entry: tuple[str, str, str] | None = None
    on: bool = True


@dataclass(frozen=True)
class Scan:
    """What was captured, with rows in the order of _ord. scope: page (the rows on screen), feed (the feed's, with what the page adds) or crawl (rows of several pages, with their address in __url).
    page_anchor and feed_anchor align page and feed; key and pattern, or column, say where each row's own page is."""

    scope: str
    page: DataFrame | None = None
    feed: DataFrame | None = None
    crawl: DataFrame | None = None
    page_anchor: str | None = None
    feed_anchor: str | None = None
    key: str | None = None
    pattern: str | None = None
    column: str | None = None


def base_rows(scan: Scan, choices: list[Choice]) -> DataFrame:
    """(_ord, _url, a column for each chosen one that page or feed fills): the rows of the table before item pages; _url is null where a row has no page of its own."""
    wanted = [c for c in choices if c.on and (c.page or c.feed)]
    on_page, on_feed = {c.name: c.page for c in wanted if c.page}, {c.name: c.feed for c in wanted if c.feed}
    blank = F.lit("")
    if scan.scope == "crawl":
        url = F.when(filled("__url"), F.col("__url")) if "__url" in scan.crawl.columns else F.lit(None).cast("string")
        return scan.crawl.select("_ord", url.alias("_url"), *[text(F.col(f"`{c.page}`")).alias(c.name) if c.page else blank.alias(c.name) for c in wanted])
    key = {"_key": scan.key} if scan.feed is not None and scan.key else {}
    if scan.scope == "feed":
        only = {n: c for n, c in on_page.items() if n not in on_feed}
        if scan.page is not None and scan.page_anchor and only:
            rows = M.feed_rows(scan.page, scan.feed, scan.page_anchor, scan.feed_anchor, only, {**on_feed, **key})
        else:
            rows = scan.feed.select("_ord", *[text(F.col(c).cast("string")).alias(n) for n, c in {**on_feed, **key}.items()], *[blank.alias(n) for n in only])
        url = K.row_urls(rows, True, "_key", scan.pattern) if key else F.lit(None).cast("string")
    else:
        only = {n: c for n, c in on_feed.items() if n not in on_page}
        link = {"_link": scan.column} if scan.column else {}
        page = visible_rows(scan.page, [*on_page.values()])
        if scan.feed is not None and scan.page_anchor and (only or key):
            aligned = M.align_rows(page, scan.feed, scan.page_anchor, scan.feed_anchor)
            rows = M.page_rows(page, scan.feed, aligned, {**on_page, **link}, {**only, **key})
        else:
            key, rows = {}, page.select("_ord", *[text(c).alias(n) for n, c in {**on_page, **link}.items()], *[blank.alias(n) for n in only])
        url = K.row_urls(rows, False, "_key" if key else None, scan.pattern, "_link" if link else None) if key or link else F.lit(None).cast("string")
    return rows.select("_ord", url.alias("_url"), *[c.name for c in wanted])


def item_cells(pages: DataFrame, choices: list[Choice]) -> DataFrame | None:
    """(_url, a column for each chosen single field, _entries: the cells of each entry of the chosen list) of captured item pages (_url, html); None if no item field is chosen, and then no page is parsed."""
    single, entries = [c for c in choices if c.on and c.item], [c for c in choices if c.on and c.entry]
    if not single and not entries:
        return None
    numbered = written(pages.select("_url", "html").dropDuplicates(["_url"]).withColumn("page_id", F.monotonically_increasing_id()), "items")
    nodes, out = H.elements(numbered.withColumn("url", F.col("_url"))), numbered.select("page_id", "_url")
    if single:
        found = K.single_fields(nodes).where(F.col("name").isin([c.item for c in single]))
        cells = found.groupBy("page_id").agg(*[F.min_by("value", F.when(F.col("name") == c.item, F.struct("kind", "value"))).alias(c.name) for c in single])
        out = out.join(cells, "page_id", "left")
    if entries:
        spec = pages.sparkSession.createDataFrame([(c.entry[0], *c.entry, c.name) for c in entries], "list_id string, sig string, path string, attr string, field string")
        cells = K.extract(H.list_leaves(nodes, least=1), spec)
        rows = cells.groupBy("page_id", "list_id", "item_ord").agg(*[F.max(F.when(F.col("field") == c.name, F.col("value"))).alias(c.name) for c in entries])
        each = F.array_sort(F.collect_list(F.struct("list_id", "item_ord", *[c.name for c in entries])))  # of one page
        out = out.join(rows.groupBy("page_id").agg(each.alias("_entries")), "page_id", "left")
    return out.drop("page_id")


def final_rows(scan: Scan, choices: list[Choice], item_pages: DataFrame | None = None) -> DataFrame:
    """The finished table: (_ord, _member, the chosen columns in their order). item_pages (url, html): captured pages of items; those of no row aren't parsed, and rows whose page wasn't captured stay, with blank cells."""
    base = base_rows(scan, choices)
    single, entries = [c.name for c in choices if c.on and c.item], [c.name for c in choices if c.on and c.entry]
    items = None
    if item_pages is not None and (single or entries):
        own = base.select("_url").where("_url IS NOT NULL").distinct()
        items = item_cells(item_pages.withColumnRenamed("url", "_url").join(own, "_url", "left_semi"), choices)
    if items is None:
        out = base.withColumns({n: F.lit("") for n in [*single, *entries]}).withColumn("_member", F.lit(0))
    else:
        out = A.assemble(base, items, "_url", single, ("_entries", entries) if entries else None)
        out = out.withColumn("_member", F.coalesce("_member", F.lit(0)) if entries else F.lit(0))
    return out.select("_ord", "_member", *[c.name for c in choices if c.on])


CHOICES = [
    Choice("Name", page="name", feed="c_name"), Choice("Segment", page="segment"), Choice("Nation", feed="c_nationkey"), Choice("Balance", feed="c_acctbal", on=False), Choice("Email", item="Email"),
    Choice("Founded", item="Founded", on=False), Choice("Member", entry=("li.m", ">b", "own")), Choice("Role", entry=("li.m", ">i", "own")),
]


def scanned(spark, sf_dir, scope: str) -> tuple[Scan, DataFrame]:
    """A scan of customers as a feed, the first hundred of them on screen among empty slots; and captured pages of three quarters of them."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    page = c.where("c_custkey <= 100").select(k.alias("_ord"), F.when(k % 10 > 0, F.upper("c_name")).alias("name"), F.when(k % 10 > 0, F.col("c_mktsegment")).alias("segment"), F.concat(F.lit("https://x.example.org/c/"), k).alias("href"))
    team = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda j: j <= k % 3), lambda j: F.concat(F.lit('<li class="m"><b>Member '), j, F.lit(" of "), k, F.lit("</b><i>Role "), j, F.lit("</i></li>"))), "")
    html = F.concat(F.lit("<body><h1>"), "c_name", F.lit("</h1><dl><dt>Founded</dt><dd>1999</dd></dl><a href='mailto:c"), k, F.lit("@x.org'>Mail</a><ul>"), team, F.lit("</ul></body>"))
    pages = c.where("c_custkey % 4 > 0").select(F.concat(F.lit("https://x.example.org/c/"), k).alias("url"), html.alias("html"))
    folder = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    pages.write.parquet(folder)
    feed = c.withColumn("_ord", k)
    return Scan(scope, page, feed, page.withColumn("__url", F.col("href")), "name", "c_name", "c_custkey", "https://x.example.org/c/{v}", "href"), spark.read.schema(pages.schema).parquet(folder)


_ROWS = """SELECT c_custkey AS _ord, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 > 0 THEN j - 1 ELSE 0 END::INTEGER AS _member, {name} AS "Name", {segment} AS "Segment", {nation} AS "Nation", CASE WHEN c_custkey % 4 > 0 THEN 'c' || c_custkey || '@x.org' ELSE '' END AS "Email",
       CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 > 0 THEN 'Member ' || j || ' of ' || c_custkey ELSE '' END AS "Member", CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 > 0 THEN 'Role ' || j ELSE '' END AS "Role"
       FROM customer, range(1, 3) t(j) WHERE j <= greatest(1, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3 ELSE 1 END) AND {where}"""
_SHOWN = "c_custkey <= 100 AND c_custkey % 10 > 0"


def finished_feed(spark, sf_dir) -> DataFrame:
    scan, pages = scanned(spark, sf_dir, "feed")
    return final_rows(scan, CHOICES, pages)


def finished_page(spark, sf_dir) -> DataFrame:
    scan, pages = scanned(spark, sf_dir, "page")
    return final_rows(scan, CHOICES, pages)


def finished_crawl(spark, sf_dir) -> DataFrame:
    scan, pages = scanned(spark, sf_dir, "crawl")
    return final_rows(scan, CHOICES, pages)


QUERIES.update(finished_feed=finished_feed, finished_page=finished_page, finished_crawl=finished_crawl)
ORACLE.update(
    finished_feed=_ROWS.format(name="c_name", segment=f"CASE WHEN {_SHOWN} THEN c_mktsegment ELSE '' END", nation="c_nationkey::VARCHAR", where="true"),
    finished_page=_ROWS.format(name="upper(c_name)", segment="c_mktsegment", nation="c_nationkey::VARCHAR", where=_SHOWN),
    finished_crawl=_ROWS.format(name=f"CASE WHEN {_SHOWN} THEN upper(c_name) ELSE '' END", segment=f"CASE WHEN {_SHOWN} THEN c_mktsegment ELSE '' END", nation="''", where="c_custkey <= 100"),
)
