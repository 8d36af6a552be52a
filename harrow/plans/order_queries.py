"""Ordered rows, JSON records and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.functions.text import unfinished
from harrow.operators import company as C
from harrow.operators import ordering as O
from harrow.operators import pages as H
from harrow.operators import profiling as P
from harrow.session import spread, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT min(l_orderkey) AS l_orderkey, l_partkey, l_linenumber FROM lineitem GROUP BY l_partkey, l_linenumber")
def distinct_rows_across_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return O.distinct_rows(rows, ["l_partkey", "l_linenumber"], ["l_orderkey"])


_FRESH = "f AS (SELECT l_returnflag, page, count(*) AS n FROM (SELECT l_returnflag, l_partkey, l_linenumber, min(l_orderkey // 100) AS page FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2), p AS (SELECT q.*, coalesce(n, 0) AS fresh FROM (SELECT DISTINCT l_returnflag, l_orderkey // 100 AS page FROM lineitem) q LEFT JOIN f USING (l_returnflag, page))"


@query(f"WITH {_FRESH}, s AS (SELECT l_returnflag, page, fresh = 0 AND lag(fresh) OVER (PARTITION BY l_returnflag ORDER BY page) = 0 AS stale, fresh FROM p) SELECT l_returnflag, page, fresh FROM s WHERE page <= coalesce((SELECT min(page) FROM s x WHERE x.stale AND x.l_returnflag = s.l_returnflag), 1000000000)")
def fresh_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr("l_orderkey div 100").alias("page"), "l_partkey", "l_linenumber")
    return O.until_stale(O.fresh_by_page(rows, ["l_partkey", "l_linenumber"], by=["l_returnflag"]), ["l_returnflag"])


@query(
    """WITH r AS (SELECT l_suppkey, l_partkey // 100 AS page, row_number() OVER (PARTITION BY l_suppkey, l_partkey // 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r, l_returnflag, l_linestatus FROM lineitem),
       p AS (SELECT l_suppkey, page, string_agg(l_returnflag || '|' || l_linestatus, '||' ORDER BY r) AS print FROM r WHERE r <= 3 GROUP BY 1, 2)
       SELECT l_suppkey, page, print, coalesce(print = lag(print) OVER (PARTITION BY l_suppkey ORDER BY page), false) AS unchanged FROM p"""
)
def unchanged_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"page": F.expr("l_partkey div 100"), "pos": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")})
    return O.unchanged_pages(rows, ["l_returnflag", "l_linestatus"], ["l_suppkey"])


@query(
    """WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, (o_orderkey % 11)::BIGINT AS rows, CASE WHEN o_orderkey % 4 = 0 THEN 40 END AS total FROM orders),
       t AS (SELECT *, first_value(total IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY page ROWS UNBOUNDED PRECEDING) AS stated FROM p),
       d AS (SELECT *, rows = 0 OR rows < 5 OR coalesce(5 * (page + 1) >= stated, false) OR page + 1 >= 2000 AS done FROM t)
       SELECT o_custkey, page::BIGINT AS page, rows, done FROM d WHERE page <= coalesce((SELECT min(page) FROM d e WHERE e.o_custkey = d.o_custkey AND e.done), 1000000)"""
)
def stop_rule(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pages = table(spark, sf_dir, "orders").select("o_custkey", number.cast("long").alias("page"), (k % 11).alias("rows"), F.when(k % 4 == 0, 40).alias("total"), F.lit(None).cast("long").alias("cap"))
    return O.stop_rule(pages, ["o_custkey"], F.lit(5)).select("o_custkey", "page", "rows", "done")


@query("WITH n AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS spot, count(*) OVER () AS n FROM lineitem) SELECT l_orderkey FROM n WHERE spot IN (SELECT floor(i * (n - 1) / 39.0 + 0.5) FROM range(40) t(i))")
def spread_sample(spark, sf_dir):
    return O.spread(table(spark, sf_dir, "lineitem").select("l_orderkey"), 40, "l_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 7")
def capped_rows(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(number / 3).alias("page"))  # pages of three rows: the third is cut
    return O.capped_rows(rows, ["o_custkey"], "page", "o_orderkey", 7).select("o_custkey", "o_orderkey")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 80")
def feed_sample(spark, sf_dir):
    return O.first_rows(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 80, ["event_id"])


@query(
    """WITH e AS (SELECT event_type, event_id // 100 AS page, user_id AS row, row_number() OVER (PARTITION BY event_type, event_id // 100 ORDER BY event_id) - 1 AS pos FROM events),
       o AS (SELECT event_type, row, min(page * 1000 + pos) AS spot FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY spot) AS r FROM o)
       SELECT event_type, row, spot // 1000 AS page FROM r WHERE r <= 240"""
)
def fold_dataset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.expr("event_id div 100").alias("page"), "event_id", "user_id")
    captures = e.groupBy("event_type", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "user_id"))), lambda x: x["user_id"]).alias("rows"))
    return O.fold_pages(captures, ["event_type"], "rows", "page").select("event_type", "row", "page")


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, sha256(coalesce(last_value(CASE WHEN length(line) < 30 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '-')) AS heading FROM l")
def heading_before(spark, sf_dir):
    lines = O.heading_before(_lines(spark, sf_dir), ["doc_id"], "line_no", F.length("line") < 30, "line")
    return lines.select("doc_id", "line_no", F.sha2(F.coalesce("heading", F.lit("-")), 256).alias("heading"))


@query(
    f"""WITH {_LINES}, c AS (SELECT *, sha256(coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), '')) AS context FROM l) SELECT doc_id, line_no::INTEGER AS line_no, context FROM c"""
)
def near_context(spark, sf_dir):
    lines = O.with_context(_lines(spark, sf_dir), ["doc_id"], "line_no", "line")
    return lines.select("doc_id", "line_no", F.sha2("context", 256).alias("context"))


@query(
    f"""WITH {_LINES}, n AS (SELECT *, CASE WHEN length(lead(line, 1) OVER w) >= 30 THEN lead(line, 1) OVER w WHEN length(lead(line, 2) OVER w) >= 30 THEN lead(line, 2) OVER w WHEN length(lead(line, 3) OVER w) >= 30 THEN lead(line, 3) OVER w END AS v FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
        SELECT doc_id, line_no::INTEGER AS line_no, line AS label, sha256(v) AS value FROM n WHERE length(line) BETWEEN 1 AND 15 AND v IS NOT NULL"""
)
def label_next(spark, sf_dir):
    found = O.label_next(_lines(spark, sf_dir), ["doc_id"], "line_no", F.length("line").between(1, 15), F.length("line") >= 30, "line")
    return found.select("doc_id", "line_no", "label", F.sha2("value", 256).alias("value"))


@query("SELECT o_orderpriority AS feed, count(*) AS size FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1")
def best_feed(spark, sf_dir):
    feeds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feed")).agg(F.count("*").alias("size")).withColumns({"paginated": F.lit(True), "_ord": F.col("feed")})
    return O.best_feed(feeds).select("feed", "size")


@query("WITH s AS (SELECT length(html) AS n FROM pages) SELECT list_sort(list(n))[(count(*) // 2 + 1)::INTEGER] AS median FROM s")
def upper_median(spark, sf_dir):
    return O.upper_median(table(spark, sf_dir, "pages").select(F.length("html").cast("long").alias("n")), "n")


@query(
    """WITH c AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS looked, max(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS people, max(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS website, max(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS needs, count(*) AS n FROM orders GROUP BY 1)
       SELECT sum(n)::BIGINT AS rows, count(*) AS companies, sum(looked)::BIGINT AS looked, sum(people)::BIGINT AS people, sum(website)::BIGINT AS website, sum(needs)::BIGINT AS needs FROM c"""
)
def job_stats(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("company"), (F.col("o_orderstatus") == "F").alias("looked"), (F.col("o_totalprice") > 100000).alias("people"), (k % 2 == 0).alias("website"), (k % 7 == 0).alias("needs"))
    return O.job_stats(rows, "company", "looked", "people", "website", "needs")


@query(
    """WITH a AS (SELECT l_orderkey AS o_orderkey, count(*) AS attempts FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(attempts, 0) AS attempts, coalesce(attempts, 0) >= 3 AS given_up FROM orders LEFT JOIN a USING (o_orderkey) WHERE o_orderstatus <> 'F'"""
)
def pending_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    attempts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("attempts"))
    left, given_up = O.pending(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), attempts, "o_orderkey")
    return left.withColumn("given_up", F.lit(False)).union(given_up.withColumn("given_up", F.lit(True)))


def _captures(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("line"))
    orders = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    body = F.struct(F.struct(F.size("lines").alias("total"), F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("no"), F.struct(x["l_partkey"].alias("id"), F.array(x["l_suppkey"], x["l_linenumber"]).alias("from")).alias("part"))).alias("list")).alias("data"))
    return orders.select("id", F.to_json(body).alias("payload"))


@query("SELECT l_orderkey AS id, 'data.list' AS path, count(*)::INTEGER AS size, count(*) AS total FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def record_sets(spark, sf_dir):
    return R.find_record_sets(_captures(spark, sf_dir)).select("id", "path", "size", "total")


@query(
    """WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row, count(*) OVER (PARTITION BY l_orderkey) AS n, * FROM lineitem), k AS (SELECT * FROM l WHERE n >= 2)
       SELECT id, row::INTEGER AS row, 'no' AS key, l_linenumber::VARCHAR AS value FROM k UNION ALL SELECT id, row::INTEGER, 'part.id', l_partkey::VARCHAR FROM k UNION ALL SELECT id, row::INTEGER, 'part.from', l_suppkey || ', ' || l_linenumber FROM k"""
)
def flatten_rows(spark, sf_dir):
    return R.record_cells(_captures(spark, sf_dir)).select("id", "row", "key", "value")


@query("SELECT page_id, CASE WHEN url LIKE '%page=%' THEN 'query_page' END AS style, CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([0-9]+)', 1)::BIGINT END AS first FROM pages")
def detect_paging(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", R.detect_paging(F.col("url"), F.lit(None).cast("string")).alias("p"))
    return p.select("page_id", "p.style", "p.first")


@query("SELECT page_id, i::INTEGER AS page_index, regexp_replace(url, '([?&]page=)[0-9]+', '\\1' || (regexp_extract(url, 'page=([0-9]+)', 1)::BIGINT + i)) AS page_url FROM pages, range(5) t(i) WHERE url LIKE '%page=%'")
def page_requests(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url LIKE '%page=%'").select("page_id", "url", R.detect_paging(F.col("url"), F.lit(None).cast("string")).alias("paging"))
    return R.page_requests(p, 5).select("page_id", "page_index", "page_url")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href FROM pages""")
def nav_list_items(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1))).alias("href"))
    return p


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS h FROM pages),
        u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS s FROM t)
        SELECT page_id, sha256(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS h FROM u"""
)
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(H.page_text("html"), 256).alias("h"))


@query(r"""SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS h1, (len(html) - len(replace(html, '<script', ''))) // 7 > 0 AS had_script, false AS has_script FROM pages""")
def sanitize_html(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("clean", H.inert("html"))
    return p.select("page_id", F.regexp_extract("clean", "<h1>([^<]*)", 1).alias("h1"), F.col("html").contains("<script").alias("had_script"), F.col("clean").rlike("(?i)<script").alias("has_script"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>|<iframe\b[^>]*>.*?</iframe\s*>|<object\b[^>]*>.*?</object\s*>|<embed\b[^>]*>.*?</embed\s*>|<svg\b[^>]*>.*?</svg\s*>', '', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g') AS h FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>|<aside\b[^>]*>.*?</aside\s*>', chr(10), 'g'), '(?i)</?(p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|br|dt|dd|address|header|footer|main|aside|nav|blockquote|figcaption)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS s FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS s FROM b),
        l AS (SELECT page_id, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM c)
        SELECT page_id, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_no, unnest(ls) AS line FROM l"""
)
def page_lines(spark, sf_dir):
    return C.lines_of(table(spark, sf_dir, "pages"), content_only=True).select("page_id", "line_no", "line")


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '\sclass=["'']([^"'']{1,60})["'']', 1)) AS c FROM pages), d AS (SELECT page_id, 'c:' || unnest(string_split(c, ' ')) AS feature FROM c) SELECT page_id, feature, count(*) AS n FROM d GROUP BY ALL""")
def page_features(spark, sf_dir):
    return H.page_features(table(spark, sf_dir, "pages")).where("feature LIKE 'c:%'")


_TARGET = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>')) AS a FROM pages), h AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a)"""


@query(f"WITH {_TARGET} SELECT page_id, href, label FROM h WHERE href <> ''")
def page_anchors(spark, sf_dir):
    return H.anchors(table(spark, sf_dir, "pages")).select("page_id", "href", "label")


_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*')"


@query(f"SELECT page_id, {_ORIGIN} || '/impressum' AS target, 1 AS kind FROM pages UNION ALL SELECT page_id, {_ORIGIN} || '/team', 2 FROM pages")
def company_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<a href="/kontakt.pdf">Kontakt</a><a href="/team/">Team</a><a href="impressum"></a><a href="/impressum">Impressum</a>'), "html"))
    return H.company_pages(H.anchors(p.withColumn("url", F.regexp_extract("url", "^https?://[^/?#]*", 0))))


@query(f"SELECT page_id, {_ORIGIN} || '/exhibitors' AS target, 'View exhibitor list' AS label FROM pages")
def directory_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<a href="/de/x">Deutsch</a><a href="/exhibitors">View <b>exhibitor</b> list</a>'), "html"))
    return H.directory_links(H.anchors(p))


@query(r"""WITH n AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items FROM pages) SELECT page_id, 'nav' AS kind, items FROM n WHERE items >= 3""")
def list_detection(spark, sf_dir):
    nodes = H.elements(table(spark, sf_dir, "pages"))
    lists = H.sibling_lists(nodes).where("sig = 'li'")
    return lists.select("page_id", F.when(F.col("chrome"), "nav").otherwise("list").alias("kind"), "items")


@query(r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS v FROM pages), c AS (SELECT page_id, count(*) AS hits FROM n WHERE regexp_matches(v, '[\p{L}\p{N}]') GROUP BY 1 HAVING count(*) >= 3) SELECT page_id, '>a' AS path, 'own' AS attr, hits FROM c""")
def list_columns(spark, sf_dir):
    leaves = H.list_leaves(H.elements(table(spark, sf_dir, "pages")))
    return H.list_columns(leaves).where("sig = 'li' AND attr = 'own'").select("page_id", "path", "attr", "hits")


@query()
def best_lists(spark, sf_dir):
    nodes = H.listed(H.elements(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")))
    return H.best_lists(H.list_candidates(nodes), H.list_columns(H.list_leaves(nodes)))


@query(
    r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS v FROM pages), s AS (SELECT page_id, count(*) AS entries, avg(length(trim(v))) AS a, max(length(trim(v))) AS m FROM n WHERE trim(v) <> '' GROUP BY 1) SELECT page_id, entries, a <= 18 AND m <= 55 AS navigation FROM s"""
)
def nav_test(spark, sf_dir):
    values = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("value"))
    return P.navigation_lists(values, ["page_id"]).select("page_id", "entries", "navigation")


@query(
    """SELECT c_custkey AS page_id, 'Anna Meier' AS name, CASE c_custkey % 2 WHEN 0 THEN 'ceo' ELSE 'owner' END AS role, CASE WHEN c_custkey % 3 > 0 THEN 'anna.meier' || c_custkey || '@example.org' END AS email FROM customer WHERE c_custkey % 5 > 0
       UNION ALL SELECT c_custkey, 'Bernd Schulz', 'md', CASE WHEN c_custkey % 3 = 1 THEN 'b.schulz@example.org' END FROM customer WHERE c_custkey % 4 = 0"""
)
def facts(spark, sf_dir):
    k = F.col("c_custkey")
    title = F.when(k % 2 == 0, "CEO").otherwise("Founder")
    mail = F.when(k % 3 > 0, F.concat(F.lit("<p>anna.meier"), k, F.lit("@example.org</p>"))).otherwise("")
    anna = F.when(k % 5 > 0, F.concat(F.lit("<p>"), title, F.lit(": Anna Meier</p>"), mail)).otherwise("<p>Frankfurter Buchmesse</p><p>CEO</p>")
    more = F.when(k % 4 == 0, F.concat(F.lit("<p>a</p><p>b</p><p>c</p><p>Bernd Schulz</p><p>Managing Director</p>"), F.when(k % 3 == 1, F.lit('<p><a href="mailto:b.schulz@example.org">Mail</a></p>')).otherwise(""))).otherwise("<p>Dr. Product Manager</p>")
    html = F.concat(F.lit("<html><body><nav>Home</nav>"), anna, more, F.lit("<p>x</p><p>y</p><p>info@example.org</p></body></html>"))
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")  # a small file is one task, its pages are much work
    pages = customers.select(k.alias("page_id"), F.lit("https://x.example.org/").alias("url"), html.alias("html"))
    return C.facts(pages).select("page_id", "name", "role", "email")


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://' || 'brand' || s_suppkey || '.com' END AS website, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'info@brand' || s_suppkey || '.com' END AS company_email, CASE WHEN s_suppkey % 3 > 0 THEN 'Anna Meier' END AS person, CASE WHEN s_suppkey % 3 > 0 THEN 'medium' END AS confidence, CASE WHEN s_suppkey % 3 = 0 THEN 'website,people' ELSE '' END AS needs FROM supplier"
)
def lookup_companies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Brand"), "s_suppkey")
    companies = s.select(F.col("s_suppkey").alias("id"), F.concat(name, F.lit(" GmbH")).alias("name"), F.lit(None).cast("string").alias("website"))
    html = F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body><p>Managing Director: Anna Meier</p><p>info@brand"), "s_suppkey", F.lit(".com</p></body></html>"))
    host = F.when(F.col("s_suppkey") % 3 == 0, "shop").otherwise("brand")  # a third have their page elsewhere, where nobody looks
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://"), host, "s_suppkey", F.lit(".com/imprint")).alias("url"), html.alias("html"))
    first = F.get("people", 0)
    return C.lookup_companies(companies, pages).select("id", "website", "company_email", first["name"].alias("person"), first["confidence"].alias("confidence"), F.array_join("needs", ",").alias("needs"))


FAIR = "fair.example.org"


@query(
    """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k FROM supplier)
       SELECT id, CASE k WHEN 0 THEN 'https://brand' || id || '.com' WHEN 1 THEN 'https://brand' || id || '.org' WHEN 2 THEN 'https://brand' || id || '.de' WHEN 3 THEN 'http://brand' || id || '.net' END AS website,
              CASE k WHEN 0 THEN 'listing' WHEN 1 THEN 'exhibitor-page' WHEN 2 THEN 'domain-check' WHEN 3 THEN 'listing' END AS website_source,
              CASE k WHEN 0 THEN 'Bernd Schulz' WHEN 1 THEN 'Anna Meier' WHEN 2 THEN 'Clara Vogel' WHEN 4 THEN 'Anna Meier' END AS person, CASE k WHEN 0 THEN 'company-site' WHEN 1 THEN 'exhibitor-page' WHEN 2 THEN 'company-site' WHEN 4 THEN 'exhibitor-page' END AS source_kind,
              CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 4 THEN 'medium' END AS confidence, CASE k WHEN 0 THEN 'office@brand' || id || '.com' WHEN 1 THEN 'info@brand' || id || '.org' END AS company_email,
              CASE WHEN k IN (1, 4) THEN 'https://www.linkedin.com/company/b' || id END AS company_linkedin, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_pages, CASE k WHEN 3 THEN 'people' WHEN 4 THEN 'website' WHEN 5 THEN 'website,people' ELSE '' END AS needs FROM s"""
)
def lookup_stages(spark, sf_dir):
    """Sixths of the suppliers: a listed site whose imprint names somebody; a site named on the profile page; one found by its name, whose legal page no link leads to; a listed one that wasn't captured; people on the profile page only; nothing."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 6
    name, host = F.concat(F.lit("Brand"), k), F.concat(F.lit("brand"), k)
    s = table(spark, sf_dir, "supplier")
    listed = F.when(n == 0, F.concat(F.lit("www."), host, F.lit(".com/"))).when(n == 3, F.concat(F.lit("http://"), host, F.lit(".net")))
    companies = s.select(k.alias("id"), F.concat(name, F.lit(" GmbH")).alias("name"), listed.alias("website"), F.when(n.isin(1, 4), F.concat(F.lit(f"https://{FAIR}/exhibitor/"), k)).alias("profile_url"))
    page = lambda url, *body: F.struct(F.concat(*url).alias("url"), F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body>"), *body, F.lit("</body></html>")).alias("html"))
    lit = F.lit
    linked = F.concat(lit("<a href='https://www.linkedin.com/company/b"), k, lit("'>LinkedIn</a>"))
    profile = page([lit(f"https://{FAIR}/exhibitor/"), k], lit(f"<p>Managing Director: Anna Meier</p><p>info@{FAIR}</p>"), linked, F.when(n == 1, F.concat(lit("<a href='https://"), host, lit(".org/'>Website</a>"))).otherwise(""))
    cases = F.when(n == 0, F.array(
        page([lit("https://"), host, lit(".com/")], lit(f"<p>info@{FAIR}</p><a href='/news'>News</a><a href='/contact'>Contact</a><a href='/imprint'>Imprint</a>")),
        page([lit("https://"), host, lit(".com/contact")], lit("<p>Phone</p><p>office@"), host, lit(".com</p>")),
        page([lit("https://"), host, lit(".com/imprint")], lit("<p>Managing Director: Bernd Schulz</p>")),
        page([lit("https://"), host, lit(".com/news")], lit("<p>Founder: Never Read</p>")),
    )).when(n == 1, F.array(profile, page([lit("https://"), host, lit(".org")], lit("<p>info@"), host, lit(".org</p>")))).when(n == 2, F.array(
        page([lit("https://"), host, lit(".de/")], lit("<h1>"), name, lit("</h1><p>Welcome</p>")),
        page([lit("https://"), host, lit(".de/impressum")], lit("<p>Founder: Clara Vogel</p>")),
    )).when(n == 4, F.array(profile)).when(n == 5, F.array(page([lit("https://shop"), k, lit(".com/")], lit("<p>Founder: Some Body</p>"))))
    pages = s.select(k, F.posexplode(cases).alias("_i", "x")).select((k * 10 + F.col("_i")).alias("page_id"), "x.url", "x.html")
    first = F.get("people", 0)
    out = C.lookup_companies(companies, pages, fair_host=FAIR)
    return out.select("id", "website", "website_source", first["name"].alias("person"), first["source_kind"].alias("source_kind"), first["confidence"].alias("confidence"), "company_email", "company_linkedin", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.array_join("needs", ",").alias("needs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CASE c_custkey % 3 WHEN 1 THEN 'Anna Meier' ELSE 'Jean-Luc de la Tour' END END AS name FROM customer")
def name_tests(spark, sf_dir):
    """Real names beside ones with a word of pages or firms: every word of the list takes its turn."""
    k = F.col("c_custkey")
    words = [w for w in (*C.NOT_NAMES, "Verlag", "Leiterin", "Einkaufsleiter", "Verlegerin", "Handelsregister", "am", "und") if len(w) > 1]
    word = F.initcap(F.element_at(F.array(*map(F.lit, words)), (F.floor(k / 3) % len(words) + 1).cast("int")))
    said = F.when(k % 3 == 1, "  Anna Meier,").when(k % 3 == 2, "von Jean-Luc de la Tour").otherwise(F.concat(F.lit("Anna "), word))
    return table(spark, sf_dir, "customer").select("c_custkey", C.as_name(said).alias("name"))


@query("SELECT doc_id AS page_id, 0 AS line_no, 'Anna Meier' AS name, 'owner' AS role, 'Founder' AS role_raw, 'high' AS confidence FROM documents")
def people_in_documents(spark, sf_dir):
    said = F.concat(F.lit("Founder: Anna Meier\n"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.posexplode(F.split(said, "\n")).alias("line_no", "line"))
    return C.people_in(d).select("page_id", "line_no", "name", "role", "role_raw", "confidence")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND length(trim(left(p_name, 8))) >= 3 THEN trim(left(p_name, 8)) END AS prefix FROM part")
def cut_cells(spark, sf_dir):
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 1, 8), F.lit("…"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", unfinished(shown).alias("prefix"))
