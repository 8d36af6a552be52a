"""Item pages over the tables: pages are composed from rows, so that their parts, and parts that are missing, vary with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators import catalog as K
from harrow.operators import items as I
from harrow.operators import pages as H
from harrow.session import spread, table, written

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _composed(df: DataFrame, id: str, *parts) -> DataFrame:
    """A page a row, composed of texts and Columns. The rows are spread first, so that pages are composed and parsed in many tasks."""
    df = spread(df, id)
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return df.select(F.col(id).cast("long").alias("page_id"), F.concat(F.lit("https://x.example.org/item/"), F.col(id).cast("string")).alias("url"), html.alias("html"))


def _page(df: DataFrame, id: str, *parts) -> DataFrame:
    """The elements of such pages."""
    return H.elements(_composed(df, id, *parts))


def _times(html: str, n) -> F.Column:
    return F.repeat(F.lit(html), n.cast("int"))


@query("SELECT p_partkey AS page_id, unnest([CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN p_name WHEN 2 THEN p_name || ' label' ELSE 'Other ' || p_name END, 'Second ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' in full' ELSE '' END]) AS value FROM part")
def expanded_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    tag = F.when(k % 4 == 0, F.concat(F.lit('<div title="'), name, F.lit(' and more"><b>'), name, F.lit("…</b></div>"))).when(k % 4 == 1, F.concat(F.lit('<b title="'), F.substring(name, 1, 3), F.lit('">'), name, F.lit("</b>")))
    tag = tag.when(k % 4 == 2, F.concat(F.lit('<b aria-label="'), name, F.lit(' label">'), name, F.lit("...</b>"))).otherwise(F.concat(F.lit('<b title="'), name, F.lit(' x" aria-label="y">Other '), name, F.lit("</b>")))
    second = F.when(k % 2 == 0, F.concat(F.lit('<p data-full-text="Second '), k, F.lit(' in full">Second '), k, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>Second "), k, F.lit("</p>")))
    return I.expanded_texts(_page(p, "p_partkey", "<body>", tag, second, "</body>")).select("page_id", "value")


_CARDS = "c AS (SELECT c_custkey AS page_id, c_custkey % 4 AS n FROM customer)"


def _cards(spark, sf_dir) -> DataFrame:
    card = '<div data-testid="teamMember"><b>Anna</b><i>CEO</i></div>'
    n = F.col("c_custkey") % 4
    section = F.concat(F.lit('<section data-testid="teamPanel"><h2>Team</h2><p>All</p>'), _times(card, n), F.lit("</section>"))
    lone = F.when(n == 2, F.lit('<div itemscope itemtype="https://schema.org/Offer"><b>9 EUR</b><i>now</i></div>')).otherwise("")
    return _page(table(spark, sf_dir, "customer"), "c_custkey", '<body><nav data-testid="x"><b>a</b><b>b</b></nav><div data-testid="title"><b>Only one</b></div>', section, lone, '<div data-testid="site-footer"><b>a</b><b>b</b></div></body>')


@query(
    f"""WITH {_CARDS} SELECT page_id, '[data-testid="teamMember"]' AS label, n AS cards FROM c WHERE n > 0 UNION ALL SELECT page_id, '[data-testid="teamPanel"]', 1 FROM c WHERE n = 0 UNION ALL SELECT page_id, '[itemtype="https://schema.org/Offer"]', 1 FROM c WHERE n = 2"""
)
def labelled_cards(spark, sf_dir):
    return I.labelled_cards(_cards(spark, sf_dir)).groupBy("page_id", "label").agg(F.count("*").alias("cards"))


def _orders_table(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    k = F.col("l_orderkey")
    head = F.when(k % 3 == 0, F.lit("<thead><tr><th>No</th><th><b>Part</b> key</th></tr></thead>")).when(k % 3 == 1, F.lit("<tr><td>Nr</td><td>Teil</td></tr>")).otherwise("<tr><th></th><td></td></tr>")
    return _composed(lines, "l_orderkey", "<body><table>", head, _times("<tr><td>1</td><td>x</td></tr>", F.col("n")), "</table></body>")


@query(
    """WITH n AS (SELECT l_orderkey AS page_id, count(*) AS rows FROM lineitem GROUP BY 1), h AS (SELECT page_id, rows, unnest(CASE WHEN page_id % 3 = 0 THEN ['No', 'Part key'] ELSE ['Nr', 'Teil'] END) AS header, unnest([0, 1]) AS cell FROM n WHERE page_id % 3 < 2) SELECT page_id, cell, header, rows FROM h"""
)
def table_headers(spark, sf_dir):
    return I.headers_of(H.table_parts(_orders_table(spark, sf_dir))).groupBy("page_id", "cell", "header").agg(F.count("*").alias("rows"))


def _item_page(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    facts = F.concat(F.lit("<table><tr><th>Code</th><td>A"), k, F.lit("</td></tr><tr><th>Size</th><td>B"), k, F.lit("</td></tr>"), F.when(k % 2 == 0, F.lit("<tr><th>Code</th><td>again</td></tr>")).otherwise(F.concat(F.lit("<tr><th>Colour</th><td>C"), k, F.lit("</td></tr>"))), F.lit("</table>"))
    n = k % 3 + 1
    team = F.concat(F.lit("<div>"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('<p data-testid="person"><b>Name '), i.cast("string"), F.lit("</b><i>Role "), i.cast("string"), F.lit("</i></p>"))), ""), F.lit("</div>"))
    return _page(table(spark, sf_dir, "customer"), "c_custkey", "<body><h1>Item ", k, "</h1>", facts, team, "</body>")


@query(
    """SELECT c_custkey AS page_id, 'single' AS kind, 'Name' AS name, 1 AS entries FROM customer
       UNION ALL SELECT c_custkey, 'list', 'tr', 3 FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT c_custkey, 'single', unnest(['Code', 'Size', 'Colour']), 1 FROM customer WHERE c_custkey % 2 = 1
       UNION ALL SELECT c_custkey, 'card', '[data-testid="person"]', c_custkey % 3 + 1 FROM customer WHERE c_custkey % 3 < 2
       UNION ALL SELECT c_custkey, 'list', 'p[person]', 3 FROM customer WHERE c_custkey % 3 = 2"""
)
def item_pages(spark, sf_dir):
    return I.item_page(_item_page(spark, sf_dir))


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 5 < 3 THEN 'li' || CASE WHEN c_custkey % 5 = 2 THEN '' ELSE '' END ELSE 'li' END AS sig, greatest(c_custkey % 5, 2) AS items FROM customer WHERE c_custkey % 5 >= 2 UNION ALL SELECT c_custkey, 'i', 2 FROM customer WHERE c_custkey % 5 = 1")
def repeating_ancestors(spark, sf_dir):
    nodes = _page(table(spark, sf_dir, "customer"), "c_custkey", "<body><ul>", _times("<li><p><i><b>x</b></i><i>y</i></p></li>", F.col("c_custkey") % 5), "</ul></body>")
    nodes = written(nodes.select("page_id", "node", "tag", "sig", "chain", "items"), "nodes")
    first = nodes.where("tag = 'b'").groupBy("page_id").agg(F.min("node").alias("node"))
    found = I.repeating_ancestor(nodes, first)
    return found.join(nodes.select("page_id", F.col("node").alias("item"), "sig"), ["page_id", "item"]).select("page_id", "sig", "items")


@query("SELECT c_custkey AS page_id, 'div' || CASE WHEN c_custkey % 3 = 0 THEN '.team' ELSE '' END AS sig, c_custkey % 3 < 2 AS people FROM customer")
def people_lists(spark, sf_dir):
    k = F.col("c_custkey") % 3
    card = F.when(k == 0, F.lit('<div class="team"><b>A</b></div>')).when(k == 1, F.lit('<div><p><b data-styleid="speaker-name">A</b></p></div>')).otherwise("<div><b>A</b></div>")
    nodes = _page(table(spark, sf_dir, "customer"), "c_custkey", "<body>", card, card, card, "</body>")
    nodes = written(nodes.select("page_id", "node", "parent", "last", "sig", "items", "chrome", "hint"), "nodes")
    return I.people_lists(nodes, H.sibling_lists(nodes)).select("page_id", "sig", "people")


_TRIES = """t AS (SELECT l_orderkey AS url, l_linenumber - 1 AS attempt, max(CASE l_suppkey % 5 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 404 ELSE 200 END) AS status, max(l_partkey) AS page_id FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
       f AS (SELECT url, min(attempt) FILTER (WHERE status NOT IN (503, 429)) AS at, max(attempt) AS last FROM t GROUP BY 1),
       r AS (SELECT f.url, coalesce(x.status, y.status) AS status, x.page_id FROM f LEFT JOIN t x ON x.url = f.url AND x.attempt = f.at JOIN t y ON y.url = f.url AND y.attempt = f.last)"""


def _tries(spark, sf_dir) -> DataFrame:
    k = F.col("l_suppkey") % 5
    status = F.when(k == 0, 503).when(k == 1, 429).when(k == 2, 404).otherwise(200)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("url"), (F.col("l_linenumber") - 1).alias("attempt")).agg(F.max(status).alias("status"), F.max("l_partkey").alias("page_id"))


def _urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"))


@query(
    f"""WITH {_TRIES} SELECT o_orderkey::VARCHAR AS url, coalesce(status < 400, false) AS ok, CASE WHEN status IS NULL THEN 'not captured' WHEN status >= 400 THEN 'HTTP ' || status END AS error, CASE WHEN status < 400 THEN page_id END AS page_id FROM orders LEFT JOIN r ON r.url = o_orderkey"""
)
def read_items(spark, sf_dir):
    return I.read_items(_urls(spark, sf_dir), _tries(spark, sf_dir))


_FIRST = "a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 404 END AS one, CASE WHEN o_orderkey % 3 = 0 THEN 503 ELSE 200 END AS two FROM orders)"


def _two(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.cast("string").alias("url"), k.alias("page_id"), F.lit(0).alias("attempt"), F.when(k % 4 == 0, 200).when(k % 4 == 1, 500).when(k % 4 == 2, 404).alias("one"), F.when(k % 3 == 0, 503).otherwise(200).alias("two"))
    capture = lambda c: o.where(F.col(c).isNotNull()).select("url", "attempt", F.col(c).alias("status"), "page_id")
    return I.two_passes(o.select("url"), capture("one"), capture("two"))


@query(f"WITH {_FIRST} SELECT o_orderkey::VARCHAR AS url, CASE WHEN one = 200 THEN 1 ELSE 2 END AS pass, coalesce(one, 0) = 200 OR two = 200 AS ok FROM a")
def second_pass(spark, sf_dir):
    return _two(spark, sf_dir).select("url", "pass", "ok")


@query(f"WITH {_FIRST} SELECT o_orderkey::VARCHAR AS url, 'HTTP 503' AS error FROM a WHERE coalesce(one, 0) <> 200 AND two <> 200")
def failed_items(spark, sf_dir):
    return I.failed_items(_two(spark, sf_dir))


@query("SELECT 'p_partkey' AS key, 'https://x.example.org/item/{v}?tab=1' AS pattern FROM part WHERE p_partkey = 150")
def pasted_source(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    each = F.array(*[F.struct(F.lit(c).alias("key"), F.lit(i).alias("key_ord"), F.col(c).cast("string").alias("value")) for i, c in enumerate(["p_brand", "p_size", "p_partkey", "p_name"])])
    return I.pasted_source(p.select(F.col("p_partkey").alias("row"), F.explode(each).alias("x")).select("row", "x.*"), "https://x.example.org/item/150?tab=1")


@query(
    r"""WITH n AS (SELECT n_nationkey, translate(lower(n_name), ' _0123456789', '--abcdefghij') AS w FROM nation),
        s AS (SELECT n_nationkey, w, CASE WHEN w LIKE '%ies' THEN left(w, -3) || 'y' WHEN w LIKE '%ses' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS one FROM n),
        l AS (SELECT n_nationkey, CASE WHEN one = w THEN ['exhibitor', 'exhibitors', 'x', w, 'item', 'items', 'detail', 'details'] ELSE ['exhibitor', 'exhibitors', 'x', one, w, 'item', 'items', 'detail'] END AS words FROM s),
        e AS (SELECT n_nationkey, i, words[i] AS word FROM l, range(1, 9) t(i))
        SELECT n_nationkey, (3 * (i - 1) + j)::INTEGER AS _ord, 'https://n' || n_nationkey || '.example.org' || ['', '/en', '/fr'][j + 1] || '/' || word || '/{v}' AS pattern FROM e, range(3) t(j)"""
)
def candidate_patterns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    hints = F.array(F.concat(F.lit("/en/exhibitors/"), "n_nationkey"), F.concat(F.lit("/fr/"), F.translate(F.lower("n_name"), " _0123456789", "--abcdefghij"), F.lit("/x")), F.lit("/api/v2/list"))
    sites = n.select("n_nationkey", F.concat(F.lit("https://n"), "n_nationkey", F.lit(".example.org")).alias("origin"), hints.alias("hints"))
    return I.candidate_patterns(sites).select("n_nationkey", "_ord", "pattern")


@query(
    """SELECT c_custkey AS page_id, unnest(['Name', 'Founded', 'Size', 'Country', 'Email', 'Phone', 'LinkedIn']) AS name, unnest(['Firm ' || c_custkey, '19' || (c_custkey % 90 + 10), 'S' || c_custkey, 'Land ' || c_nationkey, 'c' || c_custkey || '@x.org', '+49 30 ' || (c_custkey + 100000), 'https://de.linkedin.com/company/c' || c_custkey]) AS value FROM customer"""
)
def single_field_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = _page(
        table(spark, sf_dir, "customer"), "c_custkey", "<body><h1>Firm ", k, "</h1><h1>Other</h1><dl><dt>Founded:</dt><dd>19", k % 90 + 10, "</dd><dt>Empty</dt><dd></dd></dl><table><tr><th>Size</th><td>S", k, "</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>",
        "<div><b>Country:</b><i>Land ", F.col("c_nationkey"), '</i></div><a href="mailto:c', k, '@x.org?subject=1">Mail</a><a href="tel:+49 30 ', k + 100000, '">Call</a><a href="https://de.linkedin.com/company/c', k, '">us</a><a href="https://x.example.org/y">own</a><nav><dl><dt>Menu</dt><dd>x</dd></dl></nav></body>',
    )
    return K.single_fields(nodes).select("page_id", "name", "value")


@query(
    """SELECT n_nationkey::BIGINT AS scan, CASE n_nationkey % 5 WHEN 0 THEN 'column' WHEN 1 THEN 'column' WHEN 2 THEN 'field' WHEN 3 THEN 'slug' END AS way, CASE WHEN n_nationkey % 5 < 2 THEN 'c2' END AS column_key,
              CASE n_nationkey % 5 WHEN 0 THEN 'slug' WHEN 2 THEN 'address' WHEN 3 THEN 'slug' END AS key, CASE n_nationkey % 5 WHEN 0 THEN 'https://n' || n_nationkey || '.example.org/firm/{v}?tab=1' WHEN 2 THEN '{v}' WHEN 3 THEN 'https://n' || n_nationkey || '.example.org/en/co/{v}/about' END AS pattern
       FROM nation WHERE n_nationkey % 5 < 4 AND n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 2)"""
)
def item_sources(spark, sf_dir):
    """A scan for each nation, its customers as rows. Fifths: a column of links with its field; one without; a field of addresses; slugs in links of the page; nothing."""
    k, scan, way = F.col("c_custkey"), F.col("c_nationkey").cast("long"), F.col("c_nationkey") % 5
    c = table(spark, sf_dir, "customer")
    origin = F.concat(F.lit("https://n"), scan, F.lit(".example.org"))
    row = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    slug = F.concat(F.lit("firm-"), k)
    rows = c.select(scan.alias("scan"), way.alias("way"), row.alias("row"), slug.alias("slug"), origin.alias("origin"), k.alias("k"))
    each = lambda *cells: F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.lit(i).alias("ord"), F.lit(attr).alias("attr"), value.alias("value")) for i, (key, attr, value) in enumerate(cells)])).alias("x")
    same = F.concat("origin", F.lit("/list"))  # the page itself, in a column of links that lead nowhere else
    link = F.when(F.col("way") == 0, F.concat("origin", F.lit("/firm/"), "slug", F.lit("?tab=1"))).when(F.col("way") == 1, F.concat("origin", F.lit("/x/"), "row")).otherwise(F.concat(F.lit("https://other.net/"), "slug"))
    page = rows.select("scan", "row", each(("c1", "link", same), ("c2", "link", link), ("c3", "own", F.col("slug")))).select("scan", F.col("x.key").alias("col_key"), F.col("x.ord").alias("col_ord"), "row", "x.attr", "x.value")
    address = F.when(F.col("way") == 2, F.concat("origin", F.lit("/p/"), "slug")).when(F.col("row") > 0, F.concat(F.lit("https://other.net/"), "slug"))
    feed = rows.select("scan", "row", each(("country", "", F.lit("Land")), ("address", "", address), ("slug", "", F.when(F.col("way") == 4, F.concat("slug", F.lit(" x"))).otherwise(F.col("slug"))))).select("scan", "x.key", F.col("x.ord").alias("key_ord"), "row", "x.value")
    scans = rows.groupBy("scan").agg(F.concat(F.min("origin"), F.lit("/list")).alias("url"))
    pairs = scans.where("scan % 5 = 0").select("scan", F.lit("c2").alias("col_key"), F.lit("slug").alias("key"))
    teaser = rows.where("way >= 3 AND row = 0").select("scan", F.lit(0).alias("ord"), F.concat("origin", F.lit("/promo/"), "slug").alias("href"))  # one row is linked in another way, too
    teaser = teaser.unionByName(rows.where("way >= 3").select("scan", (F.col("row") + 1).alias("ord"), F.concat("origin", F.lit("/en/co/"), "slug", F.lit("/about")).alias("href"))).unionByName(rows.where("way >= 3").select("scan", F.lit(9).alias("ord"), F.concat(F.lit("https://other.net/co/"), "slug").alias("href")))
    return I.find_sources(scans, page, feed, pairs, teaser)


@query(
    """SELECT s_suppkey::BIGINT AS site, CASE WHEN s_suppkey % 5 = 4 THEN 'code' ELSE 'slug' END AS key, 'https://s' || s_suppkey || '.example.org' || CASE s_suppkey % 5 WHEN 0 THEN '/exhibitor/{v}' WHEN 3 THEN '/en/item/{v}' WHEN 4 THEN '/exhibitors/{v}' END AS pattern FROM supplier WHERE s_suppkey % 5 IN (0, 3, 4)"""
)
def verified_patterns(spark, sf_dir):
    """A site for each supplier. Fifths: pages at the first pattern; a site that answers every address alike, and one whose second row has another firm's page, which are refused; pages at a later pattern, behind a wrong page; pages by another field."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 5
    s = table(spark, sf_dir, "supplier").select(k.cast("long").alias("site"), n.alias("n"), F.concat(F.lit("https://s"), k, F.lit(".example.org")).alias("origin"), F.array(F.lit("/en/exhibitors/list")).alias("hints"))
    firm = lambda i: F.concat(F.lit(f"Firm {i} & Söhne "), "site")
    field = lambda key, i: F.struct(F.lit(key).alias("key"), F.lit(i).alias("key_ord"), F.array(*[F.concat(F.lit(f"{key}{j}-"), "site") for j in (1, 2)]).alias("values"))
    keys = s.select("site", F.explode(F.array(field("slug", 0), field("code", 1))).alias("x"), F.array(firm(1), firm(2)).alias("wants")).select("site", "x.*", "wants")
    probed = I.probes(I.candidate_patterns(s.select("site", "origin", "hints")), keys)
    at = lambda path, key, i: F.concat("origin", F.lit(path), F.lit(f"/{key}{i}-"), "site")
    body = lambda i: F.concat(F.lit("<h1>"), F.upper(firm(i)), F.lit("</h1>"))
    page = lambda url, html, status=200: F.struct(url.alias("url"), F.lit(status).alias("status"), html.alias("html"))
    both = F.concat(F.lit("<p>"), firm(1), F.lit(", "), firm(2), F.lit("</p>"))
    cases = F.when(F.col("n") == 0, F.array(page(at("/exhibitor", "slug", 1), body(1)), page(at("/exhibitor", "slug", 2), body(2)), page(at("/exhibitors", "slug", 1), body(1))))
    cases = cases.when(F.col("n") == 2, F.array(page(at("/exhibitor", "slug", 1), body(1)), page(at("/exhibitor", "slug", 2), body(1))))
    cases = cases.when(F.col("n") == 3, F.array(page(at("/exhibitor", "slug", 1), F.lit("<h1>Another firm</h1>")), page(at("/en/item", "slug", 1), body(1)), page(at("/en/item", "slug", 2), body(2)), page(at("/exhibitors", "slug", 1), body(1), 404)))
    cases = cases.when(F.col("n") == 4, F.array(page(at("/exhibitors", "code", 1), body(1)), page(at("/exhibitors", "code", 2), body(2))))
    captures = s.select(F.explode(cases).alias("x"), "site").select("x.*")
    every = probed.where("site % 5 = 1").select(F.explode(F.array("url", "fake_url", "second_url")).alias("url"), "site").join(s.select("site", both.alias("html")), "site").select("url", F.lit(200).alias("status"), "html").distinct()
    return I.verified_patterns(probed, captures.unionByName(every))
