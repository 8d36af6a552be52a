"""Lists of pages that are composed from the tables: a page for each nation, a card for each of its customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import catalog as K
from harrow.operators import pages as H
from harrow.session import table

QUERIES: dict = {}
ORACLE: dict = {}

#: Each customer with its place on its nation's page.
CARDS = """c AS (SELECT *, c_nationkey::BIGINT AS page_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS item_ord, count(*) OVER (PARTITION BY c_nationkey) AS items FROM customer)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def card_pages(spark, sf_dir, empty: bool = False):
    """Pages of cards: a name, tags (none to four), a label with the segment after it, one or two numbers in parts of the same look; with empty, every seventh card has no text."""
    k = F.col("c_custkey")
    tags = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda j: j < k % 5), lambda j: F.concat(F.lit('<span class="tag">t'), j, F.lit("-"), k, F.lit("</span>")))
    phone = lambda n: F.concat(F.lit("<div class='part'><i>no. "), n, F.lit("</i></div>"))
    full = F.concat(F.lit("<h3>"), "c_name", F.lit("</h3><p>"), F.array_join(tags, ""), F.lit("</p><em>Segment:</em><b>"), "c_mktsegment", F.lit("</b>"), phone(k), F.when(k % 2 == 0, phone(k + 1)).otherwise(""))
    card = F.concat(F.lit('<div class="card">'), F.when((k % 7 == 0) & F.lit(empty), "<i></i>").otherwise(full), F.lit("</div>"))
    cards = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k, card.alias("card")))).alias("cards"))
    html = F.concat(F.lit("<html><body><main>"), F.array_join(F.transform("cards", lambda x: x["card"]), ""), F.lit("</main></body></html>"))
    return cards.select("page_id", F.lit("https://x.example.org/").alias("url"), html.alias("html"))


@query(f"""WITH {CARDS} SELECT page_id, item_ord, c_custkey % 5 > 1 AS multi, list_aggregate(list_transform(range(c_custkey % 5), lambda j: 't' || j || '-' || c_custkey), 'string_agg', ', ') AS value FROM c WHERE c_custkey % 5 > 0 AND items >= 3""")
def tag_cells(spark, sf_dir):
    cells = H.list_cells(H.list_leaves(H.elements(card_pages(spark, sf_dir))))
    return cells.where("sig = 'div.card' AND path = '>p>span.tag'").select("page_id", "item_ord", "multi", "value")


@query(
    f"""WITH {CARDS}, n AS (SELECT page_id, max(items) AS items, count(*) FILTER (WHERE c_custkey % 5 > 0) AS tagged, count(*) FILTER (WHERE c_custkey % 5 > 1) AS many, count(*) FILTER (WHERE c_custkey % 2 = 0) AS even, count(*) FILTER (WHERE c_custkey % 2 = 1) AS odd, count(DISTINCT c_mktsegment) AS segments FROM c GROUP BY 1 HAVING max(items) >= 3),
        x AS (SELECT page_id, '>h3' AS path, items AS hits, false AS multi, NULL AS label, items FROM n UNION ALL SELECT page_id, '>p>span.tag', tagged, many > 0, NULL, items FROM n UNION ALL SELECT page_id, '>b', items, false, 'Segment', items FROM n WHERE segments > 1
              UNION ALL SELECT page_id, '>div.part>i', odd, false, NULL, items FROM n UNION ALL SELECT page_id, '>div.part:1>i', even, false, NULL, items FROM n UNION ALL SELECT page_id, '>div.part:2>i', even, false, NULL, items FROM n)
        SELECT page_id, path, hits, multi, label FROM x WHERE hits >= greatest(2, ceil(items * 0.25))"""
)
def card_columns(spark, sf_dir):
    columns = H.list_columns(H.list_leaves(H.elements(card_pages(spark, sf_dir))))
    return columns.where("sig = 'div.card'").select("page_id", "path", "hits", "multi", "label")


@query(
    f"""WITH {CARDS}, n AS (SELECT page_id, count(*) FILTER (WHERE c_custkey % 7 > 0) AS items, count(*) FILTER (WHERE c_custkey % 7 > 0 AND c_custkey % 5 > 0) AS tagged, max(items) AS slots, count(DISTINCT c_mktsegment) AS segments FROM c GROUP BY 1 HAVING max(items) >= 3)
        SELECT page_id, '>h3' AS path, items, items AS hits, 1.0::DOUBLE AS fill FROM n WHERE items >= greatest(2, ceil(slots * 0.25)) UNION ALL SELECT page_id, '>p>span.tag', items, tagged, tagged / items FROM n WHERE tagged >= greatest(2, ceil(slots * 0.25))"""
)
def lists_without_slots(spark, sf_dir):
    cells = H.list_cells(H.list_leaves(H.elements(card_pages(spark, sf_dir, empty=True))))
    made = H.made_lists(cells, H.cell_columns(cells))
    return made.where("sig = 'div.card' AND path IN ('>h3', '>p>span.tag')").select("page_id", "path", F.col("items").cast("long").alias("items"), "hits", "fill")


@query(f"""WITH {CARDS} SELECT page_id, 'cards' AS list_id, item_ord::INTEGER AS item_ord, f AS field, CASE f WHEN 'Name' THEN c_name ELSE 't0-' || c_custkey || CASE WHEN c_custkey % 5 > 1 THEN ', t1-' || c_custkey ELSE '' END || CASE WHEN c_custkey % 5 > 2 THEN ', t2-' || c_custkey ELSE '' END || CASE WHEN c_custkey % 5 > 3 THEN ', t3-' || c_custkey ELSE '' END END AS value
        FROM c, (VALUES ('Name'), ('Tags')) t(f) WHERE items >= 3 AND (f = 'Name' OR c_custkey % 5 > 0)""")
def extract_tags(spark, sf_dir):
    spec = spark.createDataFrame([("cards", "div.card", ">h3", "own", "Name"), ("cards", "div.card", ">p>span.tag", "own", "Tags")], "list_id string, sig string, path string, attr string, field string")
    return K.extract(H.list_leaves(H.elements(card_pages(spark, sf_dir))), spec)


def nested_pages(spark, sf_dir):
    """A page for each order priority and nation of customers: wrappers around rows, rows with lists of entries in one card; every third page has a long list in its last row."""
    k = F.col("n_nationkey")
    row = lambda i, inner: F.concat(F.lit("<section class='wrap'><div class='row'><h3>Name of entry "), F.lit(i), F.lit(" of "), "n_name", F.lit("</h3><p>Some words about it, "), k, F.lit(f" and {i}</p>"), inner, F.lit("</div></section>"))
    entries = lambda n: F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: F.concat(F.lit("<li>entry number "), j, F.lit(" of "), k, F.lit("</li>"))), ""), F.lit("</ul>"))
    body = F.concat(F.lit("<html><body><main>"), *[row(i, entries(F.lit(3)) if i == 1 else F.lit("")) for i in range(1, 5)], row(5, entries(F.when(k % 3 == 0, 9).otherwise(4))), F.lit("</main></body></html>"))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("page_id"), F.lit("https://x.example.org/").alias("url"), body.alias("html"))


@query("SELECT n_nationkey::BIGINT AS page_id, 'section.wrap' AS sig, 5 AS items FROM nation UNION ALL SELECT n_nationkey, 'li', 9 FROM nation WHERE n_nationkey % 3 = 0")
def outer_lists(spark, sf_dir):
    nodes = H.listed(H.elements(nested_pages(spark, sf_dir)))
    return H.best_lists(H.list_candidates(nodes), H.list_columns(H.list_leaves(nodes))).select("page_id", "sig", "items")
