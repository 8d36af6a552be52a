"""Lookups, sources of item pages and patterns on rows that lack everything, and on pages that disagree."""

from pyspark.sql import functions as F

from harrow.operators import company as C
from harrow.operators import items as I
from harrow.operators import pages as H

COMPANIES = "id long, name string, website string, profile_url string"
PAGES = "page_id long, url string, html string"


def test_lookup_of_companies_without_anything(spark):
    companies = spark.createDataFrame([(1, None, None, None), (2, "", "no address", ""), (3, "Firm GmbH", "https://firm.com", None), (4, "Firm GmbH", None, "https://fair.org/x")], COMPANIES)
    for pages in ([], [(1, None, None), (2, "https://firm.com", None), (3, "https://fair.org/x", "")]):
        got = {r["id"]: r for r in C.lookup_companies(companies, spark.createDataFrame(pages, PAGES)).collect()}
        assert sorted(got) == [1, 2, 3, 4] and all(r["people"] is None and r["company_email"] is None for r in got.values())
        assert [got[i]["website"] for i in (1, 2, 3, 4)] == [None, None, "https://firm.com", None] and got[3]["needs"] == ["people"] and got[1]["needs"] == ["website", "people"]
    assert C.lookup_companies(companies.limit(0), spark.createDataFrame([], PAGES)).count() == 0


def test_lookup_reads_what_the_site_leads_to_once(spark):
    page = lambda i, url, body: (i, url, f"<html><head><title>Firm</title></head><body>{body}</body></html>")
    links = "".join(f"<a href='/{x}'>{x}</a>" for x in ("contact", "about", "imprint", "team", "news"))
    pages = [
        page(1, "https://www.firm.com/", f"<p>Founder: Anna Meier</p>{links}"), page(2, "https://firm.com/imprint", "<p>CEO: Bernd Schulz</p><p>b.schulz@firm.com</p><p>office@firm.com</p>"),
        page(3, "https://firm.com/about", "<p>Managing Director: Anna Meier</p><p>anna.meier@firm.com</p>"), page(4, "https://firm.com/contact", "<p>info@firm.com</p>"), page(5, "https://firm.com/news", "<p>Founder: Clara Vogel</p>"),
        page(6, "https://firm.com/imprint/", "<p>CEO: Never Read</p>"),
    ]
    companies = spark.createDataFrame([(1, "Firm", "firm.com", None), (2, "Firm", "http://firm.com", None)], COMPANIES)
    for r in C.lookup_companies(companies, spark.createDataFrame(pages, PAGES)).collect():
        people = {p["name"]: p for p in r["people"]}
        assert r["website"] == "https://www.firm.com" and r["pages"][:2] == ["https://www.firm.com/", "https://firm.com/imprint"] and "https://firm.com/news" not in r["pages"]
        assert set(people) == {"Anna Meier", "Bernd Schulz"} and people["Anna Meier"]["email"] == "anna.meier@firm.com" and people["Bernd Schulz"]["email"] == "b.schulz@firm.com" and r["company_email"] == "office@firm.com"


def test_flagged_lines_are_page_lines(spark):
    body = "<nav><p>Menu</p>Home</nav><p>One</p>text<header>Top<footer>x</footer></header> after <aside>Side</aside><div>Two <b>three</b></div>"
    got = spark.createDataFrame([(body,)], "html string").select(H.flagged_lines("html").alias("f"), H.page_lines("html").alias("all"), H.page_lines("html", content_only=True).alias("content")).first()
    assert [x["line"] for x in got["f"]] == got["all"] and [x["line"] for x in got["f"] if x["content"]] == got["content"]


def test_sources_and_patterns_of_nothing(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    scans = spark.createDataFrame([(1, "https://x.org/list"), (2, None)], "scan long, url string")
    page, feed = none("scan long, col_key string, col_ord int, row int, attr string, value string"), none("scan long, key string, key_ord int, row int, value string")
    assert I.find_sources(scans, page, feed, none("scan long, col_key string, key string"), none("scan long, ord int, href string")).count() == 0
    blank = spark.createDataFrame([(s, "k", 0, i, None) for s in (1, 2) for i in range(3)], feed.schema)
    assert I.find_sources(scans, page, blank, none("scan long, col_key string, key string"), spark.createDataFrame([(1, 0, None), (2, 0, "https://x.org/a")], "scan long, ord int, href string")).count() == 0
    sites = spark.createDataFrame([(1, "https://x.org", ["/en/list"]), (2, "https://y.org", [])], "site long, origin string, hints array<string>")
    keys = spark.createDataFrame([(1, "slug", 0, ["a-1"], [None]), (2, "slug", 0, [None], []), (2, "id", 1, [], None)], "site long, key string, key_ord int, values array<string>, wants array<string>")
    probed = I.probes(I.candidate_patterns(sites), keys)
    assert {r["site"] for r in probed.collect()} == {1} and I.verified_patterns(probed, none("url string, status int, html string")).count() == 0
    first = probed.orderBy("probe").first()
    pages = spark.createDataFrame([(first["url"], 200, "<p>It is A-1 here</p>")], "url string, status int, html string")
    assert [tuple(r) for r in I.verified_patterns(probed, pages).collect()] == [(1, "slug", first["pattern"])]  # without a name, the page must say the value; one row is enough
    alike = pages.union(spark.createDataFrame([(first["fake_url"], 200, "<p>It is A-1 here</p>")], pages.schema))
    assert I.verified_patterns(probed, alike).count() == 0


def test_cells_of_one_page_do_not_move_to_another(spark):
    body = "<ul>" + "".join(f"<li><b>{i}</b><i>x{i}</i><i>y{i}</i></li>" for i in range(3)) + "</ul>"
    pages = spark.createDataFrame([(i, "https://x.org/", body) for i in (1, 2)] + [(3, None, None), (4, "", "<ul><li></li><li></li><li></li></ul>")], PAGES).withColumn("value", F.lit("mine"))
    cells = H.list_cells(H.list_leaves(H.elements(pages)))
    assert {(r["page_id"], r["item_ord"], r["value"]) for r in cells.where("path = '>i'").collect()} == {(p, i + 1, f"x{i}, y{i}") for p in (1, 2) for i in range(3)}
    assert H.made_lists(cells, H.cell_columns(cells)).count() == 4 and H.best_lists(H.list_candidates(H.elements(pages.limit(0))), H.list_columns(H.list_leaves(H.elements(pages.limit(0))))).count() == 0
