"""Operators on small tables: order, nulls, ties and the number of partitions must not change results."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.operators import assembly as A
from harrow.operators import matching as M
from harrow.operators import ordering as O
from harrow.operators import pages as H
from harrow.operators import profiling as P
from harrow.plans.entities import first_per_entity
from harrow.sources import feeds, sinks
from harrow.streaming import jobs


def test_first_per_entity(spark):
    rows = spark.createDataFrame([(1, "a", 9), (2, "b", 8), (3, "a", 7), (4, None, 6), (5, " ", 5)], "_ord int, k string, v int")
    for n in (1, 4):
        assert sorted(r["_ord"] for r in first_per_entity(rows.repartition(n), "k", ["_ord"]).collect()) == [1, 2]


def test_record_sets_and_flattening():
    body = {"code": 0, "data": {"total": 7, "list": [{"id": 1, "name": "x", "stands": [{"hall": "1"}, {"hall": "2"}], "tags": ["a", None, "b"]}, {"id": 2, "name": "y", "deep": {"a": {"b": {"c": {"d": "e"}}}}}]}}
    assert [(p, len(r)) for p, r in R.record_sets(body)] == [("data.list", 2)]  # the stands share one key only
    first = {k: v for k, v, _ in R.flattened(body["data"]["list"][0])}
    assert first["stands.0.hall"] == "1" and first["tags"] == "a, , b"
    assert {k: v for k, v, _ in R.flattened(body["data"]["list"][1])}["deep.a.b.c.d"] == '"e"'
    assert R.total_of(body) == 7 and R.total_of({"count": 3, "data": {"total": 0}}) == 0
    assert R.total_of({"hits": [{"total": 1}], "nbPages": 3, "hitsPerPage": 20}) == 60
    assert R.total_of([{"count": 9}]) is None and R.tolerant('so: ```json\n{"a": 1}\n``` there') == {"a": 1}


@pytest.mark.parametrize(
    ("url", "body", "style", "first", "size"),
    [
        ("", {"page": 1, "limit": 36}, "body_page", 1, 36),
        ("https://x.org/?pageNumber=2&limit=36", None, "query_page", 2, 36),
        ("", {"params": "query=&page=0&filters=x"}, "body_params_page", 0, 1000),
        ("", {"requests": [{"params": "query=a"}]}, "body_params_page", 0, 1000),
        ("", {"query": "q", "variables": {"page": 3, "first": 10}}, "body_nested_page", 3, 10),
        ("", {"query": {"from": 0, "size": 25}}, "body_nested_offset", 0, 25),
        ("https://x.org/?q=1", None, None, None, None),
    ],
)
def test_paging(url, body, style, first, size):
    found = R.paging_of(url, body) or {}
    assert (found.get("style"), found.get("first"), found.get("page_size")) == (style, first, size)
    if style and style.startswith("body"):
        assert R.body_without_page(body, found) != body or "page" not in json.dumps(body)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab", min_size=1, max_size=2), x, max_size=3), max_leaves=20))
def test_flattened_depth(value):
    assert all(k.count(".") <= R.DEEPEST for k, _, _ in R.flattened({"r": value}))


def test_matching(spark):
    page = [("l", "name", 0, i, v, "own") for i, v in enumerate(["Alpha", "beta", "<b>Gamma</b>", "delta", None])] + [("l", "link", 1, i, f"https://x.org/c/{s}/", "href") for i, s in enumerate(["alpha-x", "beta-x", "gamma-x"])]
    feed = [("f", "title", 0, i, v) for i, v in enumerate(["ALPHA", "Beta", "gamma", "Delta"])] + [("f", "slug", 1, i, f"{s}-x") for i, s in enumerate(["alpha", "beta", "gamma", "delta"])]
    feed += [("decoy", "id", 0, i, str(i)) for i in range(3)]
    p = spark.createDataFrame(page, "list_id string, col_key string, col_ord int, row_idx int, value string, attr string")
    f = spark.createDataFrame(feed, "feed_id string, key string, key_ord int, row_idx int, value string")
    scores = M.column_scores(p, f)
    assert {(r["col_key"], r["key"], round(r["score"], 3)) for r in scores.collect()} == {("name", "title", 1.0), ("link", "slug", 1.0)}
    lists = spark.createDataFrame([("l", 2, 5)], "list_id string, columns int, count int")
    sizes = spark.createDataFrame([("f", 0, 4), ("decoy", 1, 3)], "feed_id string, feed_ord int, rows int")
    assert M.best_match(M.pairs(scores), lists, sizes).first()["feed_id"] == "f"


def test_greedy_pairs_take_each_field_once(spark):
    scores = spark.createDataFrame([("l", "a", 0, "f", "x", 0, 0.9), ("l", "b", 1, "f", "x", 0, 0.95), ("l", "b", 1, "f", "y", 1, 0.6), ("l", "c", 2, "f", "y", 1, 0.5)], "list_id string, col_key string, col_ord int, feed_id string, key string, key_ord int, score double")
    assert sorted((r["col_key"], r["key"]) for r in M.pairs(scores).collect()) == [("a", "x"), ("b", "y")]


def test_assemble_keeps_rows_without_members(spark):
    rows = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "_ord int, url string")
    items = spark.createDataFrame([("u1", "t", [("n1", "r1"), ("n2", None)], ["a", "", "b"]), ("u2", None, [], [])], "url string, title string, team array<struct<name:string,role:string>>, tags array<string>")
    got = A.assemble(rows, items, "url", ["title"], ("team", ["name", "role"]), {"all_tags": "tags"}).collect()
    assert sorted((r["_ord"], r["title"], r["all_tags"], r["name"], r["role"]) for r in got) == [(1, "t", "a; b", "n1", "r1"), (1, "t", "a; b", "n2", ""), (2, "", "", "", ""), (3, "", "", "", "")]


def test_plan_rows(spark):
    rows = spark.createDataFrame([(1, "Acme", "Germany"), (2, "acme ", "Deutschland"), (3, "", "Germany"), (4, None, "Germany"), (5, "B", "France"), (6, "C", "Germany")], "_ord int, name string, country string")
    from harrow.functions.web import same_country

    out = A.plan_rows(rows, [("Company", F.col("name"), F.lit("List"), F.lit("High"))], F.col("name"), same_country("country", "German"), True, 4)
    assert [tuple(r) for r in out.collect()] == [("Acme", "List", "High"), ("", "", ""), ("", "", ""), ("C", "List", "High")]


def test_lead_names_and_unique_names():
    assert A.lead_names(["website"], ["Website", "Notes"]) == {"Website": "Website (lookup)", "Notes": "Notes"}
    assert P.unique_names(["Title", "Title 2", "Hall 4", "Hall", "", "Column"]) == ["Title", "Subtitle", "Hall", "Secondary hall", "Column", "Secondary column"]


def test_default_columns(spark):
    rows = [(i, f"name {i}", f"s{i}", f'"s{i}"', "x" * 200, "role", f"logo{i}.png") for i in range(3)]
    df = spark.createDataFrame(rows, "r int, name string, stand string, stand_name string, about string, role string, logo string")
    cells = P.long_form(df, ["name", "stand", "stand_name", "about", "role", "logo"], "r")
    got = P.default_columns(P.profile(cells, 3), cells, 3).where("on").collect()
    assert {r["key"] for r in got} == {"name", "stand"}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_order_holds_for_any_partitions(spark, parts):
    df = spark.range(100).withColumnRenamed("id", "o").repartition(parts)
    assert sorted(r["o"] for r in O.spread(df, 5, "o").collect()) == [0, 25, 50, 74, 99]
    assert O.spread(df, 1, "o").first()["o"] == 0 and O.spread(df, 200, "o").count() == 100
    assert O.upper_median(df, "o").first()[0] == 50


def test_stop_rule(spark):
    pages = [("a", 0, 10, 25, None), ("a", 1, 10, None, None), ("a", 2, 5, None, None), ("a", 3, 10, None, None), ("b", 0, 10, None, None), ("b", 1, 0, None, None), ("b", 2, 3, None, None)]
    df = spark.createDataFrame(pages, "f string, page int, rows int, total int, cap int")
    assert sorted((r["f"], r["page"]) for r in O.stop_rule(df, ["f"], F.lit(10)).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert O.stop_rule(df, ["f"], max_rows=10).count() == 2


def test_page_lists(spark):
    body = "<nav><ul><li><a href='/a'>A<li><a href='/b'>B<li><a href='/c'>C</ul></nav><div class='card'><h2>One</h2><b>x1</b></div><div class='card'><h2>Two</h2><b>x2</b></div><div class='card'><h2>Three</h2></div>"
    pages = spark.createDataFrame([(1, "https://x.org/", body), (2, None, None)], "page_id long, url string, html string")
    nodes = H.elements(pages)
    lists = H.sibling_lists(nodes)
    assert sorted((r["sig"], r["items"], r["chrome"]) for r in lists.collect()) == [("div.card", 3, False), ("li", 3, True)]
    columns = H.list_columns(H.list_leaves(nodes))
    assert {(r["path"], r["attr"], r["hits"]) for r in columns.where("sig = 'div.card'").collect()} == {(">h2", "own", 3), (">b", "own", 2)}
    assert H.best_lists(H.list_candidates(nodes), columns).where("rank = 1").first()["sig"] == "div.card"


def test_csv_and_json_parts(spark, tmp_path):
    df = spark.createDataFrame([(2, "=x", None, 2.0), (1, "é, \"q\"", "b", 1.5)], "o int, a string, b string, n double")
    sinks.write("csv", df, str(tmp_path / "c"), ["a", "b", "n"], "o")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*"))).decode("utf-8")
    assert text == '﻿a,b,n\r\n"é, ""q""",b,1.5\r\n\'=x,,2\r\n'
    sinks.write("json", df, str(tmp_path / "j"), ["a", "b"], "o")
    assert {json.dumps(r.asDict()) for r in spark.read.json(str(tmp_path / "j")).collect()} == {'{"a": "=x", "b": ""}', '{"a": "\\u00e9, \\"q\\"", "b": "b"}'}
    with pytest.raises(ValueError):
        sinks.write("pdf", df, "x", [], "o")


def page_of_feed(page: int) -> str:
    return json.dumps({"data": {"total": 25, "list": [{"id": 10 * page + i, "name": f"n{i}"} for i in range(10 if page < 2 else 5)]}})


def test_paged_feed(spark):
    feeds.register(spark)
    pages = spark.read.format("paged_feed").option("fetch", "tests.test_operators:page_of_feed").option("pages", 5).option("pages_a_task", 2).load()
    assert pages.count() == 5 and pages.rdd.getNumPartitions() == 3
    kept = feeds.feed_pages(pages.withColumn("feed", F.lit("f")), page_size=10)
    assert sorted(r["page"] for r in kept.collect()) == [0, 1, 2]


def test_stages_resume(spark, tmp_path):
    built = []

    def first(_):
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        out = jobs.run_job(spark, str(tmp_path), [("rows", first), ("skipped", None), ("double", lambda df: df.selectExpr("id * 2 AS id"))])
    assert built == [1] and sorted(r["id"] for r in out.collect()) == [0, 2, 4]


def test_merge_people_and_leads_handle_empty(spark):
    none = spark.createDataFrame([], "g int, _ord int, name string, role string, email string, phone string, linkedin string, confidence string")
    assert A.best_people(A.merge_people(none, ["g"]), ["g"]).count() == 0
    old = spark.createDataFrame([(1, "w", ["p"], ["a", "b"])], "id int, website string, people array<string>, pages array<string>")
    new = spark.createDataFrame([(1, "", [], ["b", "c"])], "id int, website string, people array<string>, pages array<string>")
    assert tuple(A.merge_leads(old, new, ["website"]).first()) == (1, "w", ["p"], ["a", "b", "c"])


def _pages_at(spark, folder, htmls):
    spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").withColumn("url", F.lit("https://x.example.org/")).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_norm_of_whole_pages(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    from harrow.plans.text_queries import norm_whole_pages

    htmls = ["<i>" * 2000 + "Late &amp; ﬁne, Straße", "<p>A</p>" + "é x " * 20_000, "", None]
    got = {r["page_id"]: (r["size"], r["sha256"]) for r in norm_whole_pages(spark, _pages_at(spark, tmp_path, htmls)).collect()}
    for i, html in enumerate(htmls):
        s = re.sub(r"&nbsp;|&amp;|&#\d+;", " ", re.sub("<[^>]+>", " ", html or ""))
        s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).lower())
        s = re.sub(r"^[\s·•|,;:–-]+|[\s·•|,;:–-]+$", "", s).strip()
        assert got[i] == (len(s), hashlib.sha256(s.encode()).hexdigest())


def test_list_queries_reach_deep_leaves(spark, tmp_path):
    from harrow.plans.order_queries import best_lists, list_columns

    items = "".join(f"<li><div><p><span><b>deep {i}</b></span></p></div></li>" for i in range(4))
    folder = _pages_at(spark, tmp_path, [f"<html><body><ul>{items}</ul></body></html>"])
    assert [(r["path"], r["hits"]) for r in list_columns(spark, folder).collect()] == [(">div>p>span>b", 4)]
    assert [r["items"] for r in best_lists(spark, folder).where("sig = 'li'").collect()] == [4]


def test_facts_of_links_structured_data_and_content(spark):
    from harrow.operators.company import facts

    person = '{"@type": "Person", "name": "Ada Bauer", "jobTitle": "CEO", "email": "mailto:ada@x.org"}'
    links = '<p>Founder: Anna Meier</p><p><a href="mailto:anna.meier@x.org?subject=a">Mail</a> <a href="tel:+49 30 1234567">Call</a></p><p><a href="https://www.linkedin.com/in/anna-meier/"><i></i></a></p>'
    rows = [(1, f'<script type="application/ld+json">{person}</script>'), (2, links), (3, "<nav><p>Bernd Kranz</p><p>CEO</p></nav><p>Text</p>"), (4, "<p>Bernd Kranz</p><p>CEO</p>")]
    pages = spark.createDataFrame([(i, "https://x.org/", f"<html><body>{h}</body></html>") for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in facts(pages).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1]["name"], got[1]["role"], got[1]["email"], got[1]["confidence"]) == ("Ada Bauer", "ceo", "ada@x.org", "high")
    assert (got[2]["name"], got[2]["email"], got[2]["linkedin"]) == ("Anna Meier", "anna.meier@x.org", "https://www.linkedin.com/in/anna-meier") and "1234567" in got[2]["phone"].replace(" ", "")
    assert (got[4]["name"], got[4]["confidence"]) == ("Bernd Kranz", "medium")


def test_whole_tables_are_read(spark, tmp_path):
    from harrow.plans.catalog_queries import lead_columns
    from harrow.plans.join_queries import align_whole_rows

    rows = [(i, f"Customer {i}", "MACHINERY") for i in range(5000, 5030)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert lead_columns(spark, str(tmp_path)).first()["website_col"] == "Web site"
    assert sorted(r["page_row"] for r in align_whole_rows(spark, str(tmp_path)).collect()) == [i for i, *_ in rows if i % 3]


def test_diverse_pages_against_plain_greedy(spark):
    import random

    from harrow.operators import catalog as K

    rnd = random.Random(3)
    rows = []
    for sample in range(4):
        for page in range(12):
            for f in {rnd.choice("tsc") + ":" + rnd.choice("abcdefghijk") for _ in range(rnd.randint(0, 9))}:
                rows.append((sample, 100 * sample + page, f, rnd.randint(1, 4)))
            rows.append((sample, 100 * sample + page, "text", rnd.randint(0, 3000)))
    got = {}
    for r in K.diverse_pages(spark.createDataFrame(rows, "sample long, page_id long, feature string, n long"), most=6).collect():
        got.setdefault(r["sample"], []).append((r["pick"], r["page_id"]))
    for sample in range(4):
        own = [r[1:] for r in rows if r[0] == sample]
        ids = sorted({p for p, _, _ in own})
        marks = {p: {f for q, f, _ in own if q == p and f != "text"} for p in ids}
        size = {p: n for p, f, n in own if f == "text"}
        best = {}
        for p, f, n in sorted(own):
            if f.startswith("t:") and n >= 2 and n > best.get(f, (0, 0))[1]:
                best[f] = (p, n)
        picks = list(dict.fromkeys(p for f, (p, n) in sorted(best.items(), key=lambda x: (-x[1][1], x[0]))))[:6]
        while len(picks) < 6:
            seen = set().union(*(marks[p] for p in picks)) if picks else set()
            new = {p: marks[p] - seen for p in ids if p not in picks}
            hooks = {p: sum(f[0] != "c" for f in x) for p, x in new.items()}
            p = max(new, key=lambda p: (1000 * hooks[p] + len(new[p]) - hooks[p] + size[p] / 1000, -p))
            if len(picks) >= 4 and hooks[p] < 3:
                break
            picks.append(p)
        assert [p for _, p in sorted(got[sample])] == picks


def plain_best_lists(nodes, columns, most=8):
    """The lists of one page: rows of pages.elements and of pages.list_columns."""
    import math

    groups = {}
    for r in nodes:
        if r["items"][-1] >= 3:
            groups.setdefault((r["parent"], r["sig"]), []).append(r)
    found = []
    for (parent, sig), items in groups.items():
        texts, leaves = [], []
        for it in items[:25]:
            own = [r for r in nodes if it["node"] <= r["node"] <= it["last"]]
            texts.append(min(400, max(0, sum(len(r["own"]) + 1 for r in own if r["own"]) - 1)))
            leaves.append(min(30, sum(any(c.isalnum() for c in r["own"]) for r in own) + sum(r["link"] is not None for r in own)))
        text, leaf = sum(texts) / len(texts), sum(leaves) / len(leaves)
        if text < 2 and leaf < 1:
            continue
        weight = (0.15 if items[0]["chrome"] else 1) * (0.35 if leaf <= 2 and text < 25 else 1)
        score = len(items) ** 0.6 * math.log(text + 3) * min(leaf, 12) * weight
        found.append((-round(score, 9), parent, sig, [(i["node"], i["last"]) for i in items], text, weight))
    chosen = []
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    for c in sorted(found):
        for k in chosen:
            if len(k[3]) != len(c[3]):
                if any(a <= c[1] <= b for a, b in k[3]) and len(c[3]) < 8:
                    break
            elif all(inside(x, y) or inside(y, x) for x, y in zip(c[3], k[3], strict=True)):
                break
        else:
            chosen.append(c)
    out = []
    for c in chosen[:most]:
        own = [r for r in columns if (r["parent"], r["sig"]) == (c[1], c[2])]
        if any(r["attr"] == "own" for r in own):
            score = own[0]["items"] ** 0.6 * math.log(c[4] + 3) * len(own) ** 0.8 * c[5]
            out.append((-round(score, 9), min(r["first"] for r in own), c[1], c[2]))
    return [(x[2], x[3]) for x in sorted(out)]


def test_best_lists_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    cards = "".join(f"<div class='a'><div class='b'><h3>Entry number {i}</h3><ul>{''.join(f'<li>tag {i}-{j}</li>' for j in range(i))}</ul><p>x <i>{i}</i></p></div></div>" for i in range(12))
    grids = "".join(f"<section>{''.join(f'<article><h2>Title {i} of {s}</h2><p>Text of it</p></article>' for i in range(s))}</section>" for s in (3, 4, 5))
    pages = pages.union(spark.createDataFrame([(10_001, "https://x.org/", f"<body>{cards}{grids}</body>"), (10_002, None, None)], "page_id long, url string, html string"))
    nodes = H.elements(pages)
    columns = H.list_columns(H.list_leaves(nodes))
    by_page, known, got = {}, {}, {}
    for r in nodes.orderBy("page_id", "node").collect():
        by_page.setdefault(r["page_id"], []).append(r)
    for r in columns.collect():
        known.setdefault(r["page_id"], []).append(r)
    for r in H.best_lists(H.list_candidates(nodes), columns).orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append((r["parent"], r["sig"]))
    want = {p: plain_best_lists(own, known.get(p, [])) for p, own in by_page.items()}
    assert got == {p: x for p, x in want.items() if x} and len(got[10_001]) >= 4


def test_pages_of_best_lists_are_parsed_once(spark, tmp_path):
    from harrow.plans.order_queries import best_lists

    items = "".join(f"<li><a href='/{i}'>entry {i}</a><p>some words</p></li>" for i in range(5))
    folder = _pages_at(spark, tmp_path, [f"<body><p>before</p><ul>{items}</ul></body>", None])
    lists = best_lists(spark, folder)
    assert [(r["page_id"], r["sig"], r["items"], r["columns"]) for r in lists.collect()] == [(0, "li", 5, 2)]
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "html" not in plan  # elements are read, pages aren't parsed again
    nodes = H.elements(spark.read.parquet(f"{folder}/pages.parquet"))
    whole = H.best_lists(H.list_candidates(nodes), H.list_columns(H.list_leaves(nodes)))
    assert whole.collect() == lists.collect() and H.listed(nodes).count() == 15


def test_list_cells_hold_all_repeats(spark):
    body = "".join(f"<div class='c'><b>{x}</b>{''.join(f'<span>{x}{j}</span>' for j in range(n))}<em>Hall:</em><i>h{x}</i></div>" for x, n in (("a", 0), ("b", 1), ("c", 3), ("d", 2)))
    table = "<table>" + "".join(f"<tr><td>{i}a</td><td>{i}b</td></tr>" for i in range(3)) + "</table>"
    leaves = H.list_leaves(H.elements(spark.createDataFrame([(1, "", body + table)], "page_id long, url string, html string")))
    cells = H.list_cells(leaves)
    assert {(r["item_ord"], r["value"]) for r in cells.where("path = '>span'").collect()} == {(2, "b0"), (3, "c0, c1, c2"), (4, "d0, d1")}
    columns = {r["path"]: r for r in H.cell_columns(cells).where("sig = 'div.c' OR sig = 'tr'").collect()}
    assert set(columns) == {">b", ">span", ">i", ">td:1", ">td:2"}  # the label is gone, cells of a table stay apart
    assert (columns[">i"]["label"], columns[">i"]["label_strong"], columns[">b"]["label"]) == ("Hall", True, None) and columns[">span"]["multi"]


def test_slots_without_text_are_no_rows(spark):
    body = "".join(f"<div class='c'><a href='/{i}'></a><b>{'' if i % 2 else f'n{i}'}</b><i>{'' if i % 2 else f'v{i}'}</i><u>{'' if i != 2 else 'only'}</u></div>" for i in range(8))
    cells = H.list_cells(H.list_leaves(H.elements(spark.createDataFrame([(1, "https://x.org", body)], "page_id long, url string, html string"))))
    columns = H.cell_columns(cells)
    assert {(r["path"], r["items"], r["hits"]) for r in columns.collect()} == {(">a", 8, 8), (">b", 8, 4), (">i", 8, 4)}
    assert {(r["path"], r["items"], r["hits"], r["fill"]) for r in H.made_lists(cells, columns.where("path <> '>a'")).collect()} == {(">b", 4, 4, 1.0), (">i", 4, 4, 1.0)}


def test_best_lists_holds_all_lists_of_a_page(spark, tmp_path):
    """Twelve lists of different sizes on one page, and one whose first thirty items say much less than the others."""
    from harrow.plans.order_queries import best_lists

    many = "".join(f"<section class='s{'abcdefghijkl'[n]}'>{''.join(f'<article><h2>Title {i} of {n}</h2><p>Some words</p></article>' for i in range(n + 3))}</section>" for n in range(12))
    late = "".join(f"<p>{'' if i < 30 else 'the long text of an entry ' * 5}</p>" for i in range(60))
    folder = _pages_at(spark, tmp_path, [f"<body>{many}</body>", f"<body><div>{late}</div></body>"])
    got = best_lists(spark, folder).orderBy("page_id", "rank").collect()
    assert [(r["sig"], r["items"]) for r in got if r["page_id"] == 0] == [("article", n) for n in range(14, 2, -1)]
    assert [(r["sig"], r["items"], r["columns"]) for r in got if r["page_id"] == 1] == [("p", 60, 1)]


def test_outermost_lists_of_pages_with_many(spark):
    """As trying all pairs, on random pages; a page of twenty thousand lists takes seconds."""
    import random
    import time

    import numpy as np

    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]

    def plain(spans, parents):
        chosen = []
        for i, own in enumerate(spans):
            for k in chosen:
                if len(spans[k]) != len(own):
                    if len(own) < 8 and any(a <= parents[i] <= b for a, b in spans[k]):
                        break
                elif all(inside(x, y) or inside(y, x) for x, y in zip(own, spans[k], strict=True)):
                    break
            else:
                chosen.append(i)
        return chosen

    def page(rnd):
        lists, count = [], 0

        def element(depth):
            nonlocal count
            me, count = count, count + 1
            if depth < 4:
                for _ in range(rnd.randint(0, 2)):
                    lists.append((me, [element(depth + 1) for _ in range(rnd.randint(1, 10))]))
            return me, count - 1

        element(0)
        rnd.shuffle(lists)
        return [x for x in lists if len(x[1]) >= 3]

    for seed in range(30):
        lists = page(random.Random(seed))
        if lists:
            spans, parents = [np.array(x) for _, x in lists], [p for p, _ in lists]
            assert H.outermost(spans, parents) == plain(spans, parents) and H.outermost(spans, parents, 4) == plain(spans, parents)[:4]
    many = [np.array([[10 * k + 1 + 2 * j, 10 * k + 2 + 2 * j] for j in range(3)]) for k in range(20_000)]
    began = time.time()
    assert len(H.outermost(many, [10 * k for k in range(20_000)])) == 20_000 and time.time() - began < 20
