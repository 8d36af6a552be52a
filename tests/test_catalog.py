"""Choosing, naming and JSON paths on small tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.operators import catalog as K
from harrow.operators import pages as H

LISTS = "list_id string, _ord int, score double, reach int, navigation boolean"
FEEDS = "feed_id string, _ord int, size int, paginated boolean"


@pytest.mark.parametrize(
    ("lists", "feeds", "links", "want"),
    [
        ([("a", 0, 9.0, 10, False), ("b", 1, 5.0, 40, False)], [], 0, ("list", "b")),
        ([("a", 0, 9.0, 20, False), ("b", 1, 5.0, 40, False)], [], 0, ("list", "a")),
        ([("a", 0, 9.0, 20, False)], [("f", 0, 60, False)], 0, ("feed", "f")),
        ([("a", 0, 9.0, 20, False)], [("f", 0, 50, False)], 0, ("list", "a")),
        ([("nav", 0, 99.0, 20, True)], [("f", 0, 5, False), ("g", 1, 5, True)], 0, ("feed", "g")),
        ([("a", 0, 9.0, 4, False)], [], 2, (None, None)),
        ([], [], 0, (None, None)),
    ],
)
def test_dataset_choice(spark, lists, feeds, links, want):
    assert tuple(K.choose_dataset(spark.createDataFrame(lists, LISTS), spark.createDataFrame(feeds, FEEDS), links).first()) == want


def test_feeds_shown(spark):
    feeds = spark.createDataFrame([("a", 0, "data.list", "GET /x", 5), ("b", 1, "filters", "GET /x", 50), ("c", 2, "options", "GET /y", 50), ("d", 3, "rows", "GET /z", 9)], "feed_id string, _ord int, json_path string, endpoint string, rows int")
    fields = [(f, k, False, 1.0) for f, ks in {"a": ["title", "town"], "b": ["title", "town"], "c": ["id", "label"], "d": ["title", "town"]}.items() for k in ks]
    frame = spark.createDataFrame(fields, "feed_id string, key string, plumbing boolean, fill double")
    matched = spark.createDataFrame([("d",)], "feed_id string")
    assert [r["feed_id"] for r in K.other_feeds(feeds, frame, matched).collect()] == ["a"]
    assert [r["feed_id"] for r in K.other_feeds(feeds, frame, matched, active="d").collect()] == ["a", "d"]


def test_open_columns(spark):
    columns = [("l", i, "own" if i != 1 else "link", 0.9 if i != 2 else 0.3) for i in range(10)] + [("m", 0, "link", 0.1), ("m", 1, "link", 0.1), ("n", 0, "link", 0.6)]
    got = K.open_columns(spark.createDataFrame(columns, "list_id string, col_ord int, attr string, fill double"))
    assert sorted((r["list_id"], r["col_ord"]) for r in got.where("on").collect()) == [("l", 0), ("l", 3), ("l", 4), ("l", 5), ("l", 6), ("l", 7), ("m", 0), ("n", 0)]


def test_best_name(spark):
    df = spark.createDataFrame([("Company 2", "country"), ("Stand", "standName"), ("Title", "companyName"), (None, "a.b"), ("Text", None), (None, None)], "p string, k string")
    assert [r[0] for r in df.select(K.best_name("p", "k")).collect()] == ["Country", "Stand", "Company name", "B", "Text", "Column"]


def test_item_fields(spark):
    seen = [(p, "L1", "name", "own", 3, f"n{p}", f"n{p}") for p in range(3)] + [(p, None, "city", "own", 1, f"c{p}", f"c{p}") for p in range(3)] + [(p, None, "footer", "own", 1, "x", "x") for p in range(3)]
    seen += [(0, None, "odd", "own", 1, "y", "y"), (0, "L2", "solo", "own", 1, "z", "z"), (0, "L3", "lone", "own", 1, "w", "w"), (0, None, "junk", "own", 1, "Read more", "Read more")]
    frame = spark.createDataFrame(seen, "page_id int, list_id string, field string, attr string, count int, sample string, value string")
    got = K.merge_item_fields(frame, spark.createDataFrame([("L3",)], "list_id string"), 3).orderBy("rank").collect()
    assert [(r["field"], r["suggested"]) for r in got] == [("lone", True), ("city", True), ("odd", False), ("name", True)]
    modes = spark.createDataFrame([(True, True), (True, False), (True, True), (False, False)], "suggested boolean, static_ok boolean")
    assert K.reading_mode(modes).first()[0] == "static" and K.reading_mode(modes.limit(0)).first()[0] == "static"


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,{"c":"x"}]},"paginationLimitedTo":1000}',), ("none",), (None,)], "p string")
    assert [r[0] for r in df.select(R.dig(F.col("p"), "a.b.1.c")).collect()] == ["x", None, None]
    assert [r[0] for r in df.select(R.number_in(F.col("p"), ["paginationLimitedTo"])).collect()] == [1000, None, None]
    put = [r[0] for r in df.select(R.changed(F.col("p"), "q.0.r", F.lit('"v"'))).collect()]
    assert json.loads(put[0])["q"] == [{"r": "v"}] and put[1:] == ["none", None]
    assert json.loads(df.select(R.changed(F.col("p"), "a.b.0")).first()[0])["a"] == {"b": [{"c": "x"}]}


def test_dataset_key_is_the_same_for_pages_of_one_feed(spark):
    rows = [("POST", "https://x.org/s?t=1", '{"page":1,"q":"a"}'), ("POST", "https://x.org/s?t=2", '{"page":2,"q":"a"}'), ("POST", "https://x.org/s", '{"page":1,"q":"b"}'), ("GET", "https://x.org/s", None)]
    keys = [r[0] for r in spark.createDataFrame(rows, "m string, u string, b string").select(R.dataset_key(F.col("m"), F.col("u"), F.col("b"), F.lit("data"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_single_fields(spark):
    html = "<body><header><h1>Site</h1></header><h1>Acme</h1><dl><dt>Town:</dt><dd>Bonn</dd></dl><table><tr><th>Hall</th><td>4</td></tr></table><span>Country:</span><b>Germany</b><a href='mailto:a@x.org?s=1'>mail</a><a href='tel:+49 30 1234567'>call</a></body>"
    nodes = H.elements(spark.createDataFrame([(1, "https://x.org/", html)], "page_id long, url string, html string"))
    got = {(r["name"], r["value"]) for r in K.single_fields(nodes).collect()}
    assert got == {("Name", "Acme"), ("Town", "Bonn"), ("Hall", "4"), ("Country", "Germany"), ("Email", "a@x.org"), ("Phone", "+49 30 1234567")}


def test_headers_and_wider_pages(spark):
    df = spark.createDataFrame([({":method": "GET", "Host": "x", "X-Key": "1"},)], "h map<string,string>")
    assert df.select(K.clean_headers("h")).first()[0] == {"X-Key": "1"}
    assert K.wider_pages(100, 10) == [3, 6, 9] and K.wider_pages(20, 10) == [] and K.wider_pages(None, 10) == []


def test_single_fields_and_their_sql_read_references_alike(spark, tmp_path):
    """Headings cut inside a reference, and references that a decoded & seems to begin."""
    from harrow import registry
    from tests import oracle

    said = ["A &amp", "token = &quot;x&quot;", "a &amp;quot; b", "&lt;b&gt; &amp;amp;", "x&nbsp; y", "it&#x27;s &#39;", "&am"]
    html = [f"<body><h1>{x}</h1><p>z</p></body>" for x in said]
    spark.createDataFrame([(i, "https://x.org/", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["single_fields"](spark, str(tmp_path)).toPandas()
    assert oracle.rows(got) == oracle.rows(con.execute(registry.ORACLE["single_fields"]).df())
    assert got.set_index("page_id")["value"].to_dict() == {0: "A &", 1: 'token = "x"', 2: "a &quot; b", 3: "<b> &amp;", 4: "x y", 5: "it's '", 6: "&am"}
