"""What only shows with many rows, long values, several batches or restarts."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.operators import matching as M
from harrow.operators import ordering as O
from harrow.operators import profiling as P
from harrow.streaming import jobs


def test_spread_over_a_million_rows(spark):
    n, parts = 1_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(n, numPartitions=8).select((F.col("id") * 48_271 % 2_147_483_647).alias("v"), F.lit("x").alias("other"))
        got = sorted(r["v"] for r in O.spread(rows, 40, "v").collect())
        every = sorted(i * 48_271 % 2_147_483_647 for i in range(n))
        assert got == [every[int(i * (n - 1) / 39 + 0.5)] for i in range(40)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5])
def test_spread_of_few_rows(spark, n):
    rows = spark.createDataFrame([(i % 3, None if i == 0 else i) for i in range(n)], "k int, v int")
    got = sorted(((r["k"], r["v"]) for r in O.spread(rows, 4, "v").collect()), key=str)
    every = sorted((((i % 3), None if i == 0 else i) for i in range(n)), key=lambda x: (x[1] is not None, x[1] or 0))
    assert got == sorted((every if n <= 4 else [every[int(i * (n - 1) / 3 + 0.5)] for i in range(4)]), key=str)


def held(link, value):
    """Whether a link holds a feed value, by the plain rule."""
    return len(value) > 3 and (link.endswith("/" + value) or f"/{value}?" in link or f"/{value}/" in link)


def test_links_that_hold_feed_values(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("ab?/") for _ in range(rnd.randint(3, 7)))
    links = sorted({"https://x/" + word() + "/" + word() for _ in range(150)} | {"/aaaa", "aaaa/", "https:///abab?", "//aaaa//"})
    values = sorted({word() for _ in range(150)} | {"aaaa", "?aaa", "//aaaa", "abab"})
    by_value = spark.createDataFrame([("l", "c", 0, v, 1, "href") for v in links], "list_id string, col_key string, col_ord int, v string, n long, attr string")
    kept = spark.createDataFrame([("f", "k", 0, v, 1) for v in values], "feed_id string, key string, key_ord int, v string, one int")
    assert {r["v"] for r in M._link_hits(by_value, kept).collect()} == {x for x in links if any(held(x, v) for v in values)}


def test_long_links_and_images_written_into_the_page(spark):
    images = ["data:image/png;base64," + "A" * 1_000_000 + str(i) for i in range(2)] + ["https://cdn.example.org/a/" + "b" * 100_000 + f"/photo-{i}.jpg" for i in range(2)]
    links = ["https://x.example.org/" + "/".join(f"p{j}" for j in range(2000)) + f"/firm-{i}" for i in range(3)]
    cells = [("l", "img", 0, i, v, "src") for i, v in enumerate(images)] + [("l", "a", 1, i, v, "href") for i, v in enumerate(links)]
    page = spark.createDataFrame(cells, "list_id string, col_key string, col_ord int, row_idx int, value string, attr string")
    feed = spark.createDataFrame([("f", "photo", 0, i, f"https:/{'b' * 10}/photo-{i}.jpg") for i in range(2)] + [("f", "slug", 1, i, f"firm-{i}") for i in range(3)] + [("f", "text", 2, i, "long words " * i * 300) for i in range(9)], "feed_id string, key string, key_ord int, row_idx int, value string")
    began = time.time()
    got = {(r["col_key"], r["key"]): r["score"] for r in M.column_scores(page, feed).collect()}
    assert got[("a", "slug")] == 1.0 and ("img", "text") not in got and time.time() - began < 60


def test_names_that_run_out(spark):
    names = P.unique_names(["Secondary thing"] + ["thing"] * 12)
    assert names[0] == "Secondary thing" and names[-1] == "Additional thing" and names[-2] == "Additional thing"  # the last resort repeats, without a qualifier before the qualifier


def test_rows_up_to_a_limit(spark):
    rows = [(f, page, i) for f, sizes in (("a", [3, 3, 3]), ("b", [7]), ("c", [2, 0, 1])) for page, n in enumerate(sizes) for i in range(n)]
    got = O.capped_rows(spark.createDataFrame(rows, "f string, page int, i int"), ["f"], "page", "i", 5).collect()
    assert sorted(map(tuple, got)) == [r for r in rows if r[:1] != ("a",) or r[1] * 3 + r[2] < 5 if r[0] != "b" or r[2] < 5]


def _stream(spark, folder, frame, name):
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(out, folder, mode):
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def test_attempts_are_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    for day, key in ((1, "a"), (1, "a"), (20, "b"), (25, "b"), (28, "a")):
        frame = spark.createDataFrame(pd.DataFrame({"key": [key], "ok": [False], "ts": [pd.Timestamp(2024, 1, day)]}))
        _run(jobs.attempts(_stream(spark, folder, frame, key), "key", "ok", time="ts", within="10 days"), folder, "update")
    got = [(r["key"], r["attempts"]) for r in spark.read.parquet(f"{folder}/out").orderBy("batch").collect()]
    assert got[:4] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)] and got[-1] == ("a", 1)  # after three weeks a's two attempts are no longer known


def test_attempts_of_many_keys_share_states(spark, tmp_path):
    folder = str(tmp_path)
    for part in range(2):
        rows = spark.range(3000).where(F.col("id") % 3 >= part).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == part).alias("ok"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
        _run(jobs.attempts(_stream(spark, folder, rows.union(rows), part), "key", "ok", most=4, time="ts", within="10 days"), folder, "update")
    got = {(r["key"], r["batch"]): (r["attempts"], r["state"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    first = {(f"k{i}", 0): (2, "pending" if i % 5 else "done") for i in range(3000)}
    last = max(b for _, b in got)
    assert got == first | {(f"k{i}", last): (4, "done" if i % 5 < 2 else "given up") for i in range(3000) if i % 3}
    assert 0 < spark.read.format("statestore").load(f"{folder}/state").count() <= 1024


def test_attempts_in_one_group_are_forgotten_apart(spark, tmp_path):
    folder = str(tmp_path)
    for day, key in ((1, "a"), (8, "b"), (22, "b"), (22, "a"), (23, "b"), (42, None), (42, "b")):
        frame = spark.createDataFrame([(key, day == 8, (pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=day)).to_pydatetime())], "key string, ok boolean, ts timestamp")
        _run(jobs.attempts(_stream(spark, folder, frame, key), "key", "ok", time="ts", within="13 days", groups=1), folder, "update")
    got = [(r["key"], r["attempts"], r["state"]) for r in spark.read.parquet(f"{folder}/out").orderBy("batch").collect()]
    assert got == [("a", 1, "pending"), ("b", 1, "done"), ("b", 2, "done"), ("a", 1, "pending"), ("b", 3, "done"), (None, 1, "pending"), ("b", 1, "pending")]


def test_slices_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    spark.range(600).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    out = jobs._in_parts(spark, str(tmp_path), str(tmp_path / "x"), 0).agg(F.count("*"))
    seen = []
    out.writeStream.foreachBatch(lambda b, n: seen.append(b.first()[0])).outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [100, 200, 300] and len(list((tmp_path / "x" / "events").glob("*.parquet"))) == 3 * spark.sparkContext.defaultParallelism > 3


def test_rows_are_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    for day, key in ((1, "a"), (2, "a"), (20, "b"), (21, "b"), (25, "a")):
        frame = spark.createDataFrame(pd.DataFrame({"key": [key], "ts": [pd.Timestamp(2024, 1, day)]}))
        _run(jobs.first_seen(_stream(spark, folder, frame, key), ["key"], "ts", "10 days"), folder, "append")
    assert [r["key"] for r in spark.read.parquet(f"{folder}/out").orderBy("batch").collect()] == ["a", "b", "a"]


CALLS = []


def one_page(page, base):
    return f'[{{"page": {page}, "base": "{base}"}}]'


def test_slices_go_on_where_a_run_stopped(spark, tmp_path):
    ask = lambda n: jobs.read_slice(spark, "tests.test_scale:one_page", str(tmp_path), n, base="x", pages_a_task=2)
    assert [ask(3), ask(1), ask(4)] == [3, 4, 8]
    rows = spark.read.parquet(f"{tmp_path}/pages").collect()
    assert sorted((r["batch"], r["page"]) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (2, 6), (2, 7)]
    assert all(r["payload"] == one_page(r["page"], "x") for r in rows)


def test_pages_of_a_feed_leave_one_by_one():
    from harrow.sources.feeds import Fetcher, Pages

    parts = list(Fetcher({"fetch": "tests.test_scale:one_page", "base": "x"}).rows(Pages(2, 5)))
    assert [p.to_pylist() for p in parts] == [[{"page": i, "payload": one_page(i, "x")}] for i in (2, 3, 4)]


def test_outlines_say_what_payloads_say(spark):
    import json
    import tracemalloc

    from harrow.functions import records as R

    bodies = [
        {"data": {"list": [{"id": i, "name": f"n{i}", "tags": [{"a": 1, "b": 2}, {"a": 3, "b": None}]} for i in range(3)], "totalCount": 40}, "count": 7},
        [{"id": 1, "total": 9, "x": {"nbHits": 12.0}}, {"id": 2, "total": 10}, "word", None],
        [{"id": 1, "inner": []}, {"id": 2, "inner": [{"p": 1, "q": 2}] * 2}],
        {"nbPages": 3, "hitsPerPage": 20, "hits": [{"nbHits": 5, "k": 1}, {"k": 2, "nbHits": True}]},
        {"total": "12", "rows": [{}, {}, {"a": 1}], "more": [[{"a": 1, "b": 2}, {"a": None, "b": 2}]]}, [], 3, None,
    ]
    texts = [json.dumps(b) for b in bodies] + ['{"a": [{"x": 1, "y": 2, "x": [1]}, {"x": 1, "y": 2}], "a.b": 1}', "[1", ""]
    for text in texts:
        whole, outline = R.parsed(text), R.outlined(text)
        assert [(p, len(r)) for p, r in R.record_sets(whole)] == [(p, len(r)) for p, r in R.record_sets(outline)]
        assert R.total_of(whole, text) == R.total_of(outline, text)
    rows = json.dumps({"rows": [{"id": i, "status": "O"} for i in range(50_000)]})
    got = R.find_record_sets(spark.createDataFrame([(1, rows), (2, texts[0])], "id long, payload string")).collect()
    assert {(r["id"], r["path"], r["size"], r["total"]) for r in got} == {(1, "rows", 50_000, None), (2, "data.list", 3, 40), (2, "data.list.0.tags", 2, 40)}
    tracemalloc.start()
    R.outlined(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(rows)


def test_progress_of_a_job_that_was_cut_off(spark, tmp_path):
    stages = [("rows", lambda _: spark.range(10)), ("half", lambda df: df.where("id % 2 = 0"))]
    jobs.run_job(spark, str(tmp_path), stages, {"half": F.col("id") > 4})
    import shutil

    shutil.rmtree(tmp_path / "rows" / "_counts")  # cut off between the table and its counts
    got = [tuple(r)[1:] for r in jobs.job_progress(spark, str(tmp_path), ["rows", "half", "later"], 12).orderBy("ord").collect()]
    assert got == [("rows", 10, None, 12, 2), ("half", 5, 2, 10, 5), ("later", 0, 0, 5, 5)]
    assert spark.read.parquet(f"{tmp_path}/half").columns == ["id"] and spark.read.parquet(f"{tmp_path}/half").count() == 5


def test_what_is_not_chosen_is_not_read(spark, tmp_path):
    from harrow.plans import finish

    sf = "/root/testdata/sf0.001"
    scan, pages = finish.scanned(spark, sf, "feed")
    plan = lambda choices: finish.final_rows(scan, choices, pages)._jdf.queryExecution().toString()
    bare = plan([c for c in finish.CHOICES if c.name in ("Name", "Nation", "Founded")])  # Founded is off
    assert "MapInPandas" not in bare and "html" not in bare and "c_acctbal" not in bare.split("== Physical Plan ==")[1] and "c_mktsegment" not in bare.split("== Physical Plan ==")[1]
    single = plan([c for c in finish.CHOICES if c.name in ("Name", "Email")])
    assert "MapInPandas" in single and "item_ord" not in single.split("== Physical Plan ==")[1]  # no cells of lists
    empty = finish.final_rows(scan, finish.CHOICES, pages.limit(0))
    assert empty.count() == scan.feed.count() and empty.where("Email <> ''").count() == 0
    crawl = finish.Scan("crawl", crawl=spark.createDataFrame([(1, "x", None), (2, None, "")], "_ord long, name string, __url string"))
    assert [tuple(r) for r in finish.final_rows(crawl, [finish.Choice("N", page="name"), finish.Choice("E", item="Email")], pages).orderBy("_ord").collect()] == [(1, 0, "x", ""), (2, 0, "", "")]


@pytest.mark.parametrize("answer", [None, "", '{"a": 1}', "[1, 2]", 'Sure:\n```json\n{"a": {"b": 2}}\n```\nDone {x', "no {brace", 'text {"k": "}"} end', "{}", '  {"a": 1}  '])
def test_tolerant_json_as_an_expression(spark, answer):
    import json

    from harrow.functions import records as R

    got = spark.createDataFrame([(answer,)], "x string").select(R.tolerant_json(F.col("x"))).first()[0]
    assert (json.loads(got) if got is not None else None) == R.tolerant(answer)


def test_long_pages_are_read_in_pieces():
    """A long page gives the elements of a short one, and little of it is held at a time."""
    import tracemalloc

    from harrow.operators.pages import page_elements

    few = "<main><h1>A &amp; b < c</h1><table><tr><td>x<br>y<td title='<b>'>z</table><!-- <p> --><script>'<p>'</script>" + "<div class='card'><b>a</b><p>b &am" * 3 + "</main>"
    whole = [x for part in page_elements("https://x.org/", few) for x in part]
    assert sorted(x for part in page_elements("https://x.org/", few, long=0, piece=1) for x in part) == whole
    page = "<html><body>" + "<div class='card'><b>name</b><i>role</i></div>" * 25_000 + "</body></html>"
    tracemalloc.start()
    count = sum(len(part) for part in page_elements("https://x.org/", page))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 75_002 and peak < 20_000_000, peak


def test_composed_pages_are_spread(spark):
    """Pages composed from a file that one task reads are parsed in many."""
    from harrow.plans.item_queries import _page

    rows = spark.range(100).coalesce(1)
    assert _page(rows, "id", "<p>", F.col("id"), "</p>").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


@pytest.mark.parametrize("name", ["table_headers", "repeating_ancestors", "people_lists", "labelled_cards", "expanded_texts"])
def test_item_pages_are_parsed_once(spark, name):
    """What reads the elements several times reads them from a table."""
    from harrow import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") <= 1


def test_cells_of_one_file_are_spread_over_tasks(spark, tmp_path):
    """A small file is read by one task, which must not sort or hash all cells of a table."""
    spark.range(1000).selectExpr("id", "cast(id % 7 AS string) AS a").coalesce(1).write.parquet(str(tmp_path / "t"))
    cells = P.long_form(spark.read.parquet(str(tmp_path / "t")), ["id", "a"], "id")
    assert cells.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and cells.count() == 2000


def test_pairs_of_one_file_are_spread_over_tasks(spark, tmp_path):
    """Nearly every line is a pair of its own: no task may hold all pairs of a file."""
    from harrow.plans import model_queries

    spark.range(3000).selectExpr("id % 11 AS l_suppkey", "cast(id % 5 AS int) AS l_linenumber", "id AS l_partkey", "cast(id % 3 AS decimal(15,2)) AS l_discount").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    best = model_queries.strongest_pairs(spark, str(tmp_path))
    assert best.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
    assert {(r["list_id"], r["feed_id"]): (r["col_key"], r["score"]) for r in best.collect()}[(0, 0)] == ("c110", 2.0)


def test_payloads_are_read_in_small_parts(spark):
    """Many payloads in one task: their cells leave some hundred rows at a time, not a batch of ten thousand payloads at once; ids stay whole numbers beside null ones."""
    from harrow.functions import records as R

    big = 2**60 + 1
    body = '{"list": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}'
    rows = spark.range(3000, numPartitions=1).selectExpr("if(id = 7, null, id + %d) AS id" % big).withColumn("payload", F.lit(body))
    sizes = R.find_record_sets(rows).collect()
    assert {r["id"] for r in sizes} == {None, *(big + i for i in range(3000) if i != 7)} and {(r["path"], r["size"], r["total"]) for r in sizes} == {("list", 2, None)}
    parts = R._batched(rows, lambda r: [(r["id"], 1)], "id long, n int").mapInArrow(lambda it: (b.select([0]).slice(0, 1) for b in it), "id long")
    assert R.record_cells(rows).count() == 12000 and parts.count() >= 1
    assert R.total_of({"a": [{"nbHits": 5}]}, '{"a":[{"nb\\u0048its":5}]}') == 5 and R.total_of({"a": [{"nbHits": 5}]}, '{"a":[{"nbHits":5}]}') == 5 and R.total_of({"total": 3}, '{"total":3}') == 3


def test_composed_pages_are_parsed_in_many_tasks(spark, monkeypatch):
    """Customers are one small file: their pages must not be parsed by the one task that reads it."""
    from harrow.operators import company
    from harrow.plans import order_queries

    seen = []
    monkeypatch.setattr(company, "facts", lambda pages: seen.append(pages) or pages.selectExpr("page_id", "'' AS name", "'' AS role", "'' AS email"))
    order_queries.facts(spark, "/root/testdata/sf0.001")
    assert seen[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_people_lists_of_pages_that_pack_small(spark):
    """Elements of like pages are some hundred kilobytes of files, whatever their rows: by that size the driver would gather them."""
    from harrow import registry
    from harrow.operators import items as I
    from harrow.operators import pages as H

    assert broadcasts(registry.QUERIES["people_lists"](spark, "/root/testdata/sf0.001")) == 0
    far = lambda n: "<i>x</i>" * n + "<b class='speaker'>A</b>"
    pages = [(1, f"<p>{far(38)}</p><p>B</p><p>C</p>"), (2, f"<p>{far(40)}</p><p>B</p><p>C</p>"), (3, "<p>A</p><p class='team'>B</p><p>C</p>"), (4, "<p class='person'>A</p><p>B</p><p>C</p>"), (5, "")]
    nodes = H.elements(spark.createDataFrame([(i, "https://x.org/", f"<body><div>{h}</div></body>") for i, h in pages], "page_id long, url string, html string"))
    lists = H.sibling_lists(nodes).where("sig LIKE 'p%'").unionByName(spark.sql("SELECT 6L AS page_id, 0 AS parent, 'p' AS sig, 3L AS items, 7 AS first, 9 AS last, false AS chrome"))
    got = {r["page_id"]: r["people"] for r in I.people_lists(nodes, lists).collect()}
    assert got == {1: True, 2: False, 6: False}


def test_labelled_cards_of_pages_that_pack_small(spark):
    from harrow import registry
    from harrow.operators import items as I
    from harrow.operators import pages as H

    assert broadcasts(registry.QUERIES["labelled_cards"](spark, "/root/testdata/sf0.001")) == 0
    card = lambda name, inner: f"<div data-testid='{name}'>{inner}</div>"
    two = "<b>A</b><i>B</i>"
    pages = [(1, card("wrap", card("one", two) * 2) + card("one", card("one", two))), (2, card("lone", "<b>A</b>") + card("lone", two)), (3, card("rich", two) + card("rich", ""))]
    nodes = H.elements(spark.createDataFrame([(i, "https://x.org/", f"<body>{h}</body>") for i, h in pages], "page_id long, url string, html string"))
    got = sorted((r["page_id"], r["label"], r["node"]) for r in I.labelled_cards(nodes).collect())
    assert got == [(1, '[data-testid="one"]', 2), (1, '[data-testid="one"]', 5), (1, '[data-testid="one"]', 8), (3, '[data-testid="rich"]', 1), (3, '[data-testid="rich"]', 4)]


def test_item_pages_of_pages_that_pack_small(spark):
    from harrow import registry

    pages = registry.QUERIES["item_pages"](spark, "/root/testdata/sf0.001")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert broadcasts(pages) == 0 and "InPandas" not in plan and "ArrowEvalPython" not in plan  # lists, chosen in Python, are read from a table


def test_table_headers_of_odd_pages(spark):
    """Parts of tables read while parsing give the headers that the elements give: nested tables, heads further down, rows without a table, cells without a row, empty heads."""
    from harrow.operators import items as I
    from harrow.operators import pages as H

    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    inner = f"<table class='in'>{row('x', 'y')}{row(1, 2)}</table>"
    pages = [
        f"<table>{row('a', 'b')}{row(inner, 'c')}{row('d')}</table>", f"<table>{row(1)}<thead><tr><th>H</th><td><b>I</b> J</td></tr></thead>{row(2)}</table>", f"<div>{row('a')}{row('b')}<td>lone</td></div><table><td>no row</td></table>",
        f"<table>{row('', '')}{row(1, 2)}</table>", f"<table><thead><tr><td>{inner}</td></tr></thead>{row(3)}</table>", "", None, f"<table><tr class='q'><th data-testid='k'>K</th><th></th></tr>{row(1, 2, 3)}</table>",
    ]
    frame = spark.createDataFrame([(i, f"https://x.org/{i}", h) for i, h in enumerate([*pages, *pages, "<table>" + row("a") + row("b") * 60_000 + "</table>"])], "page_id long, url string, html string").coalesce(1)
    of_parts = I.headers_of(H.table_parts(frame))
    got = sorted(map(tuple, of_parts.collect()))
    assert got == sorted(map(tuple, I.table_headers(H.elements(frame)).collect()))
    assert [(p, c, h) for p, _, c, h in got if p in (1, 7)] == [(1, 0, "H"), (1, 1, "I J")] * 2 + [(7, 0, "K"), (7, 1, "")] and sum(p == 16 for p, *_ in got) == 60_000
    assert {h for p, _, _, h in got if p == 0} == {"a", "b", "x", "y"} and not {2, 3, 5, 6} & {p for p, *_ in got}
    assert I.headers_of(H.table_parts(frame))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pages_of_the_same_text_are_parsed_once(spark):
    from harrow.operators import pages as H

    folder = spark.createDataFrame([(i if i else None, f"https://x.org/{i % 2}/", f"<p><a href='a'>{i % 3}</a></p>" if i % 5 else None) for i in range(3000)], "page_id long, url string, html string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)
    schema, kinds = H._SCHEMA, H.NODES
    page_elements = H.page_elements

    def counted(base, html):
        calls.add(1)
        return page_elements(base, html)

    got = H._parsed(folder, "html", counted, schema, kinds, True, 50).collect()
    want = [(i if i else None, *x) for i in range(3000) if i % 5 for part in page_elements(f"https://x.org/{i % 2}/", f"<p><a href='a'>{i % 3}</a></p>") for x in part]
    assert [tuple(r) for r in got] == [tuple(x) for x in want] and calls.value == 8
