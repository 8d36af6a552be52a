"""The plan's rules, feeds and writers over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.functions import web as W
from harrow.functions.text import carries_secret, is_junk
from harrow.operators import catalog as K
from harrow.operators import model as M
from harrow.operators import ordering as O
from harrow.operators import pages as H
from harrow.operators import profiling as P
from harrow.operators.assembly import lead_names
from harrow.operators.company import guarded
from harrow.session import spread, table
from harrow.sources import feeds, sinks
from harrow.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SLOTS = "s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS a, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE '' END AS b FROM customer)"


def _slots(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(k % 3 > 0, F.col("c_name")).alias("a"), F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("").alias("b"))


@query(f"WITH {_SLOTS} SELECT c_custkey, a, b FROM s WHERE coalesce(a, '') <> '' OR b <> ''")
def visible_rows(spark, sf_dir):
    return M.visible_rows(_slots(spark, sf_dir), ["a", "b"]).select("c_custkey", "a", "b")


@query(f"WITH {_SLOTS} SELECT c_nationkey, count(*) FILTER (WHERE coalesce(a, '') <> '') AS shown, count(*) AS without_columns FROM s GROUP BY 1")
def list_row_count(spark, sf_dir):
    rows = _slots(spark, sf_dir)
    return rows.groupBy("c_nationkey").agg(F.count_if(M.has_content(["a"])).alias("shown"), F.count_if(M.has_content([])).alias("without_columns"))


@query(
    """WITH c AS (SELECT p_type AS name, count(*) > 1 AS "on", CASE WHEN min(p_size) % 3 > 0 OR count(*) > 5 THEN p_type END AS page_key, CASE WHEN max(p_size) % 2 = 0 THEN p_type END AS feed_key FROM (SELECT p_brand || ' ' || p_type AS p_type, p_size FROM part) GROUP BY p_type) SELECT name FROM c WHERE "on" AND page_key IS NOT NULL AND feed_key IS NULL"""
)
def page_only_columns(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("name")).agg((F.count("*") > 1).alias("on"), F.min("p_size").alias("a"), F.max("p_size").alias("b"), (F.count("*") > 5).alias("many"))
    columns = c.withColumns({"page_key": F.when((F.col("a") % 3 > 0) | F.col("many"), F.col("name")), "feed_key": F.when(F.col("b") % 2 == 0, F.col("name"))})
    return M.page_only(columns).select("name")


@query(
    """WITH p AS (SELECT l_suppkey AS list_id, l_linenumber AS feed_id, l_partkey AS col_ord, max(l_discount)::DOUBLE AS score FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY list_id, feed_id ORDER BY score DESC, col_ord) AS r FROM p) SELECT list_id, feed_id, 'c' || col_ord AS col_key, score FROM r WHERE r = 1"""
)
def strongest_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("list_id"), F.col("l_linenumber").alias("feed_id"), F.col("l_partkey").alias("col_ord"), "l_discount")
    matches = spread(lines, "list_id", "feed_id", each=16)  # nearly every line is a pair of its own: a task holds all that it gets
    pairs = matches.groupBy("list_id", "feed_id", "col_ord").agg(F.max("l_discount").cast("double").alias("score"))
    return M.anchors(pairs.withColumns({"col_key": F.concat(F.lit("c"), "col_ord"), "key": F.concat(F.lit("k"), "col_ord")})).select("list_id", "feed_id", "col_key", "score")


@query(
    "SELECT count(*) AS looked, count(*) FILTER (WHERE c_custkey % 3 > 0) AS website, count(*) FILTER (WHERE c_custkey % 4 > 0) AS person, count(*) FILTER (WHERE c_custkey % 4 > 0 AND c_custkey % 5 = 0) AS email, count(*) FILTER (WHERE c_custkey % 7 = 0 OR (c_custkey % 4 > 0 AND c_custkey % 11 = 0)) AS linkedin FROM customer"
)
def trial_summary(spark, sf_dir):
    k = F.col("c_custkey")
    one = F.struct(F.when(k % 5 == 0, F.concat(F.lit("c"), k, F.lit("@x.org"))).alias("email"), F.when(k % 11 == 0, F.lit("https://www.linkedin.com/in/x")).otherwise("").alias("linkedin"))
    found = table(spark, sf_dir, "customer").select(F.when(k % 3 > 0, F.col("c_name")).alias("website"), F.when(k % 4 > 0, F.array(one)).when(k % 8 == 0, F.array().cast("array<struct<email:string,linkedin:string>>")).alias("people"), F.when(k % 7 == 0, F.lit("https://www.linkedin.com/company/x")).alias("company_linkedin"))
    return M.trial_summary(found)


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey % 3 = 0) AS with_email FROM customer")
def finish_line(spark, sf_dir):
    k, mail = F.col("c_custkey"), F.concat(F.lit("c"), "c_custkey", F.lit("@x.org"))
    rows = table(spark, sf_dir, "customer").select("c_name", F.when(k % 3 == 0, mail).alias("Mail"), F.when(k % 2 == 0, mail).alias("Mail (source)"), mail.alias("Confidence"))
    return M.finish_line(rows)


_FEED = "p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, (o_orderkey % 11)::BIGINT AS rows FROM orders)"


def _feed(spark, sf_dir) -> DataFrame:
    number = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", number.alias("page"), (F.col("o_orderkey") % 11).alias("rows"))


@query(f"WITH {_FEED}, b AS (SELECT *, coalesce(sum(rows) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT o_custkey, page::BIGINT AS page, rows FROM b WHERE before < 46")
def early_stop(spark, sf_dir):
    return M.early_stop(_feed(spark, sf_dir), ["o_custkey"], M.rows_to_fetch(5))


@query(f"WITH {_FEED}, d AS (SELECT o_custkey, max(page) AS done FROM p WHERE page < 3 AND o_custkey % 3 > 0 GROUP BY 1), l AS (SELECT p.*, row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS r FROM p LEFT JOIN d USING (o_custkey) WHERE page > coalesce(done, -1)) SELECT o_custkey, page::BIGINT AS page, rows FROM l WHERE r <= 2")
def next_pages(spark, sf_dir):
    p = _feed(spark, sf_dir)
    return M.next_pages(p, p.where("page < 3 AND o_custkey % 3 > 0"), ["o_custkey"], 2).select("o_custkey", "page", "rows")


@query(
    """WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS rows FROM orders),
       m AS (SELECT *, sum(rows) OVER (PARTITION BY o_custkey ORDER BY batch)::BIGINT AS resume, rows = 0 AND lag(rows, 1) OVER w = 0 AND lag(rows, 2) OVER w = 0 AS stalled FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY batch))
       SELECT o_custkey, batch::INTEGER AS batch, rows, resume, coalesce(stalled, false) AS stalled FROM m WHERE batch <= coalesce((SELECT min(batch) FROM m x WHERE x.o_custkey = m.o_custkey AND x.stalled), 1000000)"""
)
def no_progress(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    batches = table(spark, sf_dir, "orders").select("o_custkey", number.alias("batch"), F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(0).alias("rows"))
    return M.until_no_progress(batches, ["o_custkey"]).select("o_custkey", "batch", "rows", "resume", "stalled")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Data' WHEN 1 THEN upper(left(event_type, 1)) || substr(event_type, 2) ELSE 'Shop' END AS title FROM events"""
)
def feed_titles(spark, sf_dir):
    k = F.col("event_id") % 3
    path = F.when(k == 0, "data.list").when(k == 1, F.concat(F.lit("data."), "event_type", F.lit(".0.results"))).otherwise("items")
    address = F.when(k == 2, F.lit("GET https://www.x.org/shop/v2/12")).otherwise("POST /api/v1/search")
    return table(spark, sf_dir, "events").select("event_id", M.feed_title(path, address).alias("title"))


@query("SELECT o_orderkey AS _ord, o_orderstatus AS status, NULL::VARCHAR AS priority FROM orders UNION ALL SELECT c_custkey + (SELECT max(o_orderkey) + 1 FROM orders), NULL, c_name FROM customer")
def appended_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_ord"), F.col("o_orderstatus").alias("status"))
    return M.appended(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_ord"), F.col("c_name").alias("priority"))).select("_ord", "status", "priority")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS h FROM documents")
def item_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(M.item_norm("text"), 256).alias("h"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.x' || page_id || '.org/a' WHEN 2 THEN 'https://y' || page_id || '.co.uk' END AS found FROM pages")
def url_in(spark, sf_dir):
    k = F.col("page_id") % 4
    said = F.when(k == 0, F.concat(F.lit("look at ("), "url", F.lit("), please"))).when(k == 1, F.concat(F.lit("see www.x"), "page_id", F.lit(".org/a."))).when(k == 2, F.concat(F.lit("y"), "page_id", F.lit(".co.uk! and z.com"))).otherwise("no address, 3.14 or a.b")
    return table(spark, sf_dir, "pages").select("page_id", M.url_in(said).alias("found"))


@query("SELECT c_nationkey, ceil(count(*) * 13 / 12.0)::BIGINT + 5 AS seconds FROM customer GROUP BY 1")
def estimate_seconds(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", M.estimate_seconds("n").alias("seconds"))


@query(r"""SELECT o_orderkey AS _ord, '  {' || chr(10) || '    "status": "' || o_orderstatus || '",' || chr(10) || '    "said \"so\"": ' || CASE WHEN o_orderkey % 3 = 0 THEN '""' ELSE '"a\"' || o_orderkey || '"' END || ',' || chr(10) || '    "key": ' || o_custkey || chr(10) || '  }' || CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN '' ELSE ',' END AS line FROM orders UNION ALL SELECT NULL, '[' UNION ALL SELECT NULL, ']'""")
def json_array(spark, sf_dir):
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(k % 3 > 0, F.concat(F.lit('a"'), k)).alias('said "so"'), F.col("o_custkey").alias("key"))
    return sinks.json_array(df, ["status", 'said "so"', "key"], "o_orderkey").select("_ord", "line")


_Q = "chr(34)"


@query(
    f"SELECT p_partkey AS _ord, p_partkey || ',' || CASE WHEN p_partkey % 4 = 0 THEN {_Q} || p_name || ', ' || {_Q} || {_Q} || 'x' || {_Q} || {_Q} || {_Q} WHEN p_partkey % 4 = 1 THEN chr(39) || '=' || p_name ELSE p_name END || ',' || CASE WHEN p_partkey % 5 > 0 THEN p_size::VARCHAR ELSE '' END AS line FROM part UNION ALL SELECT NULL, chr(65279) || 'p_partkey,name,size'"
)
def csv_lines(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat("p_name", F.lit(', "x"'))).when(k % 4 == 1, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(k % 5 > 0, F.col("p_size")).alias("size"))
    return sinks.csv_lines(df, ["p_partkey", "name", "size"], "p_partkey").select("_ord", "line")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS name, c_nationkey AS nation FROM customer")
def json_round_trip(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    path = f"{jobs.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write("json", df, path, ["id", "name", "nation"], "id")
    return feeds.read_json_lines(spark, path, f"id long, name string, nation {dict(df.dtypes)['nation']}")


@query("SELECT o_custkey AS c_custkey, count(*) AS orders, max(o_orderkey) AS newest FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING count(*) > 1")
def staged_job(spark, sf_dir):
    folder = f"{jobs.shared_folder(spark)}/job-{uuid.uuid4().hex}"
    stages = [
        ("rows", lambda _: table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")),
        ("people", None),
        ("grouped", lambda before: before.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("newest"))),
    ]
    jobs.run_job(spark, folder, stages)
    again = jobs.run_job(spark, folder, stages[:2] + [("grouped", None)])  # what is there is read, not built again
    assert again.columns == ["o_custkey", "o_orderkey"]
    return jobs.run_job(spark, folder, [*stages, ("several", lambda before: before.where("orders > 1"))])


@query(
    """WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'), g AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1), c AS (SELECT (SELECT count(*) FROM orders) AS every, (SELECT count(*) FROM o) AS rows, (SELECT count(*) FROM o WHERE o_orderkey % 7 = 0) AS failed, (SELECT count(*) FROM g) AS grouped, (SELECT count(*) FROM g WHERE n = 1) AS single)
       SELECT unnest(['rows', 'grouped', 'people']) AS stage, unnest([rows, grouped, 0]) AS rows, unnest([failed, single, 0]) AS failed, unnest([every, rows, grouped]) AS "of", unnest([every - rows, greatest(rows - grouped, 0), grouped]) AS "left" FROM c"""
)
def staged_progress(spark, sf_dir):
    folder = f"{jobs.shared_folder(spark)}/job-{uuid.uuid4().hex}"
    every = table(spark, sf_dir, "orders")
    stages = [("rows", lambda _: every.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")), ("grouped", lambda before: before.groupBy("o_custkey").agg(F.count("*").alias("orders")))]
    jobs.run_job(spark, folder, stages, {"rows": F.col("o_orderkey") % 7 == 0, "grouped": F.col("orders") == 1})
    return jobs.job_progress(spark, folder, ["rows", "grouped", "people"], every.count()).select("stage", "rows", "failed", "of", "left")


@query("SELECT min(page_id) AS page_id, regexp_extract(url, '^[^?#]*') AS address FROM pages GROUP BY 2")
def unique_addresses(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("address"))
    return O.distinct_rows(p, ["address"], ["page_id"])


@query(f"WITH {_FEED}, t AS (SELECT *, sum(rows) OVER (PARTITION BY o_custkey ORDER BY page) AS so_far FROM p), d AS (SELECT *, rows = 0 OR so_far >= 20 OR page + 1 >= 2000 AS done FROM t) SELECT o_custkey, page::BIGINT AS page, rows, done FROM d WHERE page <= coalesce((SELECT min(page) FROM d e WHERE e.o_custkey = d.o_custkey AND e.done), 1000000)")
def row_cap(spark, sf_dir):
    none = F.lit(None).cast("long")
    return O.stop_rule(_feed(spark, sf_dir).withColumns({"total": none, "cap": none}), ["o_custkey"], max_rows=20).select("o_custkey", "page", "rows", "done")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN 12 WHEN 2 THEN 3 * event_id END AS total, CASE WHEN event_id % 5 = 3 THEN user_id END AS cap FROM events")
def stated_totals(spark, sf_dir):
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.format_string('{"hits":[{"nbHits":1}],"nbHits":%d}', "user_id")).when(k == 1, F.lit('{"count":12,"rows":[{"total":5}]}')).when(k == 2, F.format_string('{"a":{"nbPages":3,"hitsPerPage":%d}}', "event_id")).when(k == 3, F.format_string('{"x":[{"paginationLimitedTo":%d}]}', "user_id")).otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", R.stated_total(body).alias("total"), R.number_in(body, ["paginationLimitedTo"]).alias("cap"))


@query("SELECT count(*) AS datasets, max(n) AS most FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def dataset_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    body = F.format_string('{"page":%d,"supplier":%d}', F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("long"))
    url = F.concat(F.lit("https://x.org/list?t="), F.col("l_orderkey").cast("string"))
    keyed = li.select(R.dataset_key(F.lit("POST"), url, body, F.concat(F.lit("data."), "l_returnflag")).alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("n")).agg(F.count("*").alias("datasets"), F.max("n").alias("most"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'body_nested_offset' WHEN 1 THEN 'body_params_page' ELSE 'body_page' END AS style, CASE event_id % 3 WHEN 0 THEN 'query.paging.offset' WHEN 1 THEN 'requests.0.params' ELSE 'p' END AS path, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN 4 ELSE event_id END AS first, CASE event_id % 3 WHEN 0 THEN 25 WHEN 1 THEN 1000 END AS page_size FROM events")
def body_paging(spark, sf_dir):
    k = F.col("event_id") % 3
    nested, search, plain = F.format_string('{"query":{"paging":{"offset":%d,"limit":25}}}', "user_id"), F.lit('{"requests":[{"params":"query=x&page=4&hitsPerPage=20"}]}'), F.format_string('{"p":%d}', "event_id")
    p = R.detect_paging(F.lit("https://x.org/list?page=1"), F.when(k == 0, nested).when(k == 1, search).otherwise(plain))
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.style", "p.path", "p.first", "p.page_size")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS k FROM events")
def tolerant_json(spark, sf_dir):
    k = F.col("event_id") % 3
    answer = F.when(k == 0, F.format_string('Here you are:\n```json\n{"k": %d}\n``` Hope it helps {or not', "user_id")).when(k == 1, F.format_string('{"k":%d}', "user_id")).otherwise("no object {here")

    found = R.tolerant_json(F.regexp_replace(answer, r" Hope.*", ""))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, 'accept,x-' || c_custkey AS kept FROM customer")
def clean_headers(spark, sf_dir):
    h = F.create_map(F.lit("Accept"), F.lit("a"), F.lit("Host"), F.lit("b"), F.lit(":path"), F.lit("/"), F.lit("Cookie"), F.lit("c"), F.concat(F.lit("X-"), "c_custkey"), F.lit("d"), F.lit("Keep-Alive"), F.lit("1"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.array_join(F.array_sort(F.map_keys(K.clean_headers(h))), ",")).alias("kept"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'next' WHEN 2 THEN 'more' END AS control, CASE page_id % 4 WHEN 0 THEN '/p/' || page_id WHEN 1 THEN '/n' WHEN 2 THEN '' END AS href FROM pages WHERE page_id % 4 < 3")
def next_controls(spark, sf_dir):
    k = F.col("page_id") % 4
    own = F.when(k == 0, F.concat(F.lit('<a href="/m">Load more</a><a href="/p/'), "page_id", F.lit('">Weiter &raquo; ›</a><a href="/q">next</a>'))).when(k == 1, F.lit('<button disabled>Next</button><a href="/n" aria-label="Go to next page"><b>2</b></a>')).when(k == 2, F.lit('<button>Show more</button><a href="/z">Load more</a>')).otherwise('<a href="/x">Next week</a>')
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace(own, "&raquo;", "»").alias("html"))
    return H.next_links(H.controls(p))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'https://shop' || page_id || '.example.org' END AS website, CASE WHEN page_id % 2 = 0 THEN 'https://www.linkedin.com/company/c' || page_id END AS linkedin FROM pages WHERE page_id % 6 NOT IN (7)")
def profile_links(spark, sf_dir):
    k = F.col("page_id")
    site = F.concat(F.lit('<a href="https://fonts.gstatic.com/x">Website</a><a href="https://other.example.net/a">Other</a>'), F.when(k % 3 > 0, F.concat(F.lit('<a href="https://shop'), k, F.lit('.example.org/start?x=1">'), F.when(k % 3 == 1, F.lit("Website")).otherwise(F.concat(F.lit("www.shop"), k, F.lit(".example.org"))), F.lit("</a>"))).otherwise(""))
    profile = F.when(k % 2 == 0, F.concat(F.lit('<a href="https://de.linkedin.com/company/c'), k, F.lit('?x">in</a>'))).otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("https://fair.example.com/").alias("url"), F.concat(site, profile).alias("html"))
    return H.profile_links(H.anchors(p))


@query("WITH f AS (SELECT l_suppkey AS page_id, 't:' || l_returnflag || l_linenumber AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, page_id) AS r FROM f WHERE n >= 2) SELECT feature, page_id, n FROM r WHERE r = 1")
def deepest_pages(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("page_id"), F.concat(F.lit("t:"), "l_returnflag", "l_linenumber").alias("feature")).agg(F.count("*").alias("n"))
    return H.deepest_pages(f)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'CEO' END AS role_raw, CASE WHEN c_custkey % 4 IN (0, 2) THEN 'anna.meier@x' || c_custkey || '.org' END AS email FROM customer WHERE c_custkey % 4 < 3")
def borne_out(spark, sf_dir):
    k = F.col("c_custkey")
    mail = F.concat(F.lit("anna.meier@x"), k, F.lit(".org"))
    page = F.when(k % 4 == 0, F.concat(F.lit("Our CEO Anna Meier. Mail: "), mail)).when(k % 4 == 1, F.lit("Anna Meier is our CEO")).when(k % 4 == 2, F.concat(F.lit("The CEO left. Anna Meier, "), mail)).otherwise("Nobody here")
    said = F.when(k % 4 == 1, F.lit("info@x.org")).otherwise(mail)
    p = table(spark, sf_dir, "customer").select("c_custkey", F.lit("Anna Meier").alias("name"), F.lit("CEO").alias("role_raw"), said.alias("email"), page.alias("page_text"))
    return guarded(p).select("c_custkey", "role_raw", "email")


@query("SELECT p_partkey, true AS own, false AS other FROM part")
def appears_in(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", W.appears_in(F.concat(F.lit("Das  Stück "), "p_name"), F.upper(F.concat(F.lit("stuck "), "p_name"))).alias("own"), W.appears_in("p_name", F.concat("p_name", F.lit("x"))).alias("other"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a' || page_id || '.example.org|http://b.example.org' ELSE 'https://a' || page_id || '.example.org' END AS sites FROM pages")
def sites_in_text(spark, sf_dir):
    k = F.col("page_id")
    said = F.concat(F.lit("(https://a"), k, F.lit(".example.org/x), https://www.linkedin.com/in/q and https://a"), k, F.lit(".example.org/y"), F.when(k % 2 == 0, F.lit(" or http://b.example.org/1?z.")).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(W.sites_in(said), "|").alias("sites"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '+49 30 ' || (o_custkey + 1000000) WHEN 1 THEN '(0171) 55' || (o_custkey + 10000) END AS phone FROM orders")
def phones_in(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("call +49 30 "), c + 1000000, F.lit(" now"))).when(k % 3 == 1, F.concat(F.lit("Tel. (0171) 55"), c + 10000, F.lit("; fax"))).otherwise(F.lit("order 12345"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(W.phones_in(said), 0).alias("phone"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://www.linkedin.com/in/c' || c_custkey WHEN 1 THEN 'https://www.linkedin.com/company/c' || c_custkey END AS linkedin, c_custkey % 4 < 2 AS same FROM customer")
def profiles_and_sites(spark, sf_dir):
    k = F.col("c_custkey")
    href = F.when(k % 3 == 0, F.concat(F.lit("//de.linkedin.com/IN/c"), k, F.lit("/?trk=1"))).when(k % 3 == 1, F.concat(F.lit("http://linkedin.com/company/c"), k, F.lit("#x"))).otherwise("https://notlinkedin.com/in/x")
    other = F.when(k % 4 == 0, F.lit("https://www.shop.org/a")).when(k % 4 == 1, F.lit("http://de.shop.org")).when(k % 4 == 2, F.lit("https://myshop.org")).otherwise("no address")
    return table(spark, sf_dir, "customer").select("c_custkey", W.clean_linkedin(href).alias("linkedin"), W.same_site(other, F.lit("https://shop.org/")).alias("same"))


@query("SELECT c_custkey, c_custkey % 4 < 3 AS secret, c_custkey % 2 = 0 AS junk FROM customer")
def secrets_and_junk(spark, sf_dir):
    k, secret = F.col("c_custkey"), "p@ss \"w\"/1"
    request = F.when(k % 4 == 0, F.lit(f"x={secret}")).when(k % 4 == 1, F.lit("x=p%40ss%20%22w%22%2F1")).when(k % 4 == 2, F.lit('{"x":"p@ss \\"w\\"/1"}')).otherwise("x=p@ss")
    word = F.when(k % 2 == 0, F.lit("Show more")).otherwise(F.concat(F.lit("show more of "), k))
    return table(spark, sf_dir, "customer").select("c_custkey", carries_secret(request, secret).alias("secret"), is_junk(word).alias("junk"))


@query(
    """WITH f AS (SELECT o_custkey AS feed_id, count(*) AS rows, o_custkey % 5 = 0 AS facet, o_custkey % 7 = 0 AS matched, o_custkey % 3 AS fields FROM orders GROUP BY 1),
       k AS (SELECT *, row_number() OVER (ORDER BY feed_id) AS r FROM f WHERE NOT matched AND NOT facet AND fields > 0 AND rows >= 3) SELECT feed_id FROM k WHERE r <= 6"""
)
def other_feeds(spark, sf_dir):
    k = F.col("o_custkey")
    f = table(spark, sf_dir, "orders").groupBy(k.alias("feed_id")).agg(F.count("*").alias("rows"))
    k = F.col("feed_id")
    listed = f.select("feed_id", k.alias("_ord"), F.when(k % 5 == 0, "data.facets").otherwise("data.list").alias("json_path"), F.lit("/api/search").alias("endpoint"), "rows")
    names = F.when(k % 3 == 0, F.array(F.lit("name"), F.lit("count"))).otherwise(F.array(F.lit("name"), F.lit("stand"), F.lit("country"), F.lit("id")))
    fields = f.select("feed_id", F.explode(names).alias("key")).withColumns({"plumbing": F.col("key") == "id", "fill": F.lit(0.9)})
    return K.other_feeds(listed, fields, f.where("feed_id % 7 = 0").select("feed_id")).select("feed_id")


@query(
    """WITH c AS (SELECT l_suppkey AS list_id, l_linenumber AS col_ord, min(l_quantity) / 50.0 AS fill, l_linenumber % 3 = 0 AS link, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem GROUP BY 1, 2),
       u AS (SELECT *, fill >= 0.5 AND (NOT link OR n <= 3) AS useful FROM c), p AS (SELECT *, sum(useful::INT) OVER (PARTITION BY list_id ORDER BY col_ord) AS place, bool_or(useful) OVER (PARTITION BY list_id) AS has_some, row_number() OVER (PARTITION BY list_id ORDER BY col_ord) AS r FROM u)
       SELECT list_id, col_ord, (useful AND place <= 2) OR (NOT has_some AND r = 1) AS "on" FROM p"""
)
def open_columns(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("list_id"), F.col("l_linenumber").alias("col_ord")).agg((F.min("l_quantity") / 50.0).alias("fill"))
    return K.open_columns(c.withColumn("attr", F.when(F.col("col_ord") % 3 == 0, "link").otherwise("own")), 2).select("list_id", "col_ord", "on")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Stand number' WHEN 1 THEN 'Exhibitor' WHEN 2 THEN 'Title 2' ELSE 'Column' END AS name FROM customer")
def best_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    page = F.when(k == 0, "Text").when(k == 1, "Exhibitor").when(k == 2, "Title 2").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", K.best_name(page, F.when(k == 0, "data.standNumber").when(k == 1, "x_y")).alias("name"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Country' WHEN 1 THEN 'Designation' WHEN 2 THEN 'Image' WHEN 3 THEN 'Company' END AS hint, CASE n_nationkey % 5 WHEN 0 THEN 'Country' WHEN 1 THEN 'Email' WHEN 2 THEN 'Stand' WHEN 3 THEN 'Date' ELSE 'Price' END AS type FROM nation")
def hints_and_types(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    n = table(spark, sf_dir, "nation")
    hook = F.when(k == 0, "cardCountry-x").when(k == 1, "job-role").when(k == 2, "x_logo").when(k == 3, "brandName").otherwise("abc")
    value = F.when(k == 0, "Vereinigtes Königreich").when(k == 1, F.concat(F.lit("n"), "n_nationkey", F.lit("@x.org"))).when(k == 2, F.concat(F.lit("Stand "), "n_nationkey")).when(k == 3, "3 Feb 2024").otherwise("12,50 €")
    cells = n.select("n_nationkey", F.explode(F.array_repeat(value, 5)).alias("value"))
    types = K.value_type(cells, ["n_nationkey"]).select("n_nationkey", "type")
    return n.select("n_nationkey", K.hint_of(F.when(k == 3, F.lit("brand-x")).otherwise(hook)).alias("hint")).join(types, "n_nationkey")


@query("SELECT c_custkey, c_name AS \"Website\", 'w' || c_custkey AS \"Website (lookup)\", 'e' || c_custkey AS \"Company email\" FROM customer")
def lead_column_names(spark, sf_dir):
    names = lead_names(["c_custkey", "website"], ["Website", "Company email"])
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Website"), F.concat(F.lit("w"), "c_custkey").alias(names["Website"]), F.concat(F.lit("e"), "c_custkey").alias(names["Company email"]))


@query(
    "SELECT o_orderkey, 'Title|Subtitle|' || o_orderstatus || '|Link|Page link|Secondary ' || lower(o_orderstatus) AS names FROM orders"
)
def unique_names(spark, sf_dir):
    given = F.array(F.lit("Title"), F.lit("title 2"), F.col("o_orderstatus"), F.lit("Link"), F.lit("Link"), F.concat(F.col("o_orderstatus"), F.lit(" 7")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.unique_names_of(given), "|").alias("names"))


@query(
    """WITH s AS (SELECT l_returnflag AS field, CASE WHEN l_linenumber % 2 = 0 THEN 'l' || l_linenumber END AS list_id, l_suppkey AS page_id, count(*) AS n, max(l_quantity)::VARCHAR AS value FROM lineitem GROUP BY 1, 2, 3),
       g AS (SELECT field, list_id, count(*) AS hits, max(n) AS most, min(value) AS a, max(value) AS b, list_id = 'l2' AS p FROM s GROUP BY field, list_id)
       SELECT field, list_id, hits, list_id IS NOT NULL OR hits >= 2 AS suggested FROM g WHERE NOT (list_id IS NOT NULL AND most < 2 AND NOT p) AND NOT (hits > 1 AND a = b)"""
)
def item_fields(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    list_id = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("l"), "l_linenumber"))
    seen = li.groupBy(F.col("l_returnflag").alias("field"), list_id.alias("list_id"), F.col("l_suppkey").alias("page_id")).agg(F.count("*").alias("count"), F.max("l_quantity").cast("string").alias("value"))
    seen = seen.withColumns({"attr": F.lit("own"), "sample": F.concat(F.lit("v"), "value")})
    people = spark.createDataFrame([("l2",)], "list_id string")
    return K.merge_item_fields(seen, people, 10, 1000).select("field", "list_id", "hits", "suggested")


@query("SELECT CASE WHEN coalesce(avg(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 2 = 0)::INT END), 1.0) >= 0.6 THEN 'static' ELSE 'browser' END AS mode FROM customer")
def reading_mode(spark, sf_dir):
    k = F.col("c_custkey")
    return K.reading_mode(table(spark, sf_dir, "customer").select((k % 3 > 0).alias("suggested"), (k % 2 == 0).alias("static_ok")))


@query("WITH n AS (SELECT l_suppkey, count(*) AS total, ceil(count(*) / 7.0)::BIGINT AS pages FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN pages >= 3 THEN array_to_string(list_sort(list_distinct([pages // 3, pages * 2 // 3, pages - 1])), ',') ELSE '' END AS wider FROM n")
def wider_pages(spark, sf_dir):
    feeds_ = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return feeds_.select("l_suppkey", F.array_join(K.wider_pages_of(F.col("n"), F.lit(7)).cast("array<string>"), ",").alias("wider"))


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_orderstatus || o_custkey AS name, 1 AS updated FROM orders), n AS (SELECT 2 * c_custkey AS id, lower('F' || c_custkey) AS name, 2 AS updated FROM customer),
       a AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM n) AND lower(name) NOT IN (SELECT name FROM n) UNION ALL SELECT * FROM n)
       SELECT * FROM a ORDER BY updated DESC, id LIMIT 1000"""
)
def saved_recipes(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", "o_custkey").alias("name"), F.lit(1).alias("updated"))
    new = table(spark, sf_dir, "customer").select((2 * F.col("c_custkey")).alias("id"), F.concat(F.lit("f"), "c_custkey").alias("name"), F.lit(2).alias("updated"))
    return M.saved_recipes(saved, new, 1000)


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS row, unnest(['n_nationkey', 'n_name']) AS key, unnest([n_nationkey::VARCHAR, n_name]) AS value FROM nation")
def json_address(spark, sf_dir):
    path = f"{jobs.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    sinks.write("json-array", table(spark, sf_dir, "nation").coalesce(1), path, ["n_nationkey", "n_name"], "n_nationkey")
    return feeds.read_json_documents(spark, path).select("row", "key", "value")


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin, unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)"', 1)) AS href FROM pages) SELECT page_id, origin || replace(href, '&amp;', '&') AS link FROM a""")
def element_links(spark, sf_dir):
    nodes = H.elements(table(spark, sf_dir, "pages"))
    return nodes.where("tag = 'a' AND element_at(sigs, -2) = 'li'").select("page_id", "link")


@query("SELECT c_custkey, sha256(c_name) AS h FROM customer")
def hashed_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"))
