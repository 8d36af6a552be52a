"""Matching, assembling and profiling over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import norm, text
from harrow.operators import assembly as A
from harrow.operators import matching as M
from harrow.operators import profiling as P
from harrow.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cells(df: DataFrame, id: str, columns: list[str], order: str, feed: bool) -> DataFrame:
    """A table in the long form of a page (feed=False) or a feed."""
    names = ("feed_id", "key", "key_ord") if feed else ("list_id", "col_key", "col_ord")
    each = F.array(*[F.struct(F.lit(c).alias(names[1]), F.lit(i).alias(names[2]), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    out = df.select(F.lit(id).alias(names[0]), F.col(order).alias("row_idx"), F.explode(each).alias("c")).select(names[0], "row_idx", "c.*")
    return out if feed else out.withColumn("attr", F.lit("own"))


def _page_and_feeds(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shown = F.when(F.col("c_custkey") % 3 > 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit(" at home")))
    page = c.select("c_custkey", shown.alias("name"), "c_mktsegment", F.concat(F.lit("x"), "c_custkey").alias("own"))
    page = _cells(page, "page", ["name", "c_mktsegment", "own"], "c_custkey", False)
    s = table(spark, sf_dir, "supplier")
    feeds = _cells(c, "customers", ["c_custkey", "c_name", "c_mktsegment"], "c_custkey", True).unionByName(_cells(s, "suppliers", ["s_suppkey", "s_name"], "s_suppkey", True))
    return page, feeds


_PAGE = "SELECT 'name' AS col_key, lower(c_name) || CASE WHEN c_custkey % 3 > 0 THEN '' ELSE ' at home' END AS v FROM customer UNION ALL SELECT 'c_mktsegment', lower(c_mktsegment) FROM customer UNION ALL SELECT 'own', 'x' || c_custkey FROM customer"
_FEED = "SELECT DISTINCT 'customers' AS feed_id, 'c_custkey' AS key, c_custkey::VARCHAR AS v FROM customer UNION SELECT 'customers', 'c_name', lower(c_name) FROM customer UNION SELECT 'customers', 'c_mktsegment', lower(c_mktsegment) FROM customer UNION SELECT 'suppliers', 's_suppkey', s_suppkey::VARCHAR FROM supplier UNION SELECT 'suppliers', 's_name', lower(s_name) FROM supplier"
_SCORES = f"""p AS ({_PAGE}), f AS ({_FEED}), ps AS (SELECT col_key, count(*) AS rows, count(DISTINCT v) AS d FROM p GROUP BY 1), fs AS (SELECT feed_id, key, count(*) AS n FROM f GROUP BY ALL),
    h AS (SELECT col_key, feed_id, key, count(*) AS hits FROM p JOIN f USING (v) GROUP BY ALL),
    s AS (SELECT col_key, feed_id, key, least(1.0, hits / least(rows, n)) * (0.6 + 0.4 * d / rows) AS score FROM h JOIN ps USING (col_key) JOIN fs USING (feed_id, key))"""


@query(f"WITH {_SCORES} SELECT col_key, feed_id, key, round(score, 6) AS score FROM s")
def column_overlap_score(spark, sf_dir):
    page, feeds = _page_and_feeds(spark, sf_dir)
    return M.column_scores(page, feeds).select("col_key", "feed_id", "key", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT 'page' AS list_id, feed_id, count(*) AS pairs, round(sum(score) * (0.5 + count(*) / 3.0), 6) AS match_score FROM s WHERE score >= 0.55 GROUP BY feed_id HAVING count(*) >= 2")
def schema_match(spark, sf_dir):
    page, feeds = _page_and_feeds(spark, sf_dir)
    sizes = feeds.groupBy("feed_id").agg(F.count_distinct("row_idx").alias("rows")).withColumn("feed_ord", F.when(F.col("feed_id") == "customers", 0).otherwise(1))
    lists = page.groupBy("list_id").agg(F.count_distinct("col_key").alias("columns"), F.count_distinct("row_idx").alias("count"))
    best = M.best_match(M.pairs(M.column_scores(page, feeds)), lists, sizes)
    return best.withColumn("match_score", F.round("match_score", 6))


@query(
    """WITH p AS (SELECT c_custkey AS k, 'https://x.example.org/c/' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'x' END || (c_custkey + 1000) || '/profile' AS v FROM customer), f AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'y' END || (c_custkey + 1000) AS a FROM customer)
       SELECT round(count(*)::DOUBLE / least((SELECT count(*) FROM p), (SELECT count(*) FROM f)), 6) AS score FROM p JOIN f ON v LIKE '%/' || a || '/%'"""
)
def link_suffix_score(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    page = c.select("c_custkey", F.concat(F.lit("https://x.example.org/c/"), F.when(k % 4 == 0, "").otherwise("x"), k + 1000, F.lit("/profile")).alias("link"))
    page = _cells(page, "page", ["link"], "c_custkey", False).withColumn("attr", F.lit("href"))
    feed = _cells(c.select("c_custkey", F.concat(F.when(k % 2 == 0, "").otherwise("y"), k + 1000).alias("slug")), "feed", ["slug"], "c_custkey", True)
    return M.column_scores(page, feed).select(F.round("score", 6).alias("score"))


@query(
    """SELECT 'images' AS col_key, round(count(*) FILTER (WHERE c_custkey % 2 = 0)::DOUBLE / count(*), 6) AS score FROM customer
       UNION ALL SELECT 'links', round(count(*) FILTER (WHERE c_custkey % 3 = 0)::DOUBLE / count(*), 6) FROM customer"""
)
def image_and_path_score(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    image = F.when(k % 2 == 0, F.concat(F.lit("https://cdn.example.org/img/c"), k, F.lit(".png"))).otherwise(F.concat(F.lit("/local/"), k, F.lit(".jpg")))
    link = F.concat(F.lit("https://x.example.org/"), F.when(k % 3 == 0, "shop/c").otherwise("c/"), k, F.lit("?tab=1"))
    page = _cells(c.select("c_custkey", image.alias("images"), link.alias("links")), "page", ["images", "links"], "c_custkey", False)
    page = page.withColumn("attr", F.when(F.col("col_key") == "images", "src").otherwise("href"))
    feed = c.select("c_custkey", F.concat(F.lit("http://cdn.example.org/img/c"), k, F.lit(".png")).alias("picture"), F.concat(F.lit("shop/c"), k).alias("slug"))
    return M.column_scores(page, _cells(feed, "feed", ["picture", "slug"], "c_custkey", True)).select("col_key", F.round("score", 6).alias("score"))


def _sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    page = c.select(F.col("c_custkey").alias("_ord"), F.concat(F.lit("Name "), F.expr("c_custkey div 3")).alias("shown"), F.concat(F.lit("<b>p"), "c_custkey", F.lit("</b>")).alias("extra"))
    feed = c.select(F.col("c_custkey").alias("_ord"), F.concat(F.lit("name "), F.expr("2 * (c_custkey div 2)")).alias("title"), F.col("c_mktsegment").alias("segment"))
    return page, feed


_SIDES = """p AS (SELECT c_custkey AS o, 'name ' || (c_custkey // 3) AS v, '<b>p' || c_custkey || '</b>' AS extra FROM customer), f AS (SELECT c_custkey AS o, 'name ' || (2 * (c_custkey // 2)) AS v, c_mktsegment AS segment FROM customer),
    pl AS (SELECT v, max(o) AS page_row FROM p GROUP BY v), ff AS (SELECT v, min(o) AS feed_row FROM f GROUP BY v), a AS (SELECT page_row, feed_row FROM pl JOIN ff USING (v))"""


@query(f"WITH {_SIDES} SELECT * FROM a")
def align_rows(spark, sf_dir):
    page, feed = _sides(spark, sf_dir)
    return M.align_rows(page, feed, "shown", "title")


@query("SELECT c_custkey AS page_row, c_custkey AS feed_row FROM customer WHERE c_custkey % 3 > 0")
def align_whole_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "_ord")
    page = c.select("_ord", F.when(F.col("_ord") % 3 > 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit(" changed"))).alias("shown"))
    return M.align_rows(page, c.select("_ord", F.col("c_name").alias("title")), "shown", "title")


@query(f"WITH {_SIDES} SELECT p.o AS _ord, 'Name ' || (p.o // 3) AS \"Name\", coalesce(segment, '') AS \"Segment\" FROM p LEFT JOIN a ON page_row = p.o LEFT JOIN f ON f.o = feed_row")
def page_rows(spark, sf_dir):
    page, feed = _sides(spark, sf_dir)
    return M.page_rows(page, feed, M.align_rows(page, feed, "shown", "title"), {"Name": "shown"}, {"Segment": "segment"})


@query(f"WITH {_SIDES} SELECT f.o AS _ord, segment AS \"Segment\", coalesce(p.extra, '') AS \"Extra\" FROM f LEFT JOIN pl USING (v) LEFT JOIN p ON p.o = page_row")
def feed_rows(spark, sf_dir):
    page, feed = _sides(spark, sf_dir)
    return M.feed_rows(page, feed, "shown", "title", {"Extra": "extra"}, {"Segment": "segment"})


@query(
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS m, l_partkey::VARCHAR AS part, l_returnflag AS flag FROM lineitem),
       n AS (SELECT l_orderkey, string_agg(DISTINCT l_linestatus, '; ' ORDER BY l_linestatus) AS states, max(l_shipmode) AS mode FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1)
       SELECT o_orderkey, coalesce(mode, '') AS mode, coalesce(states, '') AS states, m::INTEGER AS _member, coalesce(part, '') AS part, coalesce(flag, '') AS flag FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN l ON l.l_orderkey = o_orderkey"""
)
def assemble_items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_partkey").cast("string").alias("part"), F.col("l_returnflag").alias("flag"))
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(entry)).alias("members"), F.sort_array(F.collect_set("l_linestatus")).alias("states_list"), F.max("l_linestatus").alias("mode"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return A.assemble(rows, items, "o_orderkey", ["mode"], ("members", ["part", "flag"]), {"states": "states_list"})


@query(
    """WITH o AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders),
       c AS (SELECT o_custkey, max(CASE WHEN r = 1 THEN o_orderpriority END) AS n, max(CASE WHEN r = 1 THEN o_orderstatus END) AS t, coalesce(string_agg(o_orderpriority || ', ' || o_orderstatus, '; ' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 6), '') AS more FROM o GROUP BY 1)
       SELECT o_custkey AS id, n AS "Decision-maker", t AS "Decision-maker role", 'High' AS "Decision-maker confidence", more AS "Other decision-makers" FROM c"""
)
def lead_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    person = F.struct("o_orderpriority", "o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("role_raw"), none.alias("email"), none.alias("phone"), none.alias("linkedin"), none.alias("source_url"), F.lit("high").alias("confidence"))
    leads = o.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(person)).alias("people"))
    blank = {c: none for c in ("website", "website_source", "company_email", "company_email_source", "company_phone", "company_phone_source", "company_linkedin")}
    cells = A.lead_cells(leads.withColumns(blank | {"notes": F.array().cast("array<string>")}))
    return cells.select("id", "Decision-maker", "Decision-maker role", "Decision-maker confidence", "Other decision-makers")


@query(
    """SELECT o_orderkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS "Website", CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Listed in the directory' END AS "Website found via" FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def join_leads(spark, sf_dir):
    none = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer")
    leads = c.select(F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("id"), F.col("c_name").alias("website"), F.lit("listing").alias("website_source"), F.array().cast("array<struct<name:string,role_raw:string,email:string,phone:string,linkedin:string,source_url:string,confidence:string>>").alias("people"), *[none.alias(x) for x in ("company_email", "company_email_source", "company_phone", "company_phone_source", "company_linkedin")], F.array().cast("array<string>").alias("notes"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return A.join_leads(rows, A.lead_cells(leads), F.col("o_custkey")).select("o_orderkey", "Website", "Website found via")


@query(
    """WITH a AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, o_orderstatus AS website, ['old', o_orderpriority] AS pages FROM orders), b AS (SELECT CASE WHEN o_orderkey % 2 = 1 THEN 100000000000 + o_orderkey ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'new' END AS website, ['new', o_orderpriority] AS pages FROM orders)
       SELECT coalesce(b.id, a.id) AS id, coalesce(nullif(b.website, ''), a.website) AS website,
              array_to_string(CASE WHEN b.id IS NULL THEN a.pages WHEN a.id IS NULL THEN b.pages ELSE a.pages || ['new'] END, ',') AS pages FROM a FULL JOIN b USING (id)"""
)
def merge_lead(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    old = o.select(F.when(k % 3 == 0, -k).otherwise(k).alias("id"), F.col("o_orderstatus").alias("website"), none.alias("people"), F.array(F.lit("old"), "o_orderpriority").alias("pages"))
    new = o.select(F.when(k % 2 == 1, k + 100_000_000_000).otherwise(k).alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("new").alias("website"), none.alias("people"), F.array(F.lit("new"), "o_orderpriority").alias("pages"))
    return A.merge_leads(old, new, ["website"]).select("id", "website", F.array_join("pages", ",").alias("pages"))


_PEOPLE = """SELECT o_custkey, o_orderkey, lower(o_orderpriority) AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS email, CASE WHEN o_orderkey % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence, ['owner', 'ceo', 'md'][o_orderkey % 3 + 1] AS role FROM orders"""


def _people(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    role = F.element_at(F.array(F.lit("owner"), F.lit("ceo"), F.lit("md")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_custkey", k.alias("_ord"), F.col("o_orderpriority").alias("name"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("email"), F.when(k % 4 == 0, "high").otherwise("medium").alias("confidence"), role.alias("role"))


@query(f"WITH p AS ({_PEOPLE}) SELECT o_custkey, name, arg_min(email, o_orderkey) FILTER (WHERE email IS NOT NULL) AS email, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'medium' END AS confidence, min(o_orderkey) AS first_ord FROM p GROUP BY ALL")
def merge_people(spark, sf_dir):
    merged = A.merge_people(_people(spark, sf_dir), ["o_custkey"], values=("email",))
    return merged.select("o_custkey", F.lower("name").alias("name"), "email", "confidence", F.col("_ord").alias("first_ord"))


@query(
    f"""WITH p AS ({_PEOPLE}), r AS (SELECT *, list_position(['owner', 'ceo', 'md'], role) * 10 + CASE confidence WHEN 'high' THEN 0 ELSE 2 END + CASE WHEN email IS NULL THEN 1 ELSE 0 END AS k FROM p),
        n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS rank FROM r) SELECT * FROM n WHERE rank <= 5"""
)
def rank_people(spark, sf_dir):
    return A.best_people(_people(spark, sf_dir), ["o_custkey"], 5).select("o_custkey", F.col("_ord").alias("o_orderkey"), "rank")


_PLAN = """WITH r AS (SELECT o_orderkey, c_name, n_name, o_orderstatus, row_number() OVER (PARTITION BY lower(trim(c_name)) ORDER BY o_orderkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name) = 'nation_3')"""


def _plan_rows(spark, sf_dir, sources: bool, limit: int | None):
    from harrow.functions.web import same_country

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("_ord"), "c_name", "n_name", "o_orderstatus")
    items = [("Company", F.col("c_name"), F.lit("Directory"), F.lit("High")), ("Status", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.lit("Orders"), F.lit("Medium"))]
    return A.plan_rows(rows, items, F.col("c_name"), same_country("n_name", "Nation_3"), sources, limit)


@query(f"{_PLAN} SELECT c_name AS \"Company\", CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS \"Status\" FROM r WHERE rn = 1 ORDER BY o_orderkey LIMIT 20")
def plan_first_n(spark, sf_dir):
    return _plan_rows(spark, sf_dir, False, 20)


@query(
    f"""{_PLAN} SELECT c_name AS "Company", 'Directory' AS "Company (source)", 'High' AS "Company (confidence)", CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS "Status",
        CASE WHEN o_orderstatus <> 'O' THEN 'Orders' ELSE '' END AS "Status (source)", CASE WHEN o_orderstatus <> 'O' THEN 'Medium' ELSE '' END AS "Status (confidence)" FROM r WHERE rn = 1"""
)
def plan_sources(spark, sf_dir):
    return _plan_rows(spark, sf_dir, True, None)


def _part_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_brand_copy", F.col("p_brand")).withColumn("constant", F.lit("same")).withColumn("blank", F.when(F.col("p_partkey") % 3 == 0, "x"))
    names = ["p_partkey", "p_name", "p_brand", "p_brand_copy", "p_size", "constant", "blank"]
    return P.long_form(p, names, "p_partkey"), p


_PART = "p AS (SELECT p_partkey, p_name, p_brand, p_brand AS p_brand_copy, p_size, 'same' AS constant, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS blank FROM part)"
_LONG = _PART + ", l AS (" + " UNION ALL ".join(f"SELECT p_partkey AS row, '{c}' AS key, {i} AS pos, {c}::VARCHAR AS value FROM p" for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_brand_copy", "p_size", "constant", "blank"])) + ")"


@query(f"WITH {_LONG} SELECT key, count(*) AS n, count(value) AS filled, round(100.0 * count(value) / count(*), 1) AS percent, count(DISTINCT value) AS distinct, arg_min(value, row) AS sample, 0::BIGINT AS non_ascii FROM l GROUP BY key")
def field_stats(spark, sf_dir):
    return P.column_report(_part_cells(spark, sf_dir)[0])


@query(f"WITH {_LONG} SELECT key, arg_min(value, row) AS sample, round(count(value)::DOUBLE / (SELECT count(*) FROM p), 6) AS fill FROM l GROUP BY key")
def field_profile(spark, sf_dir):
    cells, p = _part_cells(spark, sf_dir)
    return P.profile(cells, p.count()).select("key", "sample", F.round("fill", 6).alias("fill"))


@query("SELECT * FROM (VALUES ('p_partkey', true), ('p_name', true), ('p_brand', true), ('p_brand_copy', false), ('p_size', true), ('constant', false), ('blank', false)) AS t(key, \"on\") WHERE (SELECT count(*) FROM part) > 0")
def default_columns(spark, sf_dir):
    cells, p = _part_cells(spark, sf_dir)
    n = p.count()
    return P.default_columns(P.profile(cells, n), cells, n).select("key", "on")


@query(f"WITH {_LONG} SELECT key, count(DISTINCT value)::DOUBLE / count(value) AS share FROM l GROUP BY key")
def distinct_shares(spark, sf_dir):
    return P.distinct_share(_part_cells(spark, sf_dir)[0])


@query(
    """WITH e AS (SELECT event_type, k, props::JSON ->> k AS v FROM (SELECT event_type, props, unnest(json_keys(props::JSON)) AS k FROM events))
       SELECT event_type, k AS key, count(*) AS n, count(DISTINCT v) AS distinct FROM e GROUP BY ALL"""
)
def json_profile(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    e = table(spark, sf_dir, "events").select("event_type", F.explode(props).alias("key", "v"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct"))


@query(
    """WITH f AS (SELECT c_custkey AS page, unnest(['segment', 'name', 'site']) AS field, unnest([c_mktsegment, c_name, 'same']) AS value FROM customer), k AS (SELECT field FROM f GROUP BY field HAVING count(DISTINCT page) > 1 AND count(DISTINCT value) = 1)
       SELECT field, count(*) AS n FROM f WHERE field NOT IN (SELECT field FROM k) GROUP BY field"""
)
def constant_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    each = F.explode(F.array(F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("site").alias("field"), F.lit("same").alias("value"))))
    values = c.select(F.col("c_custkey").alias("page"), each.alias("x")).select("page", "x.*")
    return P.drop_constant_fields(values).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS list_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2 OR bool_or(o_orderstatus = 'F')")
def single_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    counts = o.groupBy(F.col("o_custkey").alias("list_id")).agg(F.count("*").alias("count"), F.max(F.col("o_orderstatus") == "F").alias("people"))
    return P.drop_single_lists(counts).select("list_id", F.col("count").alias("n"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) % 2 = 0) AND n_name <> ''")
def extra_fields(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.lit(1.0).alias("fill"), F.col("n_name").alias("sample"))
    used = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    return M.extra_fields(fields, used).select(F.col("key").alias("n_nationkey"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT p_partkey FROM part UNION SELECT l_partkey FROM lineitem) UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem)"""
)
def key_set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.union(b).distinct()).union(one("except", a.subtract(b))).union(one("intersect", a.intersect(b)))
