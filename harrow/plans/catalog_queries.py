"""Choosing, naming and extracting over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import records as R
from harrow.functions.web import role_of
from harrow.operators import catalog as K
from harrow.operators import pages as H
from harrow.operators.company import as_name
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


@query("SELECT o_orderpriority AS feed_id, count(*) AS total FROM orders GROUP BY 1 HAVING count(*) > 15")
def primary_feeds(spark, sf_dir):
    feeds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feed_id")).agg(F.count("*").alias("total"))
    return K.primary_feeds(feeds.withColumns({"rows": F.col("total"), "ai": F.lit(False), "_ord": F.col("feed_id")})).select("feed_id", "total")


@query(
    """WITH l AS (SELECT c_nationkey AS list_id, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT n_nationkey AS feed_id, 3 * (n_nationkey + 1) AS size FROM nation)
       SELECT list_id, CASE WHEN size::DOUBLE / n <= 4 AND list_id % 3 > 0 THEN greatest(size, n) ELSE n END AS reach FROM l JOIN f ON feed_id = list_id"""
)
def list_reach(spark, sf_dir):
    lists = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("list_id")).agg(F.count("*").alias("count")).withColumn("filled_columns", F.lit(4))
    matches = lists.select("list_id", F.col("list_id").alias("feed_id"), F.when(F.col("list_id") % 3 == 0, 1).otherwise(2).alias("pairs"))
    feeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("feed_id"), (3 * (F.col("n_nationkey") + 1)).cast("long").alias("size"))
    return K.reach(lists, matches, feeds).select("list_id", "reach")


@query("SELECT 'feed' AS kind, arg_max(o_custkey, (n, -o_custkey))::VARCHAR AS id FROM (SELECT o_custkey, 100 * count(*) AS n FROM orders GROUP BY 1)")
def dataset_choice(spark, sf_dir):
    feeds = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("feed_id")).agg((100 * F.count("*")).alias("size")).withColumns({"_ord": F.col("feed_id"), "paginated": F.lit(True)})
    lists = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("list_id"), F.col("n_nationkey").alias("_ord"), F.lit(1.0).alias("score"), F.lit(20).alias("reach"), (F.col("n_nationkey") == 0).alias("navigation"))
    return K.choose_dataset(lists, feeds)


@query(
    """SELECT key, name FROM (VALUES ('c_custkey', 'Number'), ('c_name', 'Text'), ('mail', 'Email'), ('price', 'Price'), ('link', 'Company link'), ('hooked', 'Country')) t(key, name) WHERE (SELECT count(*) FROM customer) > 0"""
)
def column_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    made = {"mail": F.concat(F.lit("c"), "c_custkey", F.lit("@x.org")), "price": F.concat(F.lit("€ "), "c_custkey"), "link": F.concat(F.lit("https://x.org/company/"), "c_custkey"), "hooked": F.concat(F.lit("x"), "c_nationkey")}
    wide = c.withColumns(made)
    names = ["c_custkey", "c_name", *made]
    cells = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    none = F.lit(None).cast("string")
    columns = spark.createDataFrame([(n,) for n in names], "key string").select("key", F.when(F.col("key") == "link", "href").otherwise("own").alias("attr"), none.alias("header"), none.alias("label"), F.lit(False).alias("label_strong"), F.when(F.col("key") == "hooked", "card-country").alias("hook"), F.lit(False).alias("heading"))
    return K.name_columns(columns, cells, ["key"]).select("key", "name")


@query("SELECT 'Company' AS name_col, 'Nation' AS country_col, 'Web site' AS website_col FROM customer LIMIT 1")
def lead_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = F.array(F.struct(F.lit("Company").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit("Nation").alias("name"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("Web site").alias("name"), F.concat(F.lit("www.c"), "c_custkey", F.lit(".org")).alias("value")))
    samples = c.select(F.explode(cells).alias("x")).select("x.*")
    names = samples.groupBy("name").agg(F.min("name").alias("_ord"))
    return K.guess_lead_columns(names, samples)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'https://own.example.org/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://x.example.org/c/' || c_custkey END AS url FROM customer")
def row_urls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://own.example.org/"), "c_custkey")).alias("own"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_custkey")).alias("slug"))
    return c.select("c_custkey", K.row_urls(c, False, "slug", "https://x.example.org/c/{v}", None, "own").alias("url"))


@query("SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS updated FROM orders WHERE epoch_ms(o_orderdate) >= (SELECT max(epoch_ms(o_orderdate)) FROM orders) - 30::BIGINT * 86400000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def job_history(spark, sf_dir):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ms.alias("updated"))
    return K.history(jobs, jobs.agg(F.max("updated")).first()[0])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS number FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def preview_page(spark, sf_dir):
    return K.page_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50, 2)


# character references as HTML reads them: the semicolon may be missing, and what a decoded & begins is no reference
_SAID = r"""regexp_extract(html, '<h1>([^<]*)', 1)"""
for _name, _char in (("&nbsp;?", " "), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&(#39|#x27);?|&apos;", "''"), ("&amp;?", "&")):
    _SAID = f"regexp_replace({_SAID}, '{_name}', '{_char}', 'g')"


@query(rf"""SELECT page_id, 'Name' AS name, trim(regexp_replace({_SAID}, '\s+', ' ', 'g')) AS value FROM pages""")
def single_fields(spark, sf_dir):
    return K.single_fields(H.elements(table(spark, sf_dir, "pages"))).where("kind = 0").select("page_id", "name", "value")


@query(r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS v FROM pages) SELECT page_id, count(*) AS cells FROM n WHERE regexp_matches(v, '[\p{L}\p{N}]') GROUP BY 1""")
def extract_cells(spark, sf_dir):
    nodes = H.elements(table(spark, sf_dir, "pages"))
    leaves = H.list_leaves(nodes)
    spec = spark.createDataFrame([("nav", "li", ">a", "own", "Entry")], "list_id string, sig string, path string, attr string, field string")
    return K.extract(leaves, spec).groupBy("page_id").agg(F.count("*").alias("cells"))


@query("SELECT c_custkey AS page_id, 'Anna Meier' AS name, 'ceo' AS role, 'a' || c_custkey || '@x.org' AS email FROM customer WHERE c_custkey % 5 > 0")
def structured_people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 5 > 0, "Person").otherwise("Organization")
    body = F.to_json(F.struct(F.struct(kind.alias("@type"), F.lit("Anna Meier").alias("name"), F.lit("CEO").alias("jobTitle"), F.concat(F.lit("mailto:a"), "c_custkey", F.lit("@x.org")).alias("email")).alias("founder")))
    pages = c.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("html"))
    return R.json_ld_people(pages).select("page_id", as_name("name").alias("name"), role_of("title").alias("role"), "email")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, NULL::VARCHAR AS gone FROM events")
def json_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a":['), "props", F.lit("]}")).alias("body"))
    return e.select("event_id", R.number_in(F.col("body"), ["k"]).alias("k"), R.dig(R.changed(F.col("body"), "a.0.k"), "a.0.k").alias("gone"))


@query("SELECT 'sid=' || c_custkey || '; t=1' AS header FROM customer")
def cookies(spark, sf_dir):
    sent = K.cookies_of(F.concat(F.lit("Cookie: sid="), "c_custkey", F.lit("; bad; t=1")), F.lit("https://www.example.org/x"))
    return table(spark, sf_dir, "customer").select(K.cookie_header(sent, F.lit("https://www.example.org/y")).alias("header"))


@query()
def diverse_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    features = H.page_features(pages).withColumn("sample", F.expr("page_id div 40"))
    return K.diverse_pages(features)
