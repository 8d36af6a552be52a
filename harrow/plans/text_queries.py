"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.functions import web as W
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


SYNTH = "CASE c_custkey % 5 WHEN 0 THEN '=' || c_name WHEN 1 THEN c_name || ', ' || c_mktsegment WHEN 2 THEN '\"' || c_name || '\"' WHEN 3 THEN '  ' || c_name || '  x' ELSE c_name END"


def _synth(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.select("c_custkey", F.expr(SYNTH.replace("'\"'", "'\\\"'")).alias("s"), "c_name", "c_mktsegment")


@query(
    f"""SELECT c_custkey, CASE WHEN regexp_matches(g, '[",\\r\\n]') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS field
        FROM (SELECT c_custkey, CASE WHEN regexp_matches(s, '^[=+\\-@\\t\\r]') THEN '''' || s ELSE s END AS g FROM (SELECT c_custkey, {SYNTH} AS s FROM customer))"""
)
def csv_field(spark, sf_dir):
    return _synth(spark, sf_dir).select("c_custkey", X.csv_field("s").alias("field"))


@query(
    f"""SELECT c_custkey, CASE WHEN b = '' THEN 'export' ELSE b END AS base FROM (SELECT c_custkey, left(lower(regexp_replace(regexp_replace({SYNTH}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')), 60) AS b FROM customer)"""
)
def file_base(spark, sf_dir):
    return _synth(spark, sf_dir).select("c_custkey", X.file_base("s").alias("base"))


@query(f"""SELECT c_custkey, trim(regexp_replace({SYNTH}, '\\s+', ' ', 'g')) AS clean, lower(trim(regexp_replace({SYNTH}, '\\s+', ' ', 'g'))) || '|' || lower(c_mktsegment) AS key FROM customer""")
def clean_and_key(spark, sf_dir):
    return _synth(spark, sf_dir).select("c_custkey", X.clean("s").alias("clean"), X.company_key(F.col("s"), F.col("c_mktsegment")).alias("key"))


@query(
    r"""SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|&amp;|&#[0-9]+;', ' ', 'g')), '\s+', ' ', 'g')) <> '' AS any_text,
               length(trim(regexp_replace(regexp_replace(url, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS url_size FROM pages"""
)
def norm_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", (X.norm("html") != "").alias("any_text"), F.length(X.norm("url")).cast("long").alias("url_size"))


@query()
def norm_whole_pages(spark, sf_dir):
    normed = X.norm("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(normed).cast("long").alias("size"), F.sha2(normed, 256).alias("sha256"))


@query(r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS email FROM documents) SELECT doc_id, email FROM a""")
def emails_in(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(W.emails_in("text")).alias("email"))


@query(
    r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS email FROM documents)
        SELECT regexp_matches(split_part(lower(email), '@', 1), '^(info|kontakt|contact|office|mail|email|sales)$') AS generic, count(*) AS n FROM a GROUP BY 1"""
)
def generic_mailboxes(spark, sf_dir):
    mails = table(spark, sf_dir, "documents").select(F.explode(W.emails_in("text")).alias("email"))
    return mails.groupBy(W.is_generic_mailbox("email").alias("generic")).agg(F.count("*").alias("n"))


HOST = "lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(
    rf"""WITH h AS (SELECT page_id, url, {HOST} AS host FROM pages),
         p AS (SELECT *, string_split(regexp_replace(host, '^www\.', ''), '.') AS parts FROM h)
        SELECT page_id, host, regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
               array_to_string(list_slice(parts, greatest(len(parts) - CASE WHEN regexp_matches(array_to_string(parts[-2:], '.'), '^(co|com|org|net|ac|gov)\.[a-z]{{2}}$') THEN 2 ELSE 1 END, 1), len(parts)), '.') AS base,
               regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM p"""
)
def url_host_page(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", W.host_of("url").alias("host"), W.path_of("url").alias("path"), W.base_domain(W.host_of("url")).alias("base"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"))


@query(
    rf"""SELECT page_id, regexp_extract(lower(url), '^(https?)', 1) || '://' || {HOST} || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/$', '') AS website,
               {HOST} || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/(de|en|fr|es|it)(/|$)', '/'), '/+$', '') AS directory FROM pages"""
)
def clean_websites(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.clean_website("url").alias("website"), W.directory_path("url").alias("directory"))


@query("SELECT c_custkey, 'https://fair.example.org/en/c/' || replace(replace(c_name || ' ' || c_mktsegment, ' ', '%20'), '#', '%23') AS url FROM customer")
def fill_pattern(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", W.fill_pattern("https://fair.example.org/en/c/{v}", F.concat_ws(" ", "c_name", "c_mktsegment")).alias("url"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey < 10 THEN NULL WHEN c_custkey % 3 = 0 THEN 'https://x.example.org/c/{v}' WHEN c_custkey % 3 = 1 THEN 'https://x.example.org/c/{v}?tab=1' END AS pattern FROM customer"""
)
def pattern_from(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    href = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('https://x.example.org/c/', c_custkey) WHEN 1 THEN concat('https://x.example.org/c/', c_custkey, '?tab=1') ELSE concat('https://x.example.org/c', c_custkey, 'x') END")
    return c.select("c_custkey", W.pattern_from(href, F.col("c_custkey")).alias("pattern"))


KEYS = "concat('data.', CASE c_custkey % 6 WHEN 0 THEN 'stands.0.name' WHEN 1 THEN 'companyName' WHEN 2 THEN 'is_new' WHEN 3 THEN 'categories.1.title' WHEN 4 THEN 'street_address' ELSE 'company_id' END)"


@query(
    f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Stand name' WHEN 1 THEN 'Company name' WHEN 2 THEN 'Is new' WHEN 3 THEN 'Category title' WHEN 4 THEN 'Street address' ELSE 'Company id' END AS label,
               c_custkey % 6 IN (2, 5) AS plumbing FROM customer"""
)
def humanize_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(KEYS).alias("k"))
    return c.select("c_custkey", X.humanize_key("k").alias("label"), X.is_plumbing("k").alias("plumbing"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'bus' WHEN 2 THEN 'glass' ELSE 'stand' END AS one FROM customer"""
)
def singulars(spark, sf_dir):
    word = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'companies' WHEN 1 THEN 'buses' WHEN 2 THEN 'glass' ELSE 'stands' END")
    return table(spark, sf_dir, "customer").select("c_custkey", X.singular(word).alias("one"))


TITLES = "CASE o_orderkey % 9 WHEN 0 THEN 'Managing Director' WHEN 1 THEN 'CEO' WHEN 2 THEN 'Founder & Publisher' WHEN 3 THEN 'Head of Purchasing' WHEN 4 THEN 'Assistant to the CEO' WHEN 5 THEN 'Sales representative' WHEN 6 THEN 'Chief Technical Officer' WHEN 7 THEN 'Einkaufsleiter' ELSE 'Vice President Sales' END"


@query(
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'md' WHEN 1 THEN 'ceo' WHEN 2 THEN 'owner' WHEN 3 THEN 'purchasing' WHEN 6 THEN 'decision' WHEN 7 THEN 'purchasing' WHEN 8 THEN 'ceo' END AS role,
               o_orderkey % 9 = 4 AS excluded FROM orders"""
)
def role_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(TITLES).alias("t"))
    return o.select("o_orderkey", W.role_of("t").alias("role"), W.is_excluded_title("t").alias("excluded"))


COUNTRY = "CASE n_nationkey % 5 WHEN 0 THEN 'Deutschland' WHEN 1 THEN ' Germany ' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'France' ELSE n_name END"


@query(
    f"""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '.de' WHEN 1 THEN '.de' WHEN 2 THEN '.co.uk' WHEN 3 THEN '.fr' END AS tld, n_nationkey % 5 IN (0, 1) AS german FROM nation"""
)
def country_tld(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(COUNTRY).alias("c"))
    return n.select("n_nationkey", W.country_tld("c").alias("tld"), W.same_country("c", "german").alias("german"))


IP = "concat_ws('.', cast(c_custkey % 256 AS string), cast((c_custkey * 7) % 256 AS string), cast((c_custkey * 13) % 256 AS string), cast((c_custkey * 31) % 256 AS string))"


@query(
    """WITH p AS (SELECT c_custkey, (c_custkey % 256) * 16777216 + ((c_custkey * 7) % 256) * 65536 + ((c_custkey * 13) % 256) * 256 + (c_custkey * 31) % 256 AS n FROM customer),
       b(base, bits) AS (VALUES (0, 8), (167772160, 8), (1681915904, 10), (2130706432, 8), (2851995648, 16), (2886729728, 12), (3221225472, 24), (3221225984, 24), (3232235520, 16), (3323068416, 15), (3325256704, 24), (3405803776, 24), (3758096384, 4), (4026531840, 4))
       SELECT c_custkey, max((n >> (32 - bits)) = (base::BIGINT >> (32 - bits))) AS private FROM p, b GROUP BY c_custkey"""
)
def private_ip(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", W.is_private_ip(F.expr(IP)).alias("private"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace('user=' || source || '&password=' || lang || ' ' || coalesce(text, ''), 'gsk_[A-Za-z0-9]{8,}', '•••', 'g'), '(?i)\b(password|passwd|pwd|pass)=[^&\s"'']+', '\1=•••', 'g')) AS h FROM documents"""
)
def redact(spark, sf_dir):
    said = F.concat(F.lit("user="), "source", F.lit("&password="), "lang", F.lit(" "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact(said), 256).alias("h"))


@query("SELECT c_custkey, (c_custkey % 60) * 60 + 5.5 AS seconds, ceil(c_custkey * 13 / 12.0)::BIGINT + 5 AS estimate FROM customer")
def durations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    said = F.concat((F.col("c_custkey") % 60).cast("string"), F.lit("m5.5s"))
    return c.select("c_custkey", X.seconds(said).alias("seconds"), (F.ceil(F.col("c_custkey") * 13 / 12) + 5).alias("estimate"))


@query("SELECT c_custkey, c_name AS value, c_custkey % 2 = 0 AS alive FROM customer")
def sealed_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", X.seal("c_name", "0123456789abcdef", F.when(F.col("c_custkey") % 2 == 0, 200).otherwise(100)).alias("token"))
    return c.select("c_custkey", X.unseal("token", "0123456789abcdef", F.lit(50)).alias("value"), X.unseal("token", "0123456789abcdef", F.lit(150)).isNotNull().alias("alive"))


@query(
    """WITH n AS (SELECT p_partkey, p_name, left(p_name, 6) || '...' AS short FROM part) SELECT p_partkey, CASE WHEN length(trim(left(p_name, 6))) >= 3 THEN p_name ELSE short END AS full FROM n"""
)
def detruncate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.substring("p_name", 1, 6), F.lit("...")).alias("short"))
    return p.select("p_partkey", X.completed("short", F.array(F.lit("x"), "p_name")).alias("full"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::DOUBLE::VARCHAR END AS whole FROM customer")
def number_cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.cell("c_acctbal", "double").alias("whole"))


@query(
    r"""SELECT s_suppkey, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(replace(s_name, '#', ' ') || ' Ltd', '(?i)\b(ltd|gmbh|verlag)\b', ' ', 'g')), '[^a-z0-9 ]', ' ', 'g')), ' '), lambda w: length(w) > 1)::VARCHAR AS tokens FROM supplier"""
)
def significant_tokens(spark, sf_dir):
    from harrow.operators.company import significant_tokens as tokens

    s = table(spark, sf_dir, "supplier").select("s_suppkey", tokens(F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Ltd"))).alias("t"))
    return s.select("s_suppkey", F.concat(F.lit("["), F.array_join("t", ", "), F.lit("]")).alias("tokens"))
