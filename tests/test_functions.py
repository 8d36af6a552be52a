"""Scalar functions on small values."""

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.functions import web as W
from harrow.operators import company as C
from harrow.operators import pages as H


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (X.norm, " <b>Ａcme</b>&nbsp;Press · ", "acme press"),
        (X.norm, None, ""),
        (X.fold, "  Éditions   Ünï ", "editions uni"),
        (X.clean, "a  b\n c", "a b c"),
        (X.plain, "<p>Fish &amp; chips</p><p>x</p>", "Fish & chips\nx"),
        (X.plain, "3 < 4", "3 < 4"),
        (X.humanize_key, "stands.0.hall", "Hall"),
        (X.humanize_key, "stands.0.name", "Stand name"),
        (X.humanize_key, "isNew", "Is new"),
        (X.humanize_key, "0", "0"),
        (X.is_plumbing, "a.company_id", True),
        (X.is_plumbing, "userId", True),
        (X.is_plumbing, "name", False),
        (X.singular, "companies", "company"),
        (X.csv_field, "=1+1", "'=1+1"),
        (X.csv_field, 'a "b", c', '"a ""b"", c"'),
        (X.csv_field, None, ""),
        (X.file_base, "  Über & Co. ", "über-co"),
        (X.file_base, "", "export"),
        (X.seconds, "2m59.56s", 179.56),
        (X.seconds, "250ms", 0.25),
        (X.seconds, "soon", None),
        (X.redact, "https://a.b/?password=abc&u=1", "https://a.b/?password=•••&u=1"),
        (X.redact, "Authorization: Bearer abcdefghijkl", "Authorization: •••"),
        (X.redact, "key gsk_abcdefgh12345678 bad", "key ••• bad"),
        (X.unfinished, "A long title ...", "A long title"),
        (X.unfinished, "ab…", None),
        (W.base_domain, "www.shop.example.co.uk", "example.co.uk"),
        (W.clean_website, "example.org/", "https://example.org"),
        (W.clean_website, "https://www.linkedin.com/in/x", None),
        (W.clean_website, "no address", None),
        (W.clean_linkedin, "//de.linkedin.com/IN/anna?x=1", "https://www.linkedin.com/in/anna"),
        (W.country_tld, " Österreich ", ".at"),
        (W.country_tld, "Nowhere", None),
        (W.role_of, "Geschäftsführer", "ceo"),
        (W.role_of, "GESCHÄFTSFÜHRERIN", "ceo"),
        (W.role_of, "Head of Purchasing", "purchasing"),
        (W.role_of, "Author / IP Owner", None),
        (W.role_of, "Éditeur", None),
        (W.role_of, "Sales representative", None),
        (W.is_private_ip, "10.1.2.3", True),
        (W.is_private_ip, "8.8.8.8", False),
        (W.is_private_ip, "::ffff:127.0.0.1", True),
        (W.is_private_ip, "2606:4700::1", False),
        (W.is_private_ip, "not an address", True),
        (W.emails_in, "a.b@x.org, c@y.co.uk.", ["a.b@x.org", "c@y.co.uk"]),
        (W.phones_in, "Tel. +49 (30) 123456-78 or 12", ["+49 (30) 123456-78"]),
        (W.is_generic_mailbox, "Info@x.org", True),
        (W.sites_in, "see https://a.org/x, https://a.org/y and http://b.org.", ["https://a.org", "http://b.org"]),
        (C.as_name, "Dr. Anna Meier", "Dr. Anna Meier"),
        (C.as_name, "by Anna Meier,", "Anna Meier"),
        (C.as_name, "Les Argonautes", None),
        (C.as_name, "Anna", None),
        (C.as_name, "Marketing Director", None),
        (H.page_text, "<p>a<script>var x='</p>'</script><b>b &amp; c</p>", "a b & c"),
        (H.page_lines, "<head><title>t</title></head><nav>n</nav><p>one<br>two<p>three", ["n", "one", "two", "three"]),
        (H.inert, '<a href="javascript:x()" onclick="y()">z</a><script>1</script>', '<a href="">z</a>'),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_patterns(spark):
    row = spark.createDataFrame([("https://x.org/c/a-b?t=1", "a-b"), ("https://x.org/ca-b", "a-b"), ("https://x.org/c/a", "a")], "h string, v string")
    assert [r[0] for r in row.select(W.pattern_from("h", "v")).collect()] == ["https://x.org/c/{v}?t=1", None, None]
    assert row.select(W.fill_pattern("https://x.org/{v}", F.lit("a b/c"))).first()[0] == "https://x.org/a%20b/c"
    assert row.select(W.same_site(F.lit("https://www.x.org/1"), F.lit("http://shop.x.org"))).first()[0]
    assert row.select(W.email_belongs_to(F.lit("a.meier@x.org"), F.lit("Dr. Anna Meier"))).first()[0]
    assert row.select(X.carries_secret(F.lit("q=p%40ss"), "p@ss")).first()[0]


def test_company_page(spark):
    html = "<title>Achse Verlag</title><h1>Bücher</h1><p>Achse Verlag GmbH, Berlin</p>"
    df = spark.createDataFrame([("Achse Verlag GmbH", html, "https://www.achse.de/"), ("Other House", html, "https://www.achse.de/"), ("Achse", "<title>Achse</title>this domain is for sale: domain is for sale", "https://achse.de"), ("66 Books", "<title>Sixty</title>", None)], "n string, h string, u string")
    assert [r[0] for r in df.select(C.looks_like_company("n", "h", F.col("u"))).collect()] == [True, False, False, False]


def test_roles_are_found_whatever_the_case(spark):
    """role_of looks at most texts once; what is passed over there must hold no role by the patterns one by one."""
    from functools import reduce

    said = ["Founder", "FOUNDER", "co-fouNder", "vorſtand", "DİRECTOR", "dırector", "KOO", "ÉDITEUR", "xéditeur", "Prezes", "WŁAŚCICIEL", "der Verlegerin", "kein Titel", "", None, "chief happy officer", "Assistant to the CEO", "lıcensing manager", "rights & LICENSING", "ceos", "einkaufſ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string")
    cases = reduce(lambda out, x: out.when(F.coalesce("t", F.lit("")).rlike(f"(?iu){W._starts(x[1])}"), x[0]), W.ROLES, F.when(F.lit(False), ""))
    rows = df.select("t", W.role_of("t").alias("a"), F.when(~W.is_excluded_title("t"), cases).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and {"owner", "md", "decision", "purchasing", "ceo"} <= {r["a"] for r in rows}
    plan = df.select(W.role_of("t").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan  # most texts are passed over by one pattern on their lower case


def test_only_runs_beyond_ascii_are_normalised_in_python(spark):
    import random
    import unicodedata

    signs, rng = ["a", "e", "K", "\n", "\n\n", " ", "́", "̣", "é", "ﬁ", "Ａ", "가", "ᄀ", "ᅡ", "ᆨ", " ", "\x85", "½", "😀", "\x01", "İ", "日本", "<", " "], random.Random(5)
    said = ["", None, "plain", "́", "á", "\ń\n", "é\n", *("".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(500))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").select("t", X.nfkc("t").alias("n"))
    assert [r["n"] for r in df.collect()] == [x and unicodedata.normalize("NFKC", x) for x in said]
    assert "regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString()
