"""Scalar text functions as Column expressions. Python is used only where Unicode normalisation needs it, on non-ASCII values alone.

Word boundaries are those of ASCII words and white space includes the non-breaking kinds, as in the web pages' own scripts.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(c) -> Column:
    """Null as the empty text."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside of array functions Spark computes an expression again wherever it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def filled(c) -> Column:
    return text(c) != ""


def clean(c) -> Column:
    """White space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(_c(c), f"[{WS}]+", " "), "^ | $", "")


#: What normalisation can change: characters beyond ASCII with the one before them. No character composes with an ASCII one after it, and none with a line end before it.
RUN = r"[\x00-\x09\x0B-\x7F]?[^\x00-\x7F]+"


def nfkc(c) -> Column:
    """NFKC of a text. Only its runs beyond ASCII go to Python, as lines, and are put back between what lies around them: whole pages would fill its batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    c = _c(c)
    ascii_only = F.octet_length(c) == F.length(c)
    runs = F.array_join(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), "\n")
    normal = F.split(run(F.when(~ascii_only, runs)), "\n", -1)
    return F.when(ascii_only, c).otherwise(F.array_join(F.zip_with(F.split(c, RUN, -1), normal, lambda around, x: F.concat(around, F.coalesce(x, F.lit("")))), ""))


@functools.cache
def _bare_letters() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters; derived from the Unicode tables."""
    pairs = []
    for x in map(chr, range(0x80, 0x10000)):
        base = "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.category(k).startswith("M"))
        if len(base) == 1 and base != x:
            pairs.append((x, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c) -> Column:
    """Lower case without accents, white space collapsed. All in the JVM, so that it can be used inside of array functions; a letter that decomposes to
    several stays."""
    letters, bare = _bare_letters()
    c = F.lower(_c(c))
    plain_text = F.regexp_replace(F.translate(c, letters, bare), r"\p{M}", "")
    return clean(F.when(F.octet_length(c) == F.length(c), c).otherwise(plain_text))


def norm(c) -> Column:
    """Comparable form of a cell: no tags, entities as blanks, NFKC, lower case, no punctuation at the ends."""
    s = F.regexp_replace(F.regexp_replace(text(c), "<[^>]+>", " "), r"&nbsp;|&amp;|&#\d+;", " ")
    s = F.regexp_replace(F.lower(nfkc(s)), f"[{WS}]+", " ")
    edge = f"[{WS}·•|,;:–-]+"
    return F.trim(F.regexp_replace(s, f"^{edge}|{edge}$", ""))


def company_key(name, country=None) -> Column:
    return F.substring(F.concat(fold(text(name)), F.lit("|"), fold(text(country)) if country is not None else F.lit("")), 1, 200)


def plain(c) -> Column:
    """The words of a cell that holds HTML; other cells stay as they are."""
    c = _c(c)
    s = F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/h[0-9])[^>]*>", "\n")
    s = F.regexp_replace(s, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    s = F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), r"\n\s*\n+", "\n")
    return F.when(c.rlike(r"(?i)<[a-z/][^>]*>"), F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")).otherwise(c)


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def humanize_key(path) -> Column:
    """A dotted path as a person would say it: its last named part in words, with the part before it if it is a general one."""
    path = _c(path)
    parts = F.filter(F.split(path, r"\."), lambda p: ~p.rlike("^[0-9]+$"))
    leaf = F.coalesce(F.get(parts, F.size(parts) - 1), path)
    parent = F.regexp_replace(F.regexp_replace(F.get(parts, F.size(parts) - 2), "(?i)ies$", "y"), "(?i)([^s])s$", "$1")
    general = (F.size(parts) > 1) & leaf.rlike("(?i)^(name|value|title|label|text|type|code|id)$")
    leaf = F.when(general, F.concat(parent, F.lit("_"), leaf)).otherwise(leaf)
    words = F.lower(F.trim(F.regexp_replace(F.regexp_replace(leaf, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")))
    return F.when(words == "", path).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000)))


def is_plumbing(path, boolean_sample=None) -> Column:
    """Ids, flags and counters: of use to programs, not to readers."""
    path = _c(path)
    leaf = _last(path)
    named = F.lower(leaf).rlike("(^|_)(id|uuid|guid|hash|key|token|order_num|sort|index)$") | leaf.rlike("Id$") | leaf.rlike("^(is|has|show|can)[A-Z_]") | path.rlike(r"(_count|\.count)$")
    return named | (F.coalesce(_c(boolean_sample), F.lit(False)) if boolean_sample is not None else F.lit(False))


def singular(word) -> Column:
    w = _c(word)
    cut = lambda n: F.substring(w, 1, F.greatest(F.length(w) - n, F.lit(0)))
    return F.when(w.rlike("(?i)ies$"), F.concat(cut(3), F.lit("y"))).when(w.rlike("(?i)ses$"), cut(2)).when(w.rlike("(?i)s$") & ~w.rlike("(?i)ss$"), cut(1)).otherwise(w)


def csv_field(c) -> Column:
    """A cell of a CSV line: a quote before what a spreadsheet would run as a formula, then quoting where needed."""
    s = text(c)
    safe = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def file_base(name) -> Column:
    s = F.regexp_replace(F.when(filled(name), text(name)).otherwise("export"), r"[^\p{L}\p{N}]+", "-")
    s = F.substring(F.lower(F.regexp_replace(s, "^-+|-+$", "")), 1, 60)
    return F.when(s == "", "export").otherwise(s)


def js_number(c) -> Column:
    """A double as web scripts write it: whole numbers without a fraction."""
    c = _c(c)
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def cell(c, kind: str) -> Column:
    """Any value as the text of a cell: null is empty, nested values are JSON."""
    c = _c(c)
    if kind in ("double", "float"):
        return F.coalesce(js_number(c.cast("double")), F.lit(""))
    if kind.startswith(("struct", "array", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return text(c)


JUNK = r"(?i)^(sign in|log ?in|register|register now|show (all|more)|read more|see (all|more)|more|back|next|previous|share|follow|menu|close|accept|cookie|home|marketplace|search|filters?)$"


def is_junk(c) -> Column:
    return text(c).rlike(JUNK)


def unfinished(c) -> Column:
    """What is there of a text cut off with dots; null if it isn't cut off, or to less than three characters."""
    prefix = F.trim(F.regexp_replace(_c(c), rf"(\.{{2,}}|…)[{WS}]*$", ""))
    return F.when(_c(c).rlike(rf"(\.{{2,}}|…)[{WS}]*$") & (F.length(prefix) >= 3), prefix)


def completed(c, candidates: Column) -> Column:
    """A text cut off with dots, completed from the first candidate that begins like it and is longer."""
    prefix = unfinished(c)
    longer = F.filter(candidates, lambda x: (F.length(x) > F.length(prefix)) & F.startswith(F.lower(x), F.lower(prefix)))
    return F.when(prefix.isNotNull(), F.coalesce(F.get(longer, 0), _c(c))).otherwise(_c(c))


def seconds(duration) -> Column:
    """"2m59.56s" as 179.56; hours, minutes, seconds and milliseconds; null without any."""
    d = _c(duration)
    unit = lambda u, x: F.coalesce(F.regexp_extract(d, rf"([0-9]+(?:\.[0-9]+)?){u}", 1).try_cast("double"), F.lit(0.0)) * x
    total = unit("h", 3600) + unit("m(?!s)", 60) + unit("(?<!m)s", 1) + unit("ms", 0.001)
    return F.when(d.rlike(r"[0-9](h|ms|m|s)"), total)


def redact(c, secrets: tuple[str, ...] = ()) -> Column:
    """Secrets given, and whatever looks like one, replaced by dots."""
    dots, s = "•••", text(c)
    for secret in secrets:
        if secret:
            s = F.replace(s, F.lit(secret), F.lit(dots))
    s = F.regexp_replace(s, "gsk_[A-Za-z0-9]{8,}", dots)
    s = F.regexp_replace(s, rf"(?i){START}Bearer\s+[A-Za-z0-9._~+/=-]{{8,}}", dots)
    s = F.regexp_replace(s, rf"(?i){START}(password|passwd|pwd|pass)=[^&\s\"']+", f"$1={dots}")
    return F.regexp_replace(s, rf"(?i){START}(cookie|set-cookie):\s*[^\n]+", dots)


def carries_secret(c, secret: str) -> Column:
    """Whether a text holds a secret as it is, URL-encoded, in JSON or in base64."""
    import base64
    import json
    from urllib.parse import quote

    forms = dict.fromkeys([secret, quote(secret, safe="-_.!~*'()"), json.dumps(secret, ensure_ascii=False)[1:-1], base64.b64encode(secret.encode()).decode()])
    found = F.lit(False)
    for form in forms:
        found = found | text(c).contains(form)
    return found


def seal(c, key: str, expires: Column) -> Column:
    """A value encrypted with its time of expiry (seconds); key: 16, 24 or 32 characters."""
    return F.base64(F.aes_encrypt(F.to_json(F.struct(_c(c).alias("v"), expires.cast("long").alias("x"))), F.lit(key), F.lit("GCM")))


def unseal(c, key: str, now: Column) -> Column:
    """What seal kept; null if it is not whole, or expired."""
    opened = F.from_json(F.try_aes_decrypt(F.unbase64(_c(c)), F.lit(key), F.lit("GCM")).cast("string"), "v string, x long")
    return F.when(opened["x"] >= now, opened["v"])
