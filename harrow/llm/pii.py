"""PII: regular expressions propose spans, checksums and other validators confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and validator hold. The further kinds, iban
(confirmed by its remainder mod 97), access_key (the published form of a service's keys), secret (a random-looking value) and
card_like (a card-length number that fails Luhn) are reported if their score, raised or lowered by the words around them, reaches
THRESHOLD. A secret starts low: it needs such a word as "password" beside it.
Texts are read whole; positions are code points, ends exclusive.

Defined results: null and empty texts have no spans. Rows are judged one by one, so that repeated ids keep their own
results; other columns pass through, but for one named like the one added, which it replaces.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "access_key", "secret", "card_like")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) finds them, in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A candidate takes in what follows if it looks like a further group; _ibans cuts it.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}(?![A-Za-z0-9_/+-])")
#: The published forms of access keys.
ACCESS_KEY = re.compile(
    r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9_])"
)
#: The lengths of IBANs by country (ISO 13616 registry).
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Starting scores, and what a word among the NEAR code points before or after adds or takes away.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "access_key": 0.8, "secret": 0.3, "card_like": 0.2}
NEAR = 40
THRESHOLD = 0.6
CONTEXT = {
    "card": {"card": 0.15, "visa": 0.15, "mastercard": 0.15, "credit": 0.15, "karte": 0.15, "carte": 0.15, "tarjeta": 0.15, "order": -0.2, "isbn": -0.4},
    "card_like": {"card": 0.4, "visa": 0.4, "mastercard": 0.4, "cvv": 0.4, "kreditkarte": 0.4, "tarjeta": 0.4},
    "phone": {"phone": 0.2, "tel": 0.2, "call": 0.1, "mobile": 0.2, "telefon": 0.2, "fax": 0.1},
    "ip": {"ip": 0.2, "address": 0.1, "server": 0.1, "version": -0.4, "section": -0.3},
    "email": {"mail": 0.05, "email": 0.05, "contact": 0.05, "example": -0.1},
    "iban": {"iban": 0.2, "bank": 0.1, "account": 0.1, "konto": 0.1, "compte": 0.1, "cuenta": 0.1},
    "access_key": {"example": -0.3},
    "secret": {"token": 0.5, "secret": 0.5, "password": 0.5, "passwd": 0.5, "apikey": 0.5, "key": 0.4, "bearer": 0.5, "commit": -0.4, "sha": -0.4, "checksum": -0.4},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def random_looking(value: str) -> bool:
    """Digits and letters both, and more than 2.5 bits a character."""
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return bits > 2.5 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = set(re.findall(r"[^\W\d_]+", around.lower()))
    return min(1.0, max(0.0, START[kind] + sum(x for w, x in CONTEXT[kind].items() if w in words)))


def _emails(text: str):
    """What EMAIL.finditer gives, looking only around each @; the run of name characters before it may be cut by the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        name = LOCAL.search(text[max(done, _run_start(text, at, done)) : at])
        m = EMAIL.match(text, at - len(name[0])) if name else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _NAME:
        at -= 1
    return at


def _ibans(text: str):
    """(start, end) of each candidate cut to its country's length; of a country without one, to the longest run of whole groups that mod97 confirms."""
    m = IBAN.search(text)
    while m:
        start, compact = m.start(), [i for i in range(m.start(), m.end()) if text[i] != " "]
        known = IBAN_LENGTHS.get(text[start : start + 2])
        sizes = [known] if known else range(len(compact), 11, -1)
        ends = [compact[n - 1] + 1 for n in sizes if n <= len(compact)]
        ends = [e for e in ends if e == m.end() or text[e] == " "]
        end = next((e for e in ends if mod97(text[start:e].replace(" ", ""))), None)
        if end:
            yield start, end
        m = IBAN.search(text, end or start + 1)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of KINDS, then start."""
    found = [("email", m.start(), m.end()) for m in _emails(text)]
    digits = re.search("[0-9]", text)  # kinds that have one
    if digits:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        cards = [(m.start(), m.end(), digits_of(m[0])) for m in CARD.finditer(text)]
        cards = [x for x in cards if 13 <= len(x[2]) <= 19]
        found += [("card", a, b) for a, b, d in cards if luhn(d)]
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
        found += [("iban", a, b) for a, b in _ibans(text)]
    keys = [(m.start(), m.end()) for m in ACCESS_KEY.finditer(text)]
    found += [("access_key", a, b) for a, b in keys]
    if digits:
        found += [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if random_looking(m[0]) and m.span() not in keys]
        found += [("card_like", a, b) for a, b, d in cards if not luhn(d)]
    scored = [(k, a, b, score(k, text, a, b)) for k, a, b in found]
    return [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with an array of spans (kind, start, end, score) added."""

    @F.pandas_udf(SPANS)
    def find(t: pd.Series) -> pd.Series:
        return t.map(lambda s: [{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in spans_of(s or "")])

    return docs.withColumn(out, find(text))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of overlapping spans the first and longest counts."""

    @F.pandas_udf("string")
    def cover(t: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            out, done = [], 0
            for kind, a, b, _ in sorted(spans_of(s), key=lambda x: (x[1], -x[2])):
                if a >= done:
                    out += [s[done:a], f"[{kind}]"]
                    done = b
            return "".join([*out, s[done:]])

        return t.map(one)

    return docs.withColumn(text, cover(text))


def op6_pii(spark, sf_dir) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("pii", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    added = (F.size("pii") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"), added)


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict = {}
