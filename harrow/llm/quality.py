"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is a Column over the text alone, so that the whole operator is a scan and a projection: no shuffle, no
Python. RULES gives each rule's ratio as two integer Columns, numerator and denominator, and its bounds; a document
fails a rule if its ratio lies outside. A rule whose denominator is 0 doesn't apply. Rules of one name, such as the stop-word
shares of the languages, are alternatives: a document fails the name if it fails all of them.

Defined results: a null or empty text has no words and fails the base rule. Rows are judged one by one, so that repeated
ids and rows keep their own results; other columns pass through, but for those named like the ones added, which they replace.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import documents, fresh

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
# Frequent function words of the languages served.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "it", "are"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "mit", "für", "den"],
    "fr": ["le", "la", "les", "et", "de", "des", "est", "un", "une", "que", "dans", "pour"],
    "es": ["el", "los", "las", "que", "y", "en", "es", "por", "con", "una", "para", "del"],
}


@dataclass(frozen=True)
class Rule:
    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0  # texts with fewer words are not judged by this rule


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.6),
    Rule("stop_words", "n_stop_en", "n_words", 0.04, None, 60),
    Rule("stop_words", "n_stop_de", "n_words", 0.04, None, 60),
    Rule("stop_words", "n_stop_fr", "n_words", 0.04, None, 60),
    Rule("stop_words", "n_stop_es", "n_words", 0.04, None, 60),
    Rule("capitals", "n_capitals", "word_chars", None, 0.5, 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 0.3),
)
BULLET, CUT = r"^[\x20\x09-\x0D]*[-*\u2022]", r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that the same array holds twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twins = lambda s: F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
        starts = F.array_sort(F.transform(let(pairs, twins), lambda x: x["p"]))
        begin = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, begin, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")))["n"]

    hashed = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
    counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))
    several = F.size(words) > width
    return F.when(several, let(let(F.transform(words, lambda x: F.xxhash64(x)), hashed), counted)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    among = lambda words, stops: F.size(F.filter(words, lambda x: x.isin(stops))).cast("long")

    def of_lines(lines: Column) -> Column:
        like = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            like(BULLET).alias("n_bullet_lines"),
            like(CUT).alias("n_cut_lines"),
        )

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            let(F.transform(words, F.lower), lambda low: F.struct(*[among(low, ws).alias(f"n_stop_{lang}") for lang, ws in STOP_WORDS.items()])).alias("stops"),
            let(lines, of_lines).alias("lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


LINES, STOPS = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines"), tuple(f"n_stop_{lang}" for lang in STOP_WORDS)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_bullet_lines", "n_cut_lines", *STOPS)


def by_name(rules) -> dict[str, list[Rule]]:
    """The alternatives of each name, in order."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(r.name, []).append(r)
    return out


def failed(rule: Rule, column) -> Column:
    over, under = column(rule.over), column(rule.under)
    judged = (under > 0) & (column("n_words") >= rule.from_words)
    low = over < under * rule.least if rule.least is not None else F.lit(False)
    high = over > under * rule.most if rule.most is not None else F.lit(False)
    return judged & (low | high)


def judge(docs: DataFrame, rules=RULES, prefix: str = "", text: str = "text") -> DataFrame:
    """docs with the measures, base_failed, failed_rules (names joined by commas) and kept added."""
    docs = docs.drop(*[prefix + n for n in (*MEASURES, "base_failed", "failed_rules", "kept")])
    own = fresh(docs, "_measures")
    inside = lambda n: "lines." if n in LINES else "stops." if n in STOPS else ""
    at = lambda n: F.col(f"{own}.{inside(n)}{n}")
    measured = docs.withColumn(own, measures(F.coalesce(F.col(text), F.lit(""))))
    base = (at("n_words") < 20) | (100 * at("n_repeat_words") > 30 * at("n_words"))
    all_of = lambda some: functools.reduce(lambda x, y: x & y, [failed(r, at) for r in some])
    reasons = F.concat_ws(",", *[F.when(all_of(some), F.lit(name)) for name, some in by_name(rules).items()])
    return measured.select(
        *docs.columns,
        *[at(n).alias(prefix + n) for n in MEASURES],
        base.alias(prefix + "base_failed"),
        reasons.alias(prefix + "failed_rules"),
        (~base & (reasons == "")).alias(prefix + "kept"),
    )


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    out = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES[5:], "failed_rules")


def _oracle() -> str:
    stops = ", ".join(f"len(list_filter(words, lambda x: lower(x) IN ({', '.join(repr(w) for w in ws)}))) AS n_stop_{lang}" for lang, ws in STOP_WORDS.items())

    def fails(r: Rule) -> str:
        sides = [f"{r.over} < {r.under} * {r.least}::DOUBLE"] * (r.least is not None) + [f"{r.over} > {r.under} * {r.most}::DOUBLE"] * (r.most is not None)
        return f"{r.under} > 0 AND n_words >= {r.from_words} AND ({' OR '.join(sides)})"

    reasons = ", ".join(f"CASE WHEN {' AND '.join(f'({fails(r)})' for r in some)} THEN '{name}' END" for name, some in by_name(RULES).items())
    like = lambda pattern: f"len(list_filter(lines, lambda x: regexp_matches(x, '{pattern.replace(chr(92) + 'u2022', '•').replace(chr(92) + 'u2026', '…')}')))"

    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8),
        g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win FROM i),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) AS t(k) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                     len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, {like(BULLET)} AS n_bullet_lines, {like(CUT)} AS n_cut_lines, {stops}
              FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {reasons}) AS failed_rules FROM m)
        SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {"op9_quality_rules": _oracle()}
