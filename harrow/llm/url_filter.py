"""URL filters: host and path rules and glob patterns, all of them simulated at once by one Shift-And automaton.

A pattern is a sequence of bytes with * for any run of bytes. The bytes of all patterns other than * are laid out one
after the other over the bits of a few 64-bit words; bit i means that the pattern is matched up to there. One step shifts
all words with carries, adds each pattern's start and keeps only the bits whose byte is the one read; a bit before a *
also stays. Many URLs step together, one byte of each at a time, as rows of a numpy matrix.

The automaton reads "." + host + SEPARATOR + path, so that a rule for a host covers it and its subdomains (a byte that
UTF-8 never uses separates host and path). Among the rules that fit, the longest (of host and path together) decides, then
block before allow, then the earlier. A URL that no rule fits is blocked if a glob fits it, else allowed.

Defined results: a null URL, or one without "://", has an empty host and path; it then fits no rule. Repeated rows keep
their own verdicts; other columns pass through, but for those named like the ones added, which they replace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import fresh

SEPARATOR = b"\xff"
ROWS = 4096  # URLs that step together


@dataclass(frozen=True)
class UrlRule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> list[bytes]:
        return [b"", b"." + self.host.encode() + SEPARATOR + self.path.encode(), b""]


# The rules asked for.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
#: Globs over host and path for what no rule decides: (host glob, path glob).
GLOBS = (
    ("*spam*", "*"),
    ("*cheap*pills*", "*"),
    ("*casino*", "*"),
    ("*porn*", "*"),
    ("*free*download*", "*"),
    ("*", "*/wp-login*"),
    ("*", "*/cart/*checkout*"),
    ("*", "*.exe"),
    ("*", "*.apk"),
)


def glob_pattern(host: str, path: str) -> list[bytes]:
    """The literal runs of a glob, between its stars."""
    return (b"." + host.encode() + SEPARATOR + path.encode()).split(b"*")


class ShiftAnd:
    """patterns: lists of literal runs, with a * between each two; the first run is anchored at the start, the last at the end."""

    def __init__(self, patterns: list[list[bytes]]):
        self.n = len(patterns)
        width = max(1, sum(len(b"".join(p)) for p in patterns))
        self.words = -(-width // 64)
        as_words = lambda: np.zeros(self.words, np.uint64)
        self.step, self.first, self.always, self.once, self.stay = np.zeros((256, self.words), np.uint64), as_words(), as_words(), as_words(), as_words()
        self.final, self.everything = np.full(self.n, -1), np.zeros(self.n, bool)
        bit = 0

        def put(words: np.ndarray, at: int) -> None:
            words[at // 64] |= np.uint64(1) << np.uint64(at % 64)

        for k, runs in enumerate(patterns):
            literal = b"".join(runs)
            if not literal:
                self.everything[k] = len(runs) > 1
                continue
            put(self.first, bit)
            put(self.once if runs[0] else self.always, bit)
            for c in literal:
                put(self.step[c], bit)
                bit += 1
            self.final[k] = bit - 1
            start, done = self.final[k] + 1 - len(literal), 0
            for run in runs[:-1]:  # a star follows each run but the last
                done += len(run)
                if done:
                    put(self.stay, start + done - 1)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text and a column for each pattern."""
        out = np.zeros((len(texts), self.n), bool)
        for a in range(0, len(texts), ROWS):
            out[a : a + ROWS] = self._some(texts[a : a + ROWS])
        return out

    def _some(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        joined, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
        state, one = np.zeros((len(texts), self.words), np.uint64), np.uint64(1)
        for t, n in enumerate(active.tolist()):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~self.first
            moved |= self.always | self.once if t == 0 else self.always
            state[:n] = (moved & self.step[joined[starts[:n] + t]]) | (now & self.stay)
        out = np.zeros((len(texts), self.n), bool)
        for k, at in enumerate(self.final.tolist()):
            out[order, k] = (sizes[order] == 0) | self.everything[k] if at < 0 else (state[:, at // 64] >> np.uint64(at % 64)) & one > 0
        return out


def host_and_path(url):
    """Host, A-Z lower-cased, and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(df: DataFrame, rules=RULES, globs=GLOBS, url: str = "url") -> DataFrame:
    """df with host, path, rule (its host and path, or null), glob (whether one fits) and verdict added."""
    df = df.drop("host", "path", "rule", "glob", "verdict")
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.action != "block"))
    automaton = ShiftAnd([r.pattern for r in ranked] + [glob_pattern(*g) for g in globs])
    names = np.array([r.text for r in ranked] + [None], object)
    actions = np.array([r.action for r in ranked], object)

    @F.pandas_udf("rule string, glob boolean, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        texts = [b"." + h.encode("utf-8", "surrogatepass") + SEPARATOR + p.encode("utf-8", "surrogatepass") for h, p in zip(host, path, strict=True)]
        hit = automaton.matches(texts)
        ruled, glob = hit[:, : len(ranked)], hit[:, len(ranked) :].any(axis=1)
        any_rule = ruled.any(axis=1)
        best = np.where(any_rule, ruled.argmax(axis=1) if len(ranked) else 0, len(ranked))
        verdict = np.where(glob, "block", "allow").astype(object)
        verdict[any_rule] = actions[best[any_rule]]
        return pd.DataFrame({"rule": names[best], "glob": glob, "verdict": verdict})

    host, path = host_and_path(F.col(url))
    own_host, own_path, by = (fresh(df, x) for x in ("_host", "_path", "_by"))
    split = df.withColumns({own_host: host, own_path: path}).withColumn(by, decide(own_host, own_path))
    return split.select(*df.columns, F.col(own_host).alias("host"), F.col(own_path).alias("path"), *[F.col(by)[x].alias(x) for x in ("rule", "glob", "verdict")])


def op4_url_filters(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)
    escape = lambda s: "".join(".*" if c == "*" else f"\\{c}" if not c.isalnum() else c for c in s)
    globs = " OR ".join(f"(regexp_full_match('.' || host, '(?s)\\.{escape(h)}') AND regexp_full_match(path, '(?s){escape(p)}'))" for h, p in GLOBS)
    return rf"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(action, rhost, rpath) AS (VALUES {rules}),
        f AS (SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) AS best
              FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT p.page_id, host, path, best.rule AS rule,
               CASE WHEN best IS NOT NULL THEN best.action WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict
        FROM p LEFT JOIN f USING (page_id)"""


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLE = {"op4_url_filters": _oracle()}
