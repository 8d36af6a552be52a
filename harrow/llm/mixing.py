"""Mixing sources to target weights: iterative proportional fitting, then sampling by the calibrated probabilities.

Documents fall into cells of source, language and topic. A cell's tokens are its words. Raking gives every source, language and
topic a factor, fitted in turn until the shares of tokens are their targets within TOLERANCE; a document is
then kept with a probability in proportion to the product of its three factors, decided by a hash of its id. Documents are
read twice, for the cells and for the sample, and never shuffled as long as the factors can be broadcast: only one row a cell and
task is. A fit is a join of the cells with tables of factors and a grouped sum with partial sums, so that neither many
sources nor one with a third of the cells makes one large task. Only DataFrame functions are used.

A table of factors has a row for each source, or for each pair of language and topic; it is broadcast if it can have at most
BROADCAST_ROWS rows (some MB), else joined by Spark's choice.

Targets: by default, sources, languages and topics move toward equal shares by the power TEMPERING of their own share; given
targets are shares by name, and names without one share what the others leave in proportion to their own.
Targets that no sample can meet, as they contradict each other on the cells there are, are noticed by a difference that stays (or
ROUNDS rounds): given ones raise ValueError, as do names that no document has and shares that don't add up; the default ones are
then met as far as the last round goes, and mix_gap says how far off the worst marginal is.
Topics: documents carry none, so that the default is only the shape of the text; a corpus with topics passes its own as topic_of, any Column.
The sample's size: the largest that the probabilities allow (the largest of a cell is 1), unless rate says less.

Defined results: null source, language or topic are values of their own (named ""). A text without words has no tokens; it is kept with the
probability of its values, or for certain if no text with words has its source, or its language with its topic. Repeated ids are kept or dropped together. Other columns pass
through, but for those named like the ones added, which they replace. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from harrow.llm.shared import documents, fresh, written

DIMENSIONS = ("source", "lang", "topic")
TEMPERING = 0.9
ROUNDS, TOLERANCE = 50, 1e-4
STALLED = 0.99  # of the difference before it: two rounds that gain no more end the fit
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def topic(text: Column) -> Column:
    """By the shape of the text: tables, lists of short lines, long or short prose."""
    size, lines = F.length(text), F.regexp_count(text, F.lit("\n")) + 1
    return F.when(text.contains(" | "), "table").when(size < 40 * lines, "list").when(size < 2000, "short").otherwise("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 by the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def placed(docs: DataFrame, topic_of: Column | None) -> tuple[DataFrame, list[str]]:
    """docs with their cell added, and the names of its columns, one a dimension."""
    names = [fresh(docs, f"_mix_{d}") for d in DIMENSIONS]
    values = [F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(topic(F.coalesce("text", F.lit(""))) if topic_of is None else topic_of, F.lit(""))]
    return docs.withColumns(dict(zip(names, values, strict=True))), names


def targets_for(shares: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(dimension, value, target) for shares (dimension, value, own): what targets name for a dimension's values, the rest in proportion to the own shares of
    values without one, or, for a dimension without any, powers of the own shares."""
    given = [F.lit(x) for d, some in targets.items() for name, share in some.items() for x in (f"{d}:{name}", float(share))]
    named = F.element_at(F.create_map(*given), F.concat_ws(":", "dimension", "value")) if given else F.lit(None).cast("double")
    left = F.create_map(*[F.lit(x) for d in DIMENSIONS for x in (d, 1.0 - sum(targets.get(d, {}).values()))])
    weight = F.when(F.col("dimension").isin([d for d in DIMENSIONS if targets.get(d)]), F.when(named.isNull(), F.col("own")).otherwise(0.0)).otherwise(F.pow("own", F.lit(TEMPERING)))
    weighed = shares.withColumns({"named": named, "weight": weight})
    wholes = weighed.groupBy("dimension").agg(F.sum("weight").alias("whole"))
    rest = F.element_at(left, F.col("dimension")) * F.col("weight") / F.when(F.col("whole") > 0, F.col("whole")).otherwise(1.0)
    return weighed.join(F.broadcast(wholes), "dimension").select("dimension", "value", F.coalesce("named", rest).alias("target"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, float, float]:
    """(source, f_source) and (lang, topic, f_lang, f_topic), marked to be broadcast if small, the largest product of three factors among cells, and the largest difference left.
    cells: written (source, lang, topic, tokens). A round sums the cells, scaled by their sources' factors, to languages and topics, fits those two, and
    fits the sources by another sum. It ends when no marginal was off its target by more than tolerance, or after so many rounds."""
    cells = cells.where("tokens > 0")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    sums = cells.select("tokens", each.alias("x")).groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("tokens"))
    sums = written(sums, "sums")
    sizes = {r["dimension"]: r for r in sums.groupBy("dimension").agg(F.count("*").alias("n"), F.sum("tokens").alias("total")).collect()}  # three rows
    total = sizes["source"]["total"] if sizes else 1.0
    small = lambda table, n: F.broadcast(table) if n <= BROADCAST_ROWS else table
    number = lambda d: sizes[d]["n"] if sizes else 0
    few, pairs = number("source"), number("lang") * number("topic")
    goals = written(targets_for(sums.select("dimension", "value", (F.col("tokens") / F.lit(total)).alias("own")), targets or {}), "targets")
    if sizes:
        check(targets or {}, sums, goals)
    goal = {d: goals.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("target").alias(f"target_{d}")) for d in DIMENSIONS}
    share = F.col("tokens") / F.lit(total)
    source = goal["source"].withColumn("f_source", F.lit(1.0))
    both = cells.select("lang", "topic").distinct().withColumns({"f_lang": F.lit(1.0), "f_topic": F.lit(1.0)})
    by = {d: Window.partitionBy(d) for d in ("lang", "topic")}  # over one row a pair of language and topic
    off = lambda rest, d: F.abs(rest * F.col(f"f_{d}") - F.col(f"target_{d}"))
    gap, gaps = 0.0, []
    for _ in range(rounds if sizes else 0):
        seen, grouped = [Observation(), Observation()], cells.join(small(source, few), "source").groupBy("lang", "topic").agg(F.sum(share * F.col("f_source")).alias("s"))
        fit = grouped.join(small(both, pairs), ["lang", "topic"]).join(small(goal["lang"], number("lang")), "lang").join(small(goal["topic"], number("topic")), "topic")
        fit = fit.withColumn("rest", F.sum(F.col("s") * F.col("f_topic")).over(by["lang"])).withColumns({"off_lang": off(F.col("rest"), "lang"), "f_lang": F.col("target_lang") / F.col("rest")})
        fit = fit.withColumn("rest", F.sum(F.col("s") * F.col("f_lang")).over(by["topic"])).withColumns({"off_topic": off(F.col("rest"), "topic"), "f_topic": F.col("target_topic") / F.col("rest")})
        both = written(fit.observe(seen[0], F.max(F.greatest("off_lang", "off_topic")).alias("off")).select("lang", "topic", "f_lang", "f_topic"), "factors")
        rest = cells.join(small(both, pairs), ["lang", "topic"]).groupBy("source").agg(F.sum(share * F.col("f_lang") * F.col("f_topic")).alias("rest"))
        fit = rest.join(small(source, few), "source").withColumn("off", off(F.col("rest"), "source"))
        source = written(fit.observe(seen[1], F.max("off").alias("off")).select("source", "target_source", (F.col("target_source") / F.col("rest")).alias("f_source")), "factors")
        gap = max(x.get["off"] or 0.0 for x in seen)
        gaps.append(gap)
        if gap <= tolerance or len(gaps) > 2 and gap > STALLED * gaps[-2] > STALLED**2 * gaps[-3]:
            break
    if targets and gap > tolerance:
        raise ValueError(f"no sample of these documents has the shares asked for: after {len(gaps)} rounds one is off by {gap:.4f}")
    source, both = small(source.select("source", "f_source"), few), small(both, pairs)
    most = cells.join(source, "source").join(both, ["lang", "topic"]).agg(F.max(F.col("f_source") * F.col("f_lang") * F.col("f_topic"))).first()[0]
    return source, both, most or 1.0, gap


def check(targets: dict[str, dict[str, float]], sums: DataFrame, goals: DataFrame) -> None:
    """Raises where targets are no shares of the values there are."""
    for d, some in targets.items():
        if d not in DIMENSIONS or any(not 0 < x <= 1 for x in some.values()) or sum(some.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {d} are no shares: {some}")
        found = {r["value"] for r in sums.where((F.col("dimension") == d) & F.col("value").isin(list(some))).select("value").collect()}  # of the names given
        if missing := sorted(set(some) - found):
            raise ValueError(f"no document has {d} {missing}")
    for r in goals.groupBy("dimension").agg(F.sum("target").alias("whole")).collect():  # three rows
        if abs(r["whole"] - 1) > 1e-6:
            raise ValueError(f"targets of {r['dimension']} add up to {r['whole']:.6f}, and no other value is left")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float | None = None, seed: str = SEED, topic_of: Column | None = None) -> DataFrame:
    """The documents kept, with their cell (mix_source, mix_lang, mix_topic), probability (mix_p) and what the fit is off by at most (mix_gap) added. topic_of: a document's topic, if not
    by its shape."""
    docs = docs.drop("mix_source", "mix_lang", "mix_topic", "mix_p", "mix_gap")
    out, names = placed(docs, topic_of)
    tokens = F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("double")).alias("tokens")
    cells = written(out.groupBy(*[F.col(n).alias(d) for n, d in zip(names, DIMENSIONS, strict=True)]).agg(tokens), "cells")
    source, both, most, gap = rake(cells, targets)
    product = fresh(out, "_mix_p" + "_" * max(map(len, out.columns)))
    source = source.toDF(f"{product}_source", f"{product}_fs")  # names that begin with product are the input's in no case
    both = both.toDF(f"{product}_lang", f"{product}_topic", f"{product}_fl", f"{product}_ft")
    out = out.join(source, F.col(names[0]) == F.col(f"{product}_source"), "left")
    out = out.join(both, (F.col(names[1]) == F.col(f"{product}_lang")) & (F.col(names[2]) == F.col(f"{product}_topic")), "left")
    p = F.least(F.lit(1.0), F.coalesce(F.col(f"{product}_fs") * F.col(f"{product}_fl") * F.col(f"{product}_ft") / F.lit(most), F.lit(1.0))) * F.lit(1.0 if rate is None else float(rate))
    kept = out.withColumn(product, p).where(uniform(F.col("doc_id"), seed) < F.col(product))
    return kept.select(*docs.columns, *[F.col(n).alias(f"mix_{d}") for n, d in zip(names, DIMENSIONS, strict=True)], F.col(product).alias("mix_p"), F.lit(gap).alias("mix_gap"))


def op7_mixing(spark, sf_dir) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "mix_source", "mix_lang", "mix_topic", F.round("mix_p", 6).alias("p"))


def _oracle(docs: str = "documents", rounds: int = 9) -> str:
    """SQL with so many rounds written out, more than the tolerance takes; the first one that is within it counts."""
    steps = [f"f0_{d} AS (SELECT {d} AS value, 1.0::DOUBLE AS factor FROM c GROUP BY ALL)" for d in DIMENSIONS]
    goals = [f"""t_{d} AS MATERIALIZED (SELECT value, power(own, {TEMPERING}) / sum(power(own, {TEMPERING})) OVER () AS target
                 FROM (SELECT {d} AS value, sum(tokens) / (SELECT sum(tokens) FROM c) AS own FROM c GROUP BY ALL))""" for d in DIMENSIONS]  # fmt: skip
    last = {d: f"f0_{d}" for d in DIMENSIONS}
    for i in range(1, rounds + 1):
        for d in ("lang", "topic", "source"):
            x, y = (o for o in DIMENSIONS if o != d)
            steps.append(f"""f{i}_{d} AS MATERIALIZED (SELECT value, target / rest AS factor, abs(rest * o.factor - target) AS gap
                             FROM (SELECT c.{d} AS value, sum(tokens / (SELECT sum(tokens) FROM c) * a.factor * b.factor) AS rest
                                   FROM c JOIN {last[x]} a ON a.value = c.{x} JOIN {last[y]} b ON b.value = c.{y} GROUP BY ALL) JOIN {last[d]} o USING (value) JOIN t_{d} USING (value))""")
            last[d] = f"f{i}_{d}"
    every = " UNION ALL ".join(f"SELECT {i} AS i, '{d}' AS d, value, factor, gap FROM f{i}_{d}" for i in range(1, rounds + 1) for d in DIMENSIONS)
    join = lambda kind, t: " ".join(f"{kind} JOIN f f_{d} ON f_{d}.d = '{d}' AND f_{d}.value = {t}.{d}" for d in DIMENSIONS)
    product = " * ".join(f"f_{d}.factor" for d in DIMENSIONS)
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM {docs}),
        t AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::DOUBLE AS tokens,
                     CASE WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 40 * (len(string_split(text, chr(10)))) THEN 'list'
                          WHEN length(text) < 2000 THEN 'short' ELSE 'long' END AS topic FROM d),
        c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM t GROUP BY ALL HAVING sum(tokens) > 0),
        {", ".join(goals)},
        {", ".join(steps)},
        a AS MATERIALIZED ({every}),
        f AS MATERIALIZED (SELECT * FROM a WHERE i = (SELECT coalesce(min(i), {rounds}) FROM (SELECT i FROM a GROUP BY i HAVING max(gap) <= {TOLERANCE}))),
        m AS (SELECT max({product}) AS most FROM c {join("", "c")}),
        k AS (SELECT DISTINCT lang, topic, true AS known FROM c),
        p AS (SELECT doc_id, source, lang, topic, least(1.0, CASE WHEN known THEN coalesce({product} / (SELECT most FROM m), 1.0) ELSE 1.0 END) AS p
              FROM t {join("LEFT", "t")} LEFT JOIN k USING (lang, topic))
        SELECT doc_id, source AS mix_source, lang AS mix_lang, topic AS mix_topic, round(p, 6) AS p
        FROM p WHERE ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p"""


QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": _oracle()}
