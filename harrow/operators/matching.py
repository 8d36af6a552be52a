"""Matching what a page shows with the feed behind it.

Page columns and feed fields are in long form: page (list_id, col_key, col_ord, row_idx, value, attr) and feed (feed_id, key,
key_ord, row_idx, value). Scores come from equi-joins of distinct comparable values, so that a column of any length costs
a shuffle of its distinct values and no pairs of rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import norm, plain, text
from harrow.session import written

LEAST = 0.55


def column_scores(page: DataFrame, feed: DataFrame, comparable=norm) -> DataFrame:
    """(list_id, col_key, col_ord, feed_id, key, key_ord, score) of each pair that shares a value: the share of page rows found, of the smaller
    side, weighted by how distinct the page's values are. Columns with fewer than two values score nothing."""
    shown = page.withColumn("v", comparable(F.col("value"))).where("v <> ''")
    kept = feed.withColumn("v", comparable(F.col("value"))).where("v <> ''").groupBy("feed_id", "key", "key_ord", "v").agg(F.lit(1).alias("one"))
    by_value = shown.groupBy("list_id", "col_key", "col_ord", "v").agg(F.count("*").alias("n"), F.max("attr").alias("attr"))
    by_value, kept = written(by_value, "shown"), written(kept, "fields")  # distinct values, each read several times
    exact = by_value.join(kept, "v").select("list_id", "col_key", "col_ord", "feed_id", "key", "key_ord", "v", "n")
    hits = exact.unionByName(_link_hits(by_value, kept)).groupBy("list_id", "col_key", "col_ord", "feed_id", "key", "key_ord", "v").agg(F.max("n").alias("n"))
    hits = hits.groupBy("list_id", "col_key", "col_ord", "feed_id", "key", "key_ord").agg(F.sum("n").alias("hits"))
    sizes = by_value.groupBy("list_id", "col_key").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"))
    fields = kept.groupBy("feed_id", "key").agg(F.count("*").alias("values"))
    score = F.least(F.lit(1.0), F.col("hits") / F.least("rows", "values")) * (0.6 + 0.4 * F.col("distinct") / F.col("rows"))
    joined = hits.join(sizes, ["list_id", "col_key"]).join(fields, ["feed_id", "key"]).where("rows >= 2")
    return joined.select("list_id", "col_key", "col_ord", "feed_id", "key", "key_ord", score.alias("score"))


def _link_hits(by_value: DataFrame, kept: DataFrame) -> DataFrame:
    """Links that hold a feed value of over three characters after a slash, up to the next slash or question mark or the end, and images that end in one of over
    eight, its scheme aside. Only pieces as long as some feed value that begins with a part of a link, or ends like an image, are cut from each distinct value and equi-joined: no
    pairs are tried, and a long path or address costs no more than its places times those lengths. Images written into the page (data:) end in nothing."""
    lengths = lambda values, c: F.broadcast(values.agg(F.collect_set(F.length(c)).alias("lengths")))  # noqa: E731  one row, of no more numbers than the longest value has characters
    links = by_value.where("attr = 'href'")
    parts = F.regexp_extract_all("v", F.lit(r"(?<=/)(?=([/?]*[^/?]*))"), F.lit(1))
    known = links.select(F.explode(parts).alias("_part")).distinct()
    long, signs = kept.where(F.length("v") > 3), F.col("v").rlike("^[/?]+$")  # a value of such signs alone may begin any part
    held = long.where(~signs).withColumn("_part", F.regexp_extract("v", "^([/?]*[^/?]*)", 1)).join(known, "_part", "left_semi").drop("_part").unionByName(long.where(signs))
    # where parts end: the place of the sign after each, and one past the end
    ends = lambda pattern: F.aggregate(F.split("v", pattern), F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + 1)))
    placed = links.crossJoin(lengths(held, "v")).withColumn("_ends", ends("[/?]")).select("*", F.explode(F.filter(ends("/"), lambda x: (x > 0) & (x <= F.length("v")))).alias("_slash"))
    stops = F.array_intersect("_ends", F.transform("lengths", lambda n: F.col("_slash") + n + 1))
    pieces = placed.withColumn("part", F.explode(F.transform(stops, lambda e: F.substring(F.col("v"), F.col("_slash") + 1, e - F.col("_slash") - 1)))).drop("_ends", "_slash", "lengths").distinct()
    found = pieces.join(held.withColumnRenamed("v", "part"), "part")
    images = by_value.where("attr = 'src' AND v NOT LIKE 'data:%'")
    tail = lambda c: F.right(c, F.lit(3))  # noqa: E731  no value of over eight is shorter without its scheme
    bare = kept.where(F.length("v") > 8).withColumn("part", F.regexp_replace("v", "^https?:", "")).drop("v").withColumn("_tail", tail(F.col("part")))
    bare = bare.join(images.select(tail(F.col("v")).alias("_tail")).distinct(), "_tail", "left_semi").drop("_tail")
    suffixes = F.transform(F.filter("lengths", lambda n: n <= F.length("v")), lambda n: F.right(F.col("v"), n))
    seen = images.crossJoin(lengths(bare, "part")).withColumn("part", F.explode(suffixes)).join(bare, "part")
    columns = ["list_id", "col_key", "col_ord", "feed_id", "key", "key_ord", "v", "n"]
    return found.select(columns).unionByName(seen.select(columns))


def pairs(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """One field at most for each column: columns choose in order, the best field not yet taken, the first of equals."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, own in g.sort_values(["col_ord", "score", "key_ord"], ascending=[True, False, True]).groupby("col_ord", sort=True):
            free = own[~own["key"].isin(taken)]
            if len(free):
                out.append(free.iloc[[0]])
                taken.add(free.iloc[0]["key"])
        return pd.concat(out)

    good = scores.where(F.col("score") >= least).select("list_id", "col_key", "col_ord", "feed_id", "key", "key_ord", "score")
    return good.groupBy("list_id", "feed_id").applyInPandas(choose, good.schema)  # a group is columns by fields of one list and feed


def best_match(chosen: DataFrame, lists: DataFrame, feeds: DataFrame) -> DataFrame:
    """The feed of each list. lists (list_id, columns, count), feeds (feed_id, feed_ord, rows). More of the list's columns and a feed of
    at least four fifths of its rows count for more; two pairs are needed, or one strong one for a list of up to two columns."""
    sums = chosen.groupBy("list_id", "feed_id").agg(F.sum("score").alias("total"), F.count("*").alias("pairs"), F.min_by("score", "col_ord").alias("first_score"))
    fit = F.when(F.col("rows") >= F.col("count") * 0.8, 1.0).otherwise(0.6)
    score = F.col("total") * (0.5 + F.col("pairs") / F.greatest(F.col("columns"), F.lit(1))) * fit
    joined = sums.join(lists, "list_id").join(feeds, "feed_id").withColumn("match_score", score)
    joined = joined.where("pairs >= 2 OR (first_score > 0.85 AND columns <= 2)")
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("match_score"), "feed_ord"))
    return joined.withColumn("_r", rank).where("_r = 1").select("list_id", "feed_id", "pairs", "match_score")


def _first(df: DataFrame, key: str, order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def align_rows(page: DataFrame, feed: DataFrame, page_value: str, feed_value: str, comparable=norm) -> DataFrame:
    """(page_row, feed_row) of rows (with _ord) that share the anchor's value: the first feed row of a value, and the last page row."""
    left = page.select(F.col("_ord").alias("page_row"), comparable(F.col(page_value)).alias("v")).where("v <> ''")
    right = feed.select(F.col("_ord").alias("feed_row"), comparable(F.col(feed_value)).alias("v")).where("v <> ''")
    firsts = right.groupBy("v").agg(F.min("feed_row").alias("feed_row"))
    return left.groupBy("v").agg(F.max("page_row").alias("page_row")).join(firsts, "v").select("page_row", "feed_row")


def page_rows(page: DataFrame, feed: DataFrame, aligned: DataFrame, page_columns: dict[str, str], feed_columns: dict[str, str]) -> DataFrame:
    """Page rows with feed-only cells where they are aligned, else empty ones. The dicts give each output name its column."""
    f = feed.select(F.col("_ord").alias("feed_row"), *[F.col(c).alias(f"_f_{n}") for n, c in feed_columns.items()])
    joined = page.join(aligned, page["_ord"] == F.col("page_row"), "left").join(f, "feed_row", "left")
    return joined.select("_ord", *[text(c).alias(n) for n, c in page_columns.items()], *[text(plain(F.col(f"_f_{n}").cast("string"))).alias(n) for n in feed_columns])


def feed_rows(page: DataFrame, feed: DataFrame, page_anchor: str, feed_anchor: str, page_columns: dict[str, str], feed_columns: dict[str, str], comparable=norm) -> DataFrame:
    """Feed rows with page-only cells of the last page row that shows the anchor's value, else empty ones."""
    shown = page.withColumn("_v", comparable(F.col(page_anchor))).where("_v <> ''")
    last = _first(shown, "_v", F.desc("_ord")).select("_v", *[F.col(c).alias(f"_p_{n}") for n, c in page_columns.items()])
    joined = feed.withColumn("_v", comparable(F.col(feed_anchor))).join(last, "_v", "left")
    return joined.select("_ord", *[text(plain(F.col(c).cast("string"))).alias(n) for n, c in feed_columns.items()], *[text(f"_p_{n}").alias(n) for n in page_columns])


def extra_fields(fields: DataFrame, used: DataFrame, least_fill: float = 0.15) -> DataFrame:
    """Fields (key, fill, sample) that no column uses and that are filled enough to offer."""
    return fields.join(used.select("key").distinct(), "key", "left_anti").where((F.col("fill") > least_fill) & (F.coalesce("sample", F.lit("")) != ""))
