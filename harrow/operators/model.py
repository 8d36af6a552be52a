"""The plan behind a table on screen: which rows and columns count, what can be filled, how far to read, and what a finished job says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import clean, filled, humanize_key, nfkc, text


def has_content(columns: list[str]) -> Column:
    """Whether a row has something in any of the chosen page columns; every row has if none is chosen."""
    found = F.lit(not columns)
    for c in columns:
        found = found | filled(c)
    return found


def visible_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows but for the empty slots of a page. Their number is the list's row count."""
    return rows.where(has_content(columns))


def page_only(columns: DataFrame) -> DataFrame:
    """Columns (name, on, page_key, feed_key) that are on and that only the page fills: blank for rows beyond the screen."""
    return columns.where(F.col("on") & F.col("page_key").isNotNull() & F.col("feed_key").isNull())


def anchors(pairs: DataFrame) -> DataFrame:
    """(list_id, feed_id, col_key, key, score): the strongest pair of each match, the first of equals: rows are aligned by it."""
    best = F.max_by(F.struct("col_key", "key", "score"), F.struct("score", -F.col("col_ord"))).alias("x")
    return pairs.groupBy("list_id", "feed_id").agg(best).select("list_id", "feed_id", "x.col_key", "x.key", "x.score")


def trial_summary(found: DataFrame) -> DataFrame:
    """One row of counts over looked-up companies (website, people: array of structs with email and linkedin, company_linkedin)."""
    people = F.coalesce(F.size("people"), F.lit(0)) > 0
    has = lambda f: F.coalesce(F.exists("people", lambda p: filled(p[f])), F.lit(False))
    return found.agg(
        F.count("*").alias("looked"),
        F.count_if(filled("website")).alias("website"),
        F.count_if(people).alias("person"),
        F.count_if(has("email")).alias("email"),
        F.count_if(filled("company_linkedin") | has("linkedin")).alias("linkedin"),
    )


def finish_line(rows: DataFrame) -> DataFrame:
    """(rows, with_email): a finished table's rows, and those with an address in some cell that is no source or confidence."""
    cells = [c for c in rows.columns if not any(w in c.lower() for w in ("source", "confidence"))]
    any_mail = F.lit(False)
    for c in cells:
        any_mail = any_mail | text(F.col(f"`{c}`")).contains("@")
    return rows.agg(F.count("*").alias("rows"), F.count_if(any_mail).alias("with_email"))


def rows_to_fetch(limit: int | None, country: str | None = None, from_feed: bool = True) -> int | None:
    """How many feed rows a plan with a limit needs: a fifth and forty more, for repeated names; all (None) with a country filter, or without a limit."""
    return -(-limit * 6 // 5) + 40 if limit and not country and from_feed else None


def early_stop(pages: DataFrame, by: list[str], most: int, page: str = "page", rows: str = "rows") -> DataFrame:
    """The pages of each feed up to the one with which so many rows are there."""
    before = F.coalesce(F.sum(rows).over(Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def next_pages(pages: DataFrame, read: DataFrame, by: list[str], n: int = 1, page: str = "page") -> DataFrame:
    """The next so many pages of each feed after those read (by…, page): continuing a feed on demand."""
    done = read.groupBy(*by).agg(F.max(page).alias("_done"))
    left = pages.join(done, by, "left").where(F.col(page) > F.coalesce("_done", F.lit(-1)))
    return left.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(page))).where(F.col("_r") <= n).drop("_r", "_done")


def until_no_progress(batches: DataFrame, by: list[str], most: int = 3, order: str = "batch", rows: str = "rows") -> DataFrame:
    """Batches with resume (where to go on after each: the rows so far) and stalled, up to the last of so many empty ones in a row."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    empty = F.min((F.col(rows) == 0).cast("int")).over(w.rowsBetween(1 - most, 0)) == 1
    full = F.count("*").over(w.rowsBetween(1 - most, 0)) == most
    marked = batches.withColumns({"resume": F.sum(rows).over(so_far), "stalled": empty & full})
    stop = F.min(F.when(F.col("stalled"), F.col(order))).over(Window.partitionBy(*by))
    return marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


# Parts of addresses and paths that name no dataset.
NO_TITLE = r"(?i)^(data|list|items|results|api|v\d+|get|post|search|output|records|rows)$"


def feed_title(json_path, endpoint) -> Column:
    """What to call a feed that nothing on screen names: the last telling part of its path and address."""
    parts = F.concat(F.split(text(json_path), r"\."), F.split(text(endpoint), r"[\s/]"))
    telling = F.filter(parts, lambda s: (s != "") & ~s.rlike(r"^\d+$") & ~s.rlike(NO_TITLE) & ~s.contains("."))
    return humanize_key(F.coalesce(F.get(telling, F.size(telling) - 1), F.lit("data")))


def appended(rows: DataFrame, more: DataFrame, order: str = "_ord") -> DataFrame:
    """Rows on screen and those of pages browsed after, in one order; columns that one side lacks are empty there."""
    shift = rows.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_shift"))
    return rows.unionByName(more.crossJoin(shift).withColumn(order, F.col(order) + F.col("_shift")).drop("_shift"), allowMissingColumns=True)


def item_norm(c) -> Column:
    """Comparable form of a text on an item page: NFKC, lower case, white space collapsed."""
    return clean(F.lower(nfkc(text(c))))


# Endings of addresses that people write without a scheme.
ENDINGS = "com|de|org|net|eu|io|co|uk|fr|it|es|at|ch|nl|pl|info|biz"


def url_in(c) -> Column:
    """The first web address that a message names, with its scheme; null if it names none."""
    found = F.regexp_extract(text(c), r"(?i)https?://[^\s<>\"']+|(?<![A-Za-z0-9_])(?:[a-z0-9-]+\.)+(?:" + ENDINGS + r")(?:/[^\s<>\"']*)?", 0)
    bare = F.regexp_replace(found, r"[),.;!?]+$", "")
    return F.when(bare != "", F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare)))


def estimate_seconds(companies) -> Column:
    """How long looking so many companies up takes: thirteen seconds each, twelve at a time, and five to begin."""
    n = F.col(companies) if isinstance(companies, str) else companies
    return F.ceil(n * 13 / 12) + 5


def saved_recipes(saved: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    """Recipes (id, name, updated, …) with new ones added: a new one replaces those of its id or its name, whatever the case, and only the newest so many stay."""
    by_id = saved.join(new.select("id").distinct(), "id", "left_anti")
    name = lambda df: df.withColumn("_name", F.lower(F.trim(text("name"))))
    kept = name(by_id).join(name(new).select("_name").distinct(), "_name", "left_anti").drop("_name")
    once = new.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated")))).where("_r = 1").drop("_r")
    return kept.unionByName(once).orderBy(F.desc("updated"), "id").limit(most)
