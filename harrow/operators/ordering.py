"""Operators on ordered rows: every frame carries its order, and first or last always means by it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import filled
from harrow.session import written


def distinct_rows(rows: DataFrame, columns: list[str], order: list) -> DataFrame:
    """The first of rows that are equal in all columns, across pages."""
    w = Window.partitionBy(*columns).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fresh_by_page(rows: DataFrame, columns: list[str], page: str = "page", by: list[str] | None = None) -> DataFrame:
    """(by…, page, fresh) of each page of a feed: how many of its rows no earlier page has. Equal rows meet once, with their first page."""
    by = by or []
    first = rows.groupBy(*by, *columns).agg(F.min(page).alias(page)).groupBy(*by, page).agg(F.count("*").alias("fresh"))
    return rows.select(*by, page).distinct().join(first, [*by, page], "left").select(*by, page, F.coalesce("fresh", F.lit(0)).alias("fresh"))


PRINTED = 3  # rows that tell a page from the one before


def unchanged_pages(rows: DataFrame, columns: list[str], by: list[str], page: str = "page", pos: str = "pos") -> DataFrame:
    """(by…, page, print, unchanged): of each page that has rows what its first three say, and whether the page before said the same: a next control that led nowhere. Only those rows are gathered."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, page).orderBy(pos))).where(F.col("_r") <= PRINTED)
    said = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), "|")
    prints = first.groupBy(*by, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", said.alias("said")))), lambda x: x["said"]), "||").alias("print"))
    before = F.lag("print").over(Window.partitionBy(*by).orderBy(page))
    return prints.select(*by, page, "print", F.coalesce(F.col("print") == before, F.lit(False)).alias("unchanged"))


def until_stale(pages: DataFrame, by: list[str], page: str = "page", fresh: str = "fresh") -> DataFrame:
    """Pages up to the second of two in a row without a new row."""
    w = Window.partitionBy(*by).orderBy(page)
    stale = (F.col(fresh) == 0) & (F.lag(fresh).over(w) == 0)
    stop = F.min(F.when(F.col("_stale"), F.col(page))).over(Window.partitionBy(*by))
    marked = pages.withColumn("_stale", stale).withColumn("_stop", stop)
    return marked.where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop", "_stale")


def stop_rule(pages: DataFrame, by: list[str], page_size: Column | None = None, max_rows: int | None = None, max_pages: int = 2000) -> DataFrame:
    """Pages (page from 0, rows, total and cap as stated there or null) up to the one that ends the feed: empty, shorter than the page size,
    reaching the total, the cap or the row limit, or the last allowed. The total and cap are those first stated."""
    so_far = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    stated = lambda c: F.first(c, ignorenulls=True).over(so_far)
    index = F.col("page") + 1
    size = page_size if page_size is not None else F.lit(None).cast("long")
    reached = F.coalesce(size, F.col("rows")) * index
    done = (F.col("rows") == 0) | F.coalesce(F.col("rows") < size, F.lit(False)) | F.coalesce(reached >= F.col("_total"), F.lit(False)) | F.coalesce(reached >= F.col("_cap"), F.lit(False)) | (index >= max_pages)
    if max_rows:
        done = done | (F.sum("rows").over(so_far) >= max_rows)
    marked = pages.withColumns({"_total": stated("total"), "_cap": stated("cap")}).withColumn("done", done)
    last = F.min(F.when(F.col("done"), F.col("page"))).over(Window.partitionBy(*by))
    return marked.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last", "_total", "_cap")


def spread(rows: DataFrame, n: int, order: str) -> DataFrame:
    """So many rows spread evenly from the first to the last, or all if there are no more. Ranges are sorted apart and written with the places of their rows, so that no task sees
    all of them, and that counting and picking see the same ranges."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "spread")
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    total = sum(size for _, size in sizes)
    if total <= n:
        return ranged.select(rows.columns)
    spots = {math.floor(i * (total - 1) / (n - 1) + 0.5) for i in range(n)} if n > 1 else {0}
    places, before = [], 0
    for p, size in sizes:
        places += [((p << 33) + at - before,) for at in spots if before <= at < before + size]
        before += size
    wanted = rows.sparkSession.createDataFrame(places, "_place long")
    return ranged.join(F.broadcast(wanted), "_place").select(rows.columns)


def capped_rows(rows: DataFrame, by: list[str], page: str, pos: str, most: int) -> DataFrame:
    """The first so many rows of each feed, by page and place in the page: the last page is cut where the limit falls. Pages are summed, rows aren't ordered."""
    sizes = rows.groupBy(*by, page).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select(*by, page, before.alias("_before")), [*by, page]).where(F.col("_before") < most)
    inside = F.row_number().over(Window.partitionBy(*by, page).orderBy(pos))
    return placed.withColumn("_in", inside).where(F.col("_before") + F.col("_in") <= most).select(rows.columns)


def first_rows(rows: DataFrame, by: list[str], n: int, order: list) -> DataFrame:
    """The first so many rows of each key: the sample of a paged feed, a capped fold."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def heading_before(lines: DataFrame, by: list[str], order: str, is_heading: Column, value: str) -> DataFrame:
    """lines with the last heading at or before each."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col(value)), ignorenulls=True).over(w))


def label_next(cells: DataFrame, by: list[str], order: str, is_label: Column, is_value: Column, value: str, within: int = 3) -> DataFrame:
    """(…, label, value): each label with the next text within so many cells."""
    w = Window.partitionBy(*by).orderBy(order)
    following = F.coalesce(*[F.when(F.lead(is_value.cast("int"), i).over(w) == 1, F.lead(value, i).over(w)) for i in range(1, within + 1)])
    return cells.withColumn("_is", is_label).withColumn("_next", following).where("_is AND _next IS NOT NULL").select(*by, order, F.col(value).alias("label"), F.col("_next").alias("value"))


def with_context(lines: DataFrame, by: list[str], order: str, value: str, before: int = 1, after: int = 2) -> DataFrame:
    """lines with the text of their neighbours, from so many before to so many after."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list(F.coalesce(value, F.lit(""))).over(w), "\n"))


def fold_pages(captures: DataFrame, key: list[str], rows: str, order: str, cap: int = 240) -> DataFrame:
    """Captured pages of one dataset as one: (key, row) in order, rows already there left out, up to a cap."""
    exploded = captures.select(*key, F.col(order).alias("_page"), F.posexplode(rows).alias("_pos", "row"))
    once = exploded.groupBy(*key, "row").agg(F.min(F.struct("_page", "_pos")).alias("_at"))
    return first_rows(once, key, cap, ["_at"]).select(*key, "row", F.col("_at._page").alias("page"), F.col("_at._pos").alias("pos"))


def best_feed(feeds: DataFrame) -> DataFrame:
    """The largest feed, paged ones first among equals, then the earlier."""
    return feeds.orderBy(F.desc("size"), F.desc("paginated"), "_ord").limit(1)


def upper_median(rows: DataFrame, value: str, cells: int = 1024, few: int = 10_000) -> DataFrame:
    """(median): the middle number, the upper one of two, of all rows. The range is cut into cells, whose counts tell in which the middle lies, and that cell again,
    until few different numbers are left; no task orders all of them. Null without rows."""
    v = F.col(value)
    now = written(rows.select(value).where(v.isNotNull() & ~F.isnan(v.cast("double"))), "median")
    whole = now.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    before, low, high, middle = 0, whole["low"], whole["high"], whole["n"] // 2
    while low is not None and low < high:
        inside = now.where(v.between(F.lit(low), F.lit(high)))
        if inside.agg(F.approx_count_distinct(v).alias("n")).first()["n"] <= few:
            break
        cell = F.floor((v.cast("double") - float(low)) / (float(high) - float(low)) * cells).alias("cell")
        counts = inside.groupBy(cell).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("cell").collect()  # as many as cells
        for c in counts:
            if before + c["n"] > middle:
                break
            before += c["n"]
        if (c["low"], c["high"]) == (low, high):
            break
        low, high = c["low"], c["high"]
    by = now.where(v.between(F.lit(low), F.lit(high))).groupBy(v.alias("_v")).agg(F.count("*").alias("_n"))
    ranked = by.withColumn("_to", F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))  # few numbers
    return ranked.where(F.col("_to") + before > middle).agg(F.min("_v").alias("median"))


def job_stats(rows: DataFrame, company: str, looked: str, people: str, website: str, needs: str) -> DataFrame:
    """One row of counts over a job's rows: companies, those looked up, with people, with a website, needing more; and rows."""
    once = rows.groupBy(company).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in (looked, people, website, needs)], F.count("*").alias("n"))
    return once.agg(F.sum("n").alias("rows"), F.count_if(filled(company)).alias("companies"), *[F.sum(c).alias(c) for c in (looked, people, website, needs)])


def pending(work: DataFrame, done: DataFrame, attempts: DataFrame, key: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """What is still to do, and what has been tried so often that it is given up as blank. attempts: (key, attempts)."""
    left = work.join(done.select(key), key, "left_anti").join(attempts, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return left.where(F.col("attempts") < most), left.where(F.col("attempts") >= most)
