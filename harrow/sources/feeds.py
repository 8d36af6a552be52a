"""Feeds as tables: JSON at a path, pages of a feed one task each, and captured pages up to where the feed ends."""

from __future__ import annotations

import importlib
import json
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from harrow.functions.records import find_record_sets, record_cells
from harrow.operators.ordering import stop_rule


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, row, key, key_pos, value, boolean) of the largest list of records in each JSON file at a path; id is a hash of the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("id"), F.col("value").alias("payload"))
    return record_cells(files)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that are none are kept in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).json(path)


PAGE = pa.schema([("page", pa.int64()), ("payload", pa.string())])


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Fetcher:
    """How pages are fetched, by the source's options: from where, how often and how long apart."""

    def __init__(self, options: dict):
        self.fetch, self.base = options["fetch"], options.get("base")
        self.each, self.attempts, self.wait = max(1, int(options.get("pages_a_task", 1))), int(options.get("attempts", 3)), float(options.get("wait_ms", 800))

    def ranges(self, first: int, last: int) -> list[Pages]:
        return [Pages(i, min(i + self.each, last)) for i in range(first, last, self.each)]

    def rows(self, pages: Pages):
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for page in range(pages.first, pages.last):
            for attempt in range(self.attempts):
                try:
                    payload = fetch(page) if self.base is None else fetch(page, self.base)
                    break
                except OSError:
                    if attempt == self.attempts - 1:
                        raise
                    time.sleep(self.wait * 3**attempt / 1000)  # 0.8, 2.4 s and so on
            # each page leaves by itself, for rows would be gathered by thousands, whatever their size; and its text is let go before the next one is fetched
            batch = pa.RecordBatch.from_pydict({"page": [page], "payload": [payload if isinstance(payload, str) else json.dumps(payload)]}, PAGE)
            del payload
            yield batch
            del batch


class PagedFeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.fetcher = int(options["pages"]), Fetcher(options)

    def partitions(self):
        return self.fetcher.ranges(0, self.pages)

    def read(self, partition: Pages):
        return self.fetcher.rows(partition)


class PagedFeedStream(DataSourceStreamReader):
    """Offsets are page numbers. A run goes up to option until, so that a feed is read in slices; the next run starts where the checkpoint says."""

    def __init__(self, options: dict):
        self.until, self.fetcher = int(options["until"]), Fetcher(options)

    def initialOffset(self):
        return {"page": 0}

    def latestOffset(self):
        return {"page": self.until}

    def partitions(self, start: dict, end: dict):
        return self.fetcher.ranges(start["page"], end["page"])

    def read(self, partition: Pages):
        return self.fetcher.rows(partition)


class PagedFeed(DataSource):
    """spark.read.format("paged_feed").option("fetch", "module:function").option("pages", n): a row (page, payload) for each page; page ranges are partitions,
    so that pages are fetched in parallel and a lost task fetches its own again. fetch(page) gives the page's JSON, or fetch(page, base) with option base. spark.readStream reads pages up to option until."""

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "page long, payload string"

    def reader(self, schema):
        return PagedFeedReader(self.options)

    def streamReader(self, schema):
        return PagedFeedStream(self.options)


def captured_page(page: int, base: str) -> str:
    """The text of page=N under a folder that driver and executors share, as write.partitionBy("page").text leaves it; an empty page where there is none."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(base)
    found = files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
    parts = sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
    return "".join(files.open_input_stream(p).read().decode("utf-8") for p in parts).rstrip("\n") or "[]"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFeed)


def feed_pages(captures: DataFrame, page_size: int | None = None, max_rows: int | None = None) -> DataFrame:
    """The captured pages (feed, page, payload) that a replay would have read: up to the one that ends each feed."""
    keyed = captures.withColumn("id", F.xxhash64("feed", "page"))
    sizes = find_record_sets(keyed).groupBy("id").agg(F.max("size").alias("rows"), F.max("total").alias("total"))
    pages = keyed.select("feed", "page", "id").join(sizes, "id", "left").select("feed", "page", F.coalesce("rows", F.lit(0)).alias("rows"), "total", F.lit(None).cast("long").alias("cap"))
    kept = stop_rule(pages, ["feed"], F.lit(page_size) if page_size else None, max_rows)
    return captures.join(kept.select("feed", "page"), ["feed", "page"])
