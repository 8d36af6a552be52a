"""Jobs that resume: stages kept as tables, and streams of captured rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from harrow.session import shared_folder, table
from harrow.sources import feeds


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], failed: Column | None = None) -> DataFrame:
    """The stage's table: read if an earlier run finished it, else built and written. A run that was cut off leaves no mark of success and is done again. Its rows, and those for which failed holds, are counted
    while it is written and kept beside it."""
    path = f"{folder}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        seen = Observation()
        counted = build().observe(seen, F.count("*").alias("rows"), F.count_if(failed if failed is not None else F.lit(False)).alias("failed"))
        counted.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(seen.get["rows"], seen.get["failed"])], "rows long, failed long").coalesce(1).write.mode("overwrite").json(f"{path}/_counts")  # hidden from readers of the table
    return spark.read.parquet(path)


Stage = tuple[str, Callable[[DataFrame | None], DataFrame] | None]


def run_job(spark: SparkSession, folder: str, stages: list[Stage], failed: dict[str, Column] | None = None) -> DataFrame:
    """Stages one after the other, each on the table of the one before; a stage that is None is left out. failed: by stage, which of its rows went wrong."""
    out = None
    for name, stage in stages:
        if stage is not None:
            before = out
            out = run_stage(spark, folder, name, lambda stage=stage, before=before: stage(before), (failed or {}).get(name))
    return out


COUNTS = "ord int, stage string, rows long, failed long"


def job_progress(spark: SparkSession, folder: str, stages: list[str], expected: int | None = None) -> DataFrame:
    """(ord, stage, rows, failed, of, left): how far each stage of a job is, from what it counted when it was written; the tables aren't read, unless a run was cut off between a table and its counts. of: the rows of the stage
    before, for the first those expected; left: those not there yet, all of them for a stage that isn't done."""
    known = []
    for i, name in enumerate(stages):  # a job has some few stages
        path = f"{folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            known.append((i, name, 0, 0))
        elif exists(spark, f"{path}/_counts/_SUCCESS"):
            own = spark.read.schema("rows long, failed long").json(f"{path}/_counts").first()
            known.append((i, name, own["rows"], own["failed"]))
        else:
            known.append((i, name, spark.read.parquet(path).count(), None))
    order = Window.orderBy("ord")
    table_ = spark.createDataFrame(known, COUNTS).withColumn("of", F.coalesce(F.lag("rows").over(order), F.lit(expected).cast("long")))
    return table_.withColumn("left", F.greatest(F.col("of") - F.col("rows"), F.lit(0)))


def follow(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """All that a stream has now, written to a folder of batches; a batch that is replayed replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fresh_rows(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Rows not seen before, across pages and runs; the state is the distinct rows, for ever. first_seen forgets."""
    return stream.dropDuplicates(columns)


def first_seen(stream: DataFrame, columns: list[str], time: str, within: str) -> DataFrame:
    """Rows whose columns haven't been seen before, across batches and restarts. A key is forgotten when its time is further back than within, so that the state doesn't grow for ever; rows as late as that are dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(columns)


ATTEMPT = "key string, attempts int, state string"


def attempts(stream: DataFrame, key: str, ok: str, most: int = 3, time: str | None = None, within: str | None = None, groups: int = 1024) -> DataFrame:
    """(key, attempts, state) after each batch with news of a key: done once one of its attempts went well, given up after so many, else pending. The state is carried across batches and restarts. With a column of time
    a key is forgotten once all that arrives is later than its last attempt by more than within; attempts as late as that are dropped. (A timeout by the clock would never let a run over what is there now end.)
    Keys are hashed into groups whose states are kept together, for a call of Python costs more than a key's attempts; a batch writes the states of all groups that it has news of, and a checkpoint keeps their number.
    Large states belong in a store on disk (spark.sql.streaming.stateStore.providerClass)."""

    def update(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = {k: tuple(x) for k, *x in zip(*state.get, strict=True)} if state.exists else {}
        news: dict = {}
        for batch in () if state.hasTimedOut else batches:
            for k, good, at in zip(batch["_key"], batch["_ok"], batch["_at"], strict=True):
                tried, done, last = news.get(k) or known.get(k, (0, False, 0))
                news[k] = (tried + 1, done or good, max(last, at))
        if time:
            now = state.getCurrentWatermarkMs()
            known = {k: x for k, x in known.items() if x[2] + 1 >= now or k in news}
        known |= news
        if known:
            state.update(([*known], *map(list, zip(*known.values(), strict=True))))
            if time:
                state.setTimeoutTimestamp(max(min(x[2] for x in known.values()), now) + 1)
        else:
            state.remove()
        if news:
            yield pd.DataFrame([(k, tried, "done" if done else "given up" if tried >= most else "pending") for k, (tried, done, _) in news.items()], columns=["key", "attempts", "state"])

    at = F.coalesce(F.unix_millis(time), F.lit(0)) if time else F.lit(0).cast("long")
    columns = [F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(groups)).alias("_group"), F.col(key).cast("string").alias("_key"), F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("_ok"), at.alias("_at")]
    timed = stream.withWatermark(time, within).select(*columns, time) if time else stream.select(*columns)
    kept = "keys array<string>, tried array<int>, done array<boolean>, last array<long>"
    return timed.groupBy("_group").applyInPandasWithState(update, ATTEMPT, kept, "update", "EventTimeTimeout" if time else "NoTimeout")


def pages_done(spark: SparkSession, checkpoint: str) -> int:
    """How many pages of a feed the runs of a checkpoint have planned so far."""
    if not exists(spark, f"{checkpoint}/offsets"):
        return 0
    planned = spark.read.text(f"{checkpoint}/offsets").select(F.get_json_object("value", "$.page").cast("long").alias("page"))
    return planned.agg(F.max("page")).first()[0] or 0


def read_slice(spark: SparkSession, fetch: str, folder: str, pages: int, base: str | None = None, pages_a_task: int = 1) -> int:
    """Reads so many more pages of a feed into folder/pages, from where the last run stopped, a batch a run; says up to which page. A run that was cut off is done again first, with the pages that it had."""
    feeds.register(spark)
    until = pages_done(spark, f"{folder}/state") + pages
    options = {"fetch": fetch, "until": until, "pages_a_task": pages_a_task} | ({"base": base} if base else {})
    follow(spark.readStream.format("paged_feed").options(**options).load(), f"{folder}/pages", f"{folder}/state")
    return until


SLICES = 3


def _in_parts(spark: SparkSession, sf_dir: str, folder: str, part: int) -> DataFrame:
    """The stream of events that have arrived by now: thirds of a half of them by id, each some files of its own, a core's part in each, which are a batch; part 1 adds the other half."""
    events, files = table(spark, sf_dir, "events"), spark.sparkContext.defaultParallelism
    for i in range(SLICES):
        own = events.where(F.col("event_id") % (2 * SLICES) == 2 * i + part)
        own.repartition(files).write.mode("append").parquet(f"{folder}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")


def _batches(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stateful stream gives over three batches, and after a restart over three more."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in range(2):
        out = build(_in_parts(spark, sf_dir, folder, part))
        keep = lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_distinct(spark, sf_dir) -> DataFrame:
    out = _batches(spark, sf_dir, lambda events: first_seen(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type", "user_id"], "ts", "10000 days"), "append")
    return out.select("event_type", "user_id")


def stream_attempts(spark, sf_dir) -> DataFrame:
    tried = lambda events: events.select(F.col("user_id").cast("string").alias("user"), (F.col("event_id") % 7 == 0).alias("ok"), F.col("ts").cast("timestamp").alias("ts"))
    out = _batches(spark, sf_dir, lambda events: attempts(tried(events), "user", "ok", time="ts", within="10000 days"), "update")
    return out.groupBy("key").agg(F.max_by("attempts", "batch").alias("attempts"), F.max_by("state", "batch").alias("state"))


def _captured_feed(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Pages of orders, as a feed of 16 that is kept in the shared folder; says where."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("page"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    payload = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", "o_orderstatus"))).alias("rows")))
    orders.groupBy("page").agg(payload.alias("value")).write.partitionBy("page").text(f"{folder}/feed")
    return f"{folder}/feed" if ":/" in folder else f"file://{folder}/feed"


def _orders_of(pages: DataFrame) -> DataFrame:
    rows = F.from_json(F.get_json_object("payload", "$.rows"), "array<struct<id: long, o_orderstatus: string>>")
    return pages.withColumn("x", F.explode(rows)).withColumn("o_orderkey", F.col("x.id"))


def feed_slices(spark, sf_dir) -> DataFrame:
    """Two runs that read a feed in slices of five pages; the second starts where the first stopped."""
    folder = f"{shared_folder(spark)}/slices-{uuid.uuid4().hex}"
    base = _captured_feed(spark, sf_dir, folder)
    for _ in range(2):
        read_slice(spark, "harrow.sources.feeds:captured_page", folder, 5, base=base, pages_a_task=2)
    return _orders_of(spark.read.parquet(f"{folder}/pages")).select(F.col("batch").alias("run"), "page", "o_orderkey")


def replayed_feed(spark, sf_dir) -> DataFrame:
    """A feed read page by page, some a task, up to the first page without rows."""
    feeds.register(spark)
    base = _captured_feed(spark, sf_dir, f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}")
    read = spark.read.format("paged_feed").options(fetch="harrow.sources.feeds:captured_page", base=base, pages=20, pages_a_task=4).load()
    return _orders_of(feeds.feed_pages(read.withColumn("feed", F.lit("orders")))).select("page", "o_orderkey")


QUERIES = {"stream_distinct": stream_distinct, "stream_attempts": stream_attempts, "feed_slices": feed_slices, "replayed_feed": replayed_feed}
ORACLE = {
    "stream_distinct": "SELECT DISTINCT event_type, user_id FROM events",
    "stream_attempts": "SELECT user_id::VARCHAR AS key, count(*)::INTEGER AS attempts, CASE WHEN bool_or(event_id % 7 = 0) THEN 'done' WHEN count(*) >= 3 THEN 'given up' ELSE 'pending' END AS state FROM events GROUP BY user_id",
    "feed_slices": "SELECT (o_orderkey % 16 // 5)::INTEGER AS run, o_orderkey % 16 AS page, o_orderkey FROM orders WHERE o_orderkey % 16 < 10",
    "replayed_feed": "SELECT o_orderkey % 16 AS page, o_orderkey FROM orders",
}
