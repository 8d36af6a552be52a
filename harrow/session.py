"""Session defaults for local use and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "harrow", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str, each: int = 4) -> DataFrame:
    """The rows hashed over four tasks (each) a core, for rows that are small but much work: a file of few megabytes is read by one task, and adaptive execution joins small shuffled parts again unless their number is given."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, *columns)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset a session on one machine, as in tests, gets a new local folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="harrow-")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: for what is read twice and must be the same both times, and to outlive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. Spark guesses a written table by its files, and elements of like pages pack to some hundredth of their rows: by that guess the driver would gather and broadcast millions."""
    return left.join(right.hint("merge"), on, how)
