"""What the operators share: the folder that driver and executors both see, and written intermediate tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OWN: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset a session on one machine, as in tests, gets a new local folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="harrow-")
        folder = _OWN[app]
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: it cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Deletes every table that written() made in this application, and says how many. For when the results that read them are themselves stored."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number, such that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}{i or ''}").lower() not in taken)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sha256_hex(column):
    return F.sha2(F.encode(column, "UTF-8"), 256)


def with_fields(schema: T.StructType, **added: str) -> T.StructType:
    """A new schema with fields of simple types added."""
    return T.StructType([*schema.fields, *(T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for name, kind in added.items())])


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy(run: Callable) -> Callable:
    """A function over a partition's batches that gives its worker's freed memory back when it is done: workers wait for further tasks beside the JVM."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied
