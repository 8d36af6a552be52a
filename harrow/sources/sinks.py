"""Tables written out for people and programs. Every writer is a Spark write: parts come from tasks, in order, and nothing passes through the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import cell, csv_field, text

BOM = "﻿"


def csv_lines(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(_ord, line): the header with the byte order mark first, then a line for each row."""
    kinds = dict(df.dtypes)
    line = F.concat_ws(",", *[csv_field(cell(F.col(f"`{f}`"), kinds[f])) for f in fields])
    header = df.sparkSession.range(1).select(F.lit(None).cast(kinds[order]).alias("_ord"), F.concat(F.lit(BOM), F.concat_ws(",", *[csv_field(F.lit(f)) for f in fields])).alias("line"))
    return header.union(df.select(F.col(order).alias("_ord"), line.alias("line")))


def write_csv(df: DataFrame, path: str, fields: list[str], order: str) -> None:
    """A folder of part files which, one after the other, are the CSV file: CRLF line ends, the header in the first."""
    csv_lines(df, fields, order).orderBy(F.col("_ord").asc_nulls_first()).select("line").write.option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame, fields: list[str]) -> DataFrame:
    """(value): an object a row of the fields alone; what is missing is the empty text."""
    return df.select(F.to_json(F.struct(*[F.when(F.col(f"`{f}`").isNull(), F.lit("")).otherwise(text(F.col(f"`{f}`"))).alias(f) if k == "string" else F.col(f"`{f}`").alias(f) for f, k in df.dtypes if f in fields]), {"ignoreNullFields": "false"}).alias("value"))


def json_array(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(_ord, part, line): the lines of one indented JSON array of all rows, in order: the fields alone, what is missing as the empty text. Rows are lines of
    their own, so that no task holds the array; a comma follows each but the last, told by the greatest order."""
    kinds = dict(df.dtypes)
    said = lambda f: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(f"`{f}`"), F.lit("")) if kinds[f] == "string" else F.col(f"`{f}`"))), r"^\[|\]$", "")
    cells = [F.concat(F.lit("    " + json.dumps(f, ensure_ascii=False) + ": "), F.when(F.col(f"`{f}`").isNull(), F.lit('""')).otherwise(said(f))) for f in fields]
    last = df.agg(F.max(order).alias("_last"))
    body = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *cells), F.lit("\n  }"), F.when(F.col(order) == F.col("_last"), "").otherwise(","))
    rows = df.crossJoin(F.broadcast(last)).select(F.col(order).alias("_ord"), F.lit(1).alias("part"), body.alias("line"))  # one row
    edge = lambda n, line: df.sparkSession.range(1).select(F.lit(None).cast(kinds[order]).alias("_ord"), F.lit(n).alias("part"), F.lit(line).alias("line"))
    return edge(0, "[").union(rows).union(edge(2, "]"))


def write_json_array(df: DataFrame, path: str, fields: list[str], order: str) -> None:
    """A folder of part files which, one after the other, are the array."""
    json_array(df, fields, order).orderBy("part", "_ord").select("line").write.text(path)


def write_json(df: DataFrame, path: str, fields: list[str]) -> None:
    json_lines(df, fields).write.text(path)


def write(fmt: str, df: DataFrame, path: str, fields: list[str], order: str) -> None:
    """By format: csv, json (lines), json-array or parquet."""
    if fmt == "csv":
        write_csv(df, path, fields, order)
    elif fmt == "json":
        write_json(df, path, fields)
    elif fmt == "json-array":
        write_json_array(df, path, fields, order)
    elif fmt == "parquet":
        df.select(*fields).write.parquet(path)
    else:
        raise ValueError(f"no such format: {fmt}")
