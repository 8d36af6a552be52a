"""A pair of Bloom filters, for hashes seen once and seen twice, built by all tasks and merged bit by bit.

Each partition makes its own two filters. Merging is twice = twice_a | twice_b | (once_a & once_b) and once = once_a | once_b:
a hash that two partitions hold has all its bits in both once-filters, so a hash held twice is always found; others are
found with a small probability. Filters only narrow what is looked at exactly afterwards, so that a full filter costs time,
never results. Their size follows the number of hashes up to MAX_BITS (64 MB), which bounds what is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from harrow.llm.shared import tidy

SEGMENT = 16  # log2 of the bits of a segment; the bits of a hash lie in one segment
MIN_BITS, MAX_BITS = 20, 29
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def log2_bits(hashes: int, per_hash: int = 10) -> int:
    return min(MAX_BITS, max(MIN_BITS, int(per_hash * max(hashes, 1) - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segment of each hash, and its three bits there."""
    return hashes >> np.uint64(64 - bits + SEGMENT), [(hashes * x) >> np.uint64(64 - SEGMENT) for x in _SPREAD]


def _segments(hashes: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """hashes: sorted, each once."""
    if not len(hashes):
        return {}
    where, at = places(hashes, bits)
    names, starts = np.unique(where, return_index=True)
    out = {}
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True):
        flags = np.zeros(1 << SEGMENT, np.uint8)
        for x in at:
            flags[x[a:b]] = 1
        out[name] = np.packbits(flags, bitorder="little")
    return out


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(x: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8) if x else np.zeros(1 << SEGMENT >> 3, np.uint8)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    once, twice = _unpack(None), _unpack(None)
    for a, b in zip(group["once"], group["twice"], strict=True):
        a = _unpack(a)
        twice = twice | _unpack(b) | (once & a)
        once = once | a
    return pd.DataFrame({"segment": group["segment"][:1], "twice": [_pack(twice)]})


class Filter:
    """The merged filter as tasks use it; bits set means suspected."""

    def __init__(self, spark, bits: int, data: np.ndarray):
        self.bits, self.data = bits, spark.sparkContext.broadcast(data)

    def __getstate__(self):
        return {"bits": self.bits, "data": self.data}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return held(self.data.value, hashes, self.bits)


def held(data: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    where, at = places(hashes, bits)
    base, out = where << np.uint64(SEGMENT), np.ones(len(hashes), bool)
    for x in at:
        place = base | x
        out &= (data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _collected(spark, merged: DataFrame, bits: int, column: str) -> Filter:
    data = np.zeros(1 << bits >> 3, np.uint8)
    for row in merged.collect():  # one job for all partitions; at most MAX_BITS in all
        start = row["segment"] << SEGMENT >> 3
        data[start : start + (1 << SEGMENT >> 3)] = _unpack(row[column])
    return Filter(spark, bits, data)


def seen_twice(df: DataFrame, hashes_of: Callable[[Iterable[pd.DataFrame]], Iterator[np.ndarray]], bits: int) -> Filter:
    """The filter of hashes that appear twice or more. hashes_of: from the batches of a partition, arrays of 64-bit hashes."""

    def part(batches):
        found = [np.asarray(x, np.uint64) for x in hashes_of(batches)]
        values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        once, twice = _segments(values, bits), _segments(values[counts > 1], bits)
        names = list(once)
        for i in range(0, len(names), 256):
            some = names[i : i + 256]
            yield pd.DataFrame({"segment": some, "once": [_pack(once[x]) for x in some], "twice": [_pack(twice[x]) if x in twice else None for x in some]})

    parts = df.mapInPandas(tidy(part), "segment long, once binary, twice binary")
    merged = parts.groupBy("segment").applyInPandas(_merge, "segment long, twice binary")
    return _collected(df.sparkSession, merged, bits, "twice")


def seen(df: DataFrame, column: str, rows: int) -> Filter:
    """The filter of the values of a long column."""

    def twice(batches):
        for batch in batches:
            hashes = of_longs(batch[column].to_numpy(np.int64))
            yield np.concatenate([hashes, hashes])

    return seen_twice(df.select(column).where(f"{column} IS NOT NULL"), twice, log2_bits(rows))


def of_longs(x: np.ndarray) -> np.ndarray:
    """Hashes of numbers, spread over all bits."""
    h = x.astype(np.int64).view(np.uint64) * _SPREAD[0]
    h ^= h >> np.uint64(32)
    h *= _SPREAD[1]
    return h ^ (h >> np.uint64(29))


def suspected(spark, ids: DataFrame, column: str, of: Column) -> Column:
    """Whether the filter of ids (a written table with that long column) holds the value of a Column; a null is never held."""
    found = seen(ids, column, ids.count())

    def held_by(x: pd.Series) -> pd.Series:
        out, there = np.zeros(len(x), bool), x.notna().to_numpy()
        out[there] = found.holds(of_longs(x[there].to_numpy(np.int64)))
        return pd.Series(out)

    return pandas_udf(held_by, "boolean")(of)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs but for rows whose id is in ids (a written table of one column of that name). Only rows that the filter suspects are shuffled."""
    suspect = suspected(docs.sparkSession, ids, column, docs[column])
    return docs.where(~suspect).unionByName(docs.where(suspect).join(ids, column, "left_anti").select(docs.columns))
