"""Suffix-array dedup: every byte that lies in a string of LENGTH bytes which also starts elsewhere is removed.

Suffixes are compared where repeats can be. Each string of LENGTH bytes has an anchor, the place of the least hash among its
GRAM-byte grams; equal strings have their anchors at the same offset. So

1. Anchors that occur once are ruled out by a twice-seen Bloom filter. Each other one has a context, the bytes of all the strings
   that it is the anchor of. Contexts are written once, equal ones of a task as one row with its owners. All contexts of
   an anchor are aligned at it, so that only suffixes in the same column need to be compared.
2. A shard (the contexts of one task) makes its Burrows-Wheeler transform: column by column from the right end, the symbols that
   precede its suffixes in their order (transformed). Right of the anchor a symbol is a word of eight bytes, left of it a byte.
3. A bucket gets the transforms of its anchors from all shards and merges them (merged_marks). It never sees texts or sorts suffixes: an
   interleave of the shards is refined iteratively, from one column to the next, by a stable partition on the shards' next symbols.
   The common prefixes of neighbours are carried along, one symbol longer where neighbours agree and cut where others come
   between. Neighbours that share LENGTH bytes are the repeated intervals. Many anchors are merged side by side in numpy.
4. Only row numbers come back; they are joined with the owners, so that a string of a third of all documents is a row a
   shard in its bucket. An anchor with more than MANY contexts is dealt anew first: its contexts are cut by the offset of a string to
   the anchor into ranges of SPLIT, each keyed by the bytes that all strings of the range hold, and, if still too many, by whole strings. All go the
   same way through transforms and their merge.
5. Removed bytes are gathered by document. Documents without any are never shuffled.

Defined results: a null or empty text has no bytes. Repeated rows repeat each other's bytes, so that those of LENGTH bytes
and more lose all. Rows are told apart by id and text, ids may repeat or be null. Other columns pass through, but for those named like the ones added, which they replace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bloom
from harrow.llm.shared import documents, tidy, with_fields, written

LENGTH, GRAM = 200, 16
MANY = 4096  # contexts of an anchor in a bucket
SPLIT = 24  # offsets, of a range that such an anchor's contexts are cut into
NO_ID = -(1 << 63)
TOGETHER = 16384  # contexts merged side by side
GATHER, CHUNK = 24_000_000, 6_000_000  # bytes of contexts that a task gathers before it passes them on, and that a shard transforms at once
_A, _B, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    words = np.ndarray((len(data) - 7,), np.uint64, buffer=data, strides=(1,))
    h = words[: len(data) - GRAM + 1] * _A + (words[8:] ^ (words[8:] >> np.uint64(29))) * _B
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of data's strings of that length: its hash and place, and the first and last start of the strings it is the anchor of."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = grams(data)
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # the first of equal hashes
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
    last = np.append(first[1:] - 1, len(place) - 1)
    name = h[place[first]] * _B  # least hashes have small upper halves: mixed again
    name = (name ^ (name >> np.uint64(32))) * _A
    return name ^ (name >> np.uint64(29)), place[first], first, last


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _each(batches, suspected: bloom.Filter, length: int):
    """(id, text hash, data, and the name, place, first and last start of its suspected anchors) of each row; a null id is NO_ID."""
    for batch in batches:
        ids = batch["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        for doc_id, text_hash, text in zip(ids.tolist(), batch["_sd_hash"].tolist(), batch["text"], strict=True):
            data = utf8(text)
            found = anchors(data, length)
            if len(found[0]):
                hit = suspected.holds(found[0])
                if hit.any():
                    yield doc_id, text_hash, data, [x[hit] for x in found]


CONTEXT = "key long, row long, left int, data binary, owners binary"


class Kept:
    """Contexts gathered in a task, equal ones once."""

    def __init__(self, level: int):
        self.number, self.rows, self.held = (level << 60) | (TaskContext.get().partitionId() << 36), {}, 0

    def add(self, key: int, left: int, data: bytes, owners: tuple[int, ...]) -> None:
        self.rows.setdefault((key, left, data), []).extend(owners)
        self.held += len(data)

    def out(self):
        rows = list(self.rows.items())
        for i in range(0, len(rows), 20_000):
            some = rows[i : i + 20_000]
            key = np.array([k[0] for k, _ in some], np.uint64).view(np.int64)
            number = np.arange(self.number, self.number + len(some))
            self.number += len(some)
            yield pd.DataFrame({"key": key, "row": number, "left": [k[1] for k, _ in some], "data": [k[2] for k, _ in some], "owners": [np.array(v, np.int64).tobytes() for _, v in some]})
        self.rows, self.held = {}, 0


def contexts(docs: DataFrame, suspected: bloom.Filter, length: int) -> DataFrame:
    """CONTEXT rows of suspected anchors. left: how many bytes of data lie before the anchor; owners: the id, text hash and start of each place that has it."""

    def run(batches):
        kept = Kept(0)
        for doc_id, text_hash, data, (name, place, first, last) in _each(batches, suspected, length):
            for n, p, a, b in zip(name.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
                kept.add(n, p - a, data[a : b + length], (doc_id, text_hash, a))
            if kept.held > GATHER:
                yield from kept.out()
        yield from kept.out()

    return docs.mapInPandas(tidy(run), CONTEXT)


def narrowed(rows: DataFrame, length: int, width: int, level: int) -> DataFrame:
    """CONTEXT rows cut by the offsets of their strings to the anchor, each part with so many offsets, keyed by the bytes that all strings at these offsets hold."""

    def run(batches):
        kept = Kept(level)
        for batch in batches:
            for key, left, data, owners in zip(batch["key"].tolist(), batch["left"].tolist(), batch["data"], batch["owners"], strict=True):
                owners = np.frombuffer(owners, np.int64).reshape(-1, 3)
                least = max(0, length - (len(data) - left))
                for i in range(least // width, left // width + 1):
                    low, high = max(least, width * i), min(left, width * i + width - 1)
                    core = data[left - width * i : left - width * i - width + 1 + length]
                    name = xxhash.xxh3_64_intdigest(core, seed=(key ^ (i * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
                    kept.add(name, high - width * i, data[left - high : left - low + length], (owners + [0, 0, left - high]).ravel().tolist())
                if kept.held > GATHER:
                    yield from kept.out()
        yield from kept.out()

    return rows.mapInPandas(tidy(run), CONTEXT)


def partition(cls: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The stable order by class (in order already) and then symbol; only classes out of order are touched."""
    perm = np.arange(len(cls), dtype=np.int32)
    falls = np.nonzero((symbol[1:] < symbol[:-1]) & (cls[1:] == cls[:-1]))[0]
    if len(falls):
        touched = np.zeros(int(cls[-1]) + 1, bool)
        touched[cls[falls]] = True
        at = np.nonzero(touched[cls])[0]
        perm[at] = at[np.lexsort((symbol[at], cls[at]))]
    return perm


def classes(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, one for each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


TRANSFORM = "bucket long, keys binary, rows binary, lefts binary, reaches binary, words binary, bytes binary"


def transform(key: np.ndarray, left: np.ndarray, data: list[bytes], length: int):
    """The Burrows-Wheeler transform of contexts, side by side for each key: their order by key, and for words and for bytes the symbols of all columns one after the
    other, with the number in that order of the context that each belongs to."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8)
    order = np.argsort(key, kind="stable")
    key, left, size, anchor = key[order], left[order], size[order], (np.cumsum(size) - size + left)[order]
    reach, cls = size - left, classes(key)
    words = -(-length // 8)
    right, padded = np.empty((len(key), words), np.uint64), np.append(flat + np.uint8(1), np.zeros(8 * words, np.uint8))  # 0 is the end; UTF-8 has no byte 255
    for a in range(0, len(key), 2048):
        some = slice(a, a + 2048)
        own = padded[anchor[some, None] + np.arange(8 * words)] * (np.arange(8 * words) < reach[some, None])
        right[some] = own.view(">u8")
    row = np.arange(len(key), dtype=np.int32)
    columns: tuple[list, list, list, list] = [], [], [], []
    for j in range(words - 1, -1, -1):
        symbol = right[row, j]
        live = reach[row] > 8 * j
        columns[0].append(symbol[live])
        columns[1].append(row[live])
        row = row[partition(cls, symbol)]
    for offset in range(1, int(left.max(initial=0)) + 1):
        live = left[row] >= offset
        row, cls = row[live], cls[live]
        symbol = flat[anchor[row] - offset]
        columns[2].append(symbol)
        columns[3].append(row)
        perm = partition(cls, symbol)
        row, cls = row[perm], classes(cls, symbol[perm])
    joined = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(columns, (np.uint64, np.int32, np.uint8, np.int32), strict=True)]
    return order, reach, *joined


def transformed(rows: DataFrame, length: int, log2_buckets: int) -> DataFrame:
    """TRANSFORM rows: the transforms of the shards (tasks) of rows, cut by buckets of keys. A left with its lowest bit set has several owners."""

    def run(batches):
        held, parts = 0, []

        def out():
            key = np.concatenate([p[0] for p in parts])
            left, several, number = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 4))
            data = [x for p in parts for x in p[3]]
            order, reach, words, word_rows, symbols, symbol_rows = transform(key, left, data, length)
            key, left, several, number = key[order], left[order], several[order], number[order]
            bucket = (key >> np.uint64(64 - log2_buckets)).astype(np.int64) if log2_buckets else np.zeros(len(key), np.int64)
            names, starts = np.unique(bucket, return_index=True)
            cls = classes(bucket)
            cut = []
            for values, owner in ((words, word_rows), (symbols, symbol_rows)):
                where = cls[owner]
                by = np.argsort(where.astype(np.uint16) if len(names) < 65536 else where, kind="stable")
                cut.append((values[by], np.searchsorted(where[by], np.arange(len(names) + 1))))
                del where, by
            ends = np.append(starts, len(key))
            piece = lambda x, i: x[ends[i] : ends[i + 1]].tobytes()
            lefts, reaches = (left * 2 + several).astype(np.int16), reach.astype(np.int16)
            for a in range(0, len(names), 256):
                some = range(a, min(a + 256, len(names)))
                inner = lambda k, i: cut[k][0][cut[k][1][i] : cut[k][1][i + 1]].tobytes()
                yield pd.DataFrame(
                    {
                        "bucket": names[a : a + 256],
                        "keys": [piece(key, i) for i in some],
                        "rows": [piece(number, i) for i in some],
                        "lefts": [piece(lefts, i) for i in some],
                        "reaches": [piece(reaches, i) for i in some],
                        "words": [inner(0, i) for i in some],
                        "bytes": [inner(1, i) for i in some],
                    }
                )

        for batch in batches:
            if len(batch):
                several = np.fromiter((len(x) > 24 for x in batch["owners"]), bool, len(batch))
                parts.append((batch["key"].to_numpy(np.int64).view(np.uint64), batch["left"].to_numpy(np.int64), several, list(batch["data"]), batch["row"].to_numpy(np.int64)))
                held += sum(map(len, parts[-1][3]))
                if held > CHUNK:
                    yield from out()
                    held, parts = 0, []
        if parts:
            yield from out()

    return rows.mapInPandas(tidy(run), TRANSFORM)


class Minima:
    """Range minima over a fixed array."""

    def __init__(self, x: np.ndarray):
        self.table = np.zeros((max(1, int(len(x)).bit_length()), len(x)), x.dtype)
        self.table[0] = x
        for i in range(1, len(self.table)):
            half = 1 << (i - 1)
            width = len(x) - 2 * half + 1
            self.table[i, :width] = np.minimum(self.table[i - 1, :width], self.table[i - 1, half : half + width])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of a+1 to b, a < b."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, a + 1], self.table[k, b + 1 - (1 << k)])


class Columns:
    """The symbols of all shards, column by column: each shard's come in the shard's own order."""

    def __init__(self, values: list[np.ndarray], live: list[np.ndarray]):
        """For each shard, its symbols and how many of them each column has."""
        numbers = np.concatenate([np.repeat(np.arange(len(n), dtype=np.uint16), n) for n in live])
        by = np.argsort(numbers, kind="stable")
        self.values, self.ends = np.concatenate(values)[by], np.cumsum(np.bincount(numbers, minlength=len(live[0])))

    def take(self, column: int, shard: np.ndarray) -> np.ndarray:
        """The symbols of a column for an interleave of shards: each shard's next one wherever it has its turn."""
        own = self.values[self.ends[column - 1] if column else 0 : self.ends[column]]
        out = np.empty_like(own)
        out[np.argsort(shard, kind="stable")] = own
        return out


def merged_marks(shards: list[dict[str, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For shards' transforms of the same bucket (arrays as in TRANSFORM): all rows and their lefts, and for each row and offset from its anchor to the
    left whether the string that starts there is repeated."""
    words = -(-length // 8)
    key, number = (np.concatenate([s[x] for s in shards]) for x in ("keys", "rows"))
    left, several = np.divmod(np.concatenate([s["lefts"] for s in shards]).astype(np.int64), 2)
    reach = np.concatenate([s["reaches"] for s in shards]).astype(np.int64)
    deep = int(left.max()) + 1
    counts = lambda x, least: len(x) - np.searchsorted(np.sort(x), least)
    right = Columns([s["words"] for s in shards], [counts(s["reaches"], 8 * np.arange(words - 1, -1, -1) + 1) for s in shards])
    before = Columns([s["bytes"] for s in shards], [counts(s["lefts"] >> 1, np.arange(1, deep)) for s in shards]) if deep > 1 else None
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 65536 else np.int64), [len(s["keys"]) for s in shards])
    row = np.argsort(key, kind="stable")  # the interleave at the right end: by key, then shard
    group = classes(key[row])
    inside = np.append(False, group[1:] == group[:-1])  # has its neighbour before it in the same group
    common = np.zeros(len(row) + 1, np.int64)  # bytes shared with the neighbour before; one more, for ranges that end there
    for j in range(words - 1, -1, -1):
        live = reach[row] > 8 * j
        symbol = np.zeros(len(row), np.uint64)
        symbol[live] = right.take(words - 1 - j, shard[row[live]])
        perm = partition(group, symbol)
        row, symbol = row[perm], symbol[perm]
        same = inside[1:] & (symbol[1:] == symbol[:-1])
        apart = np.nonzero(inside[1:] & ~same)[0]
        at = np.nonzero(same)[0]
        longer = np.zeros(len(common), np.int64)
        if len(at):
            ranges = np.stack([perm[at] + 1, perm[at + 1] + 1], axis=1).ravel()
            longer[at + 1] = 8 + np.minimum.reduceat(common, ranges)[::2]
        differ = symbol[apart] ^ symbol[apart + 1]
        for byte in range(7, 0, -1):
            longer[apart + 1] += differ >> np.uint64(8 * byte) == 0
        common = longer
    common = np.minimum(common[:-1], np.minimum(reach[row], np.append(reach[row[:1]], reach[row[:-1]])))
    common[~inside] = 0
    minima = Minima(common)
    out = np.zeros((len(key), deep), bool)
    now, cls, lefts, at_anchor = np.arange(len(row)), group, left[row], row
    for offset in range(deep):
        if offset:
            live = lefts[now] >= offset
            now, cls = now[live], cls[live]
            symbol = before.take(offset - 1, shard[at_anchor[now]])
            perm = partition(cls, symbol)
            now, cls = now[perm], classes(cls, symbol[perm])
        inner = np.nonzero(cls[1:] == cls[:-1])[0]
        if len(inner):
            equal = np.zeros(len(now) + 1, bool)
            equal[inner + 1] = minima.between(now[inner], now[inner + 1]) >= length - offset
            out[at_anchor[now[equal[:-1] | equal[1:]]], offset] = True
    offsets = np.arange(deep)
    whole = (offsets <= left[:, None]) & (offsets >= length - reach[:, None])
    return number, left, (out | (several > 0)[:, None]) & whole


def merged(transforms: DataFrame, length: int) -> DataFrame:
    """(row, low, high): the runs of offsets at which each context's strings are repeated."""

    def run(batches):
        rest: list[pd.DataFrame] = []

        def done():
            group = pd.concat(rest) if len(rest) > 1 else rest[0]
            kinds = {"keys": np.uint64, "rows": np.int64, "lefts": np.int16, "reaches": np.int16, "words": np.uint64, "bytes": np.uint8}
            number, _, marks = merged_marks([{k: np.frombuffer(r[k], kind) for k, kind in kinds.items()} for r in group.to_dict("records")], length)
            edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            return pd.DataFrame({"row": number[row], "low": low, "high": np.nonzero(edge == -1)[1] - 1})

        for batch in batches:
            while len(batch):
                bucket = batch["bucket"].to_numpy()
                n = int(np.searchsorted(bucket, bucket[0], side="right"))
                if rest and rest[0]["bucket"].iloc[0] != bucket[0]:
                    yield done()
                    rest = []
                rest.append(batch.iloc[:n])
                batch = batch.iloc[n:]
        if rest:
            yield done()

    return transforms.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(tidy(run), "row long, low int, high int")


COVER = "id long, h long, start long, end long"


def covers(found: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(id, h, start, end) of the bytes that repeated strings cover, for each owner of each context."""

    def run(batches):
        for g in batches:
            number = np.fromiter((len(x) // 24 for x in g["owners"]), np.int64, len(g))
            own = np.frombuffer(b"".join(g["owners"]), np.int64).reshape(-1, 3)
            shift, size = (np.repeat(x.to_numpy(np.int64), number) for x in (g["left"] - g["high"], g["high"] - g["low"] + length))
            yield pd.DataFrame({"id": own[:, 0], "h": own[:, 1], "start": own[:, 2] + shift, "end": own[:, 2] + shift + size})

    return found.join(rows.select("row", "left", "owners"), "row").mapInPandas(tidy(run), COVER)


def repeats(rows: DataFrame, length: int, many: int) -> DataFrame:
    """The covers of CONTEXT rows (written): those of keys with at most so many rows at once, the others cut and dealt anew."""
    out = []
    for level, width in enumerate((SPLIT, 1, None), 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        hot = written(sizes.where(F.col("n") > many).select("key"), "hot")
        crowded = width is not None and hot.count() > 0
        calm = rows.join(hot, "key", "left_anti") if crowded else rows
        buckets = max(0, int(rows.count() // TOGETHER).bit_length())
        out.append(covers(merged(transformed(calm.select("key", "row", "left", "data", "owners"), length, buckets), length), rows, length))
        if not crowded:
            break
        rows = written(narrowed(rows.join(hot, "key", "left_semi"), length, width, level), "narrowed")
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) added."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    prefix = "own_"  # under which the columns of docs pass through, whatever their names
    text = f"{prefix}text"
    hashed = docs.withColumnsRenamed({c: prefix + c for c in docs.columns}).withColumn("_sd_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    long = hashed.select(F.col(f"{prefix}doc_id").alias("doc_id"), F.col(text).alias("text"), "_sd_hash").where(F.octet_length("text") >= length)
    size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def names(batches):
        for batch in batches:
            yield np.concatenate([np.zeros(0, np.uint64), *(anchors(utf8(t), length)[0] for t in batch["text"])])

    suspected = bloom.seen_twice(long.select("text"), names, bloom.log2_bits(2 * size // (length - GRAM)))
    rows = written(contexts(long, suspected, length), "contexts")
    spans = repeats(rows, length, many).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = written(spans, "spans")
    losing = bloom.seen(spans, "h", spans.count())
    suspect = F.pandas_udf(lambda x: pd.Series(losing.holds(bloom.of_longs(x.to_numpy(np.int64)))), "boolean")(F.col("_sd_hash"))
    schema = with_fields(docs.schema, n_bytes="long", n_removed="long", n_spans="long", kept="binary")
    key = F.coalesce(f"{prefix}doc_id", F.lit(NO_ID))
    joined = hashed.where(suspect).join(spans, (key == F.col("id")) & (F.col("_sd_hash") == F.col("h")), "left").drop("_sd_hash", "id", "h")

    def cut(batches):
        for batch in batches:
            removed, runs, kept, sizes = [], [], [], []
            for own, some in zip(batch[text], batch["spans"], strict=True):
                data = utf8(own)
                sizes.append(len(data))
                out, done, count = [], 0, 0
                for s in some if some is not None else ():
                    if s["start"] > done or not count:
                        out.append(data[done : s["start"]])
                        count += 1
                    done = max(done, s["end"])
                out.append(data[done:])
                kept.append(b"".join(out))
                runs.append(count)
                removed.append(len(data) - len(kept[-1]))
            yield batch.drop(columns="spans").rename(columns=lambda c: c[len(prefix) :]).assign(n_bytes=sizes, n_removed=removed, n_spans=runs, kept=kept)

    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    none = F.lit(0).cast("long")
    untouched = hashed.where(~suspect).select(
        *[F.col(prefix + c).alias(c) for c in docs.columns], F.octet_length(body).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), body.alias("kept")
    )
    return untouched.unionByName(joined.mapInPandas(tidy(cut), schema))


def op3_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict = {}
