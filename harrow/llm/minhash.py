"""MinHash near-dedup with odd sketches.

Every text is a set of hashed word shingles. Texts with the same set are one class from the start, so that copies cost a row
each and no pairs. Each class gets HASHES MinHash samples. They are folded into bands, whose keys bring candidates together,
and into an odd sketch, a bitmap of the parity of hashed samples: the number of bits in which two sketches differ estimates
how many samples differ, precisely so where texts are similar.

1. Band keys that only one class has are dropped by a twice-seen Bloom filter before anything is shuffled.
2. Classes that share a key meet; those whose sketches differ little enough (far more than a similar pair's would, see MARGIN)
   are joined to candidate groups. A bucket or group returns a forest, not its pairs. A bucket of more than BUCKET_ROWS classes is
   joined to its smallest member as it is: that costs candidates, which step 3 looks at, and no links.
3. The full sets of each candidate group meet and links are confirmed exactly, again down to a forest: a member is compared with all
   others unless they are known to be connected, so that no link between different groups of members is missed. A group of more
   than GROUP_ROWS members or GROUP_SHINGLES shingles is first split by prefixes: linked sets share one of the rarest fifth of either's shingles, in any
   order of all shingles, here by their frequency in a count sketch; members that share none of these, as texts of one template do, part without their sets
   being sent. What is still as large is spread over tasks: in rounds, some of its members, the pivots, are sent to all of its blocks and compared with
   each member there. Pivots come from outside the group's largest component so far, so that a group whose members are alike is settled
   by a few; the rounds end when all members outside have been pivots. Of two members that are apart one has then been
   compared with all. A round sends each block its pivots and no pairs of members.
4. Connected components of the confirmed links.

The chance that a pair at the threshold of 0.8 shares no band is (1 - 0.8^ROWS)^BANDS, 3 in a million.

Defined results: texts that are null or without words have no shingles and link with nothing; so do rows with a null id. Texts of
fewer words than a shingle are one shingle, the whole sequence. Ids are expected once each; rows that share one share its component. dedup keeps
one of the rows that share an id and a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from harrow.llm import bloom
from harrow.llm import components as cc
from harrow.llm.shared import documents, tidy, written

WIDTH, SIMILARITY = 5, 80  # words a shingle, per cent
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BITS = 512  # of an odd sketch
MARGIN = 0.2  # over six standard deviations of the sketch's estimate at a similarity of 0.8
BUCKET_ROWS = 512
GROUP_ROWS, GROUP_SHINGLES, GROUP_BLOCK = 4096, 4_000_000, 256  # members and shingles of a group in a task, and members of a block of a larger group
PIVOTS, MORE, MOST_PIVOTS = 32, 8, 2048  # a round has so many times the pivots of the one before, up to a bound
COUNTERS = 22  # as a power of two, of the sketch that tells rare shingles: 32 MB
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
_SALT = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and blanks \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(width, len(h))
    out = np.full(len(h) - wide + 1, wide, np.uint64)
    for i in range(wide):
        out = out * _PRIME + mix(h[i : len(h) - wide + 1 + i])
    return np.unique(mix(out))


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    out, low = np.full(HASHES, 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        out = np.minimum(out, (low[i : i + 1024, None] * _A + _B).min(axis=0))
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """mins: a row for each set; so many rows of BANDS keys."""
    x = (mins.astype(np.uint64) + np.uint64(1)) * _SALT
    return mix(x.reshape(len(mins), BANDS, ROWS).sum(axis=2, dtype=np.uint64))


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Bitmaps of BITS bits, as rows of 64-bit words: a bit tells whether an odd number of samples hash to it."""
    at = mix((mins.astype(np.uint64) + np.uint64(1)) * _SALT) >> np.uint64(64 - BITS.bit_length() + 1)
    parity = np.zeros((len(mins), BITS), np.uint8)
    np.bitwise_xor.at(parity, (np.arange(len(mins))[:, None], at.astype(np.int64)), 1)
    return np.packbits(parity, axis=1, bitorder="little").view(np.uint64)


def most_differing(similarity: float) -> int:
    """The number of differing bits at which the estimate 1 + BITS / (4 HASHES) ln(1 - 2 bits / BITS) is so much."""
    return int(BITS / 2 * (1 - np.exp(-4 * HASHES * (1 - similarity) / BITS)))


def connect(n: int, weight: np.ndarray, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """The component of each of n members under linked(i), the members that i is linked with. Asks about as few i as settles it:
    of two members still apart, at least one has been asked about."""
    lab, asked = np.arange(n), np.zeros(n, bool)
    while True:
        sizes = np.bincount(lab, minlength=n)
        if sizes.max() == n:
            return lab
        left = ~asked
        big = sizes.argmax()
        if asked.any():
            left &= lab != big
        if not left.any():
            return lab
        i = int(np.argmax(np.where(left, weight, -1)))
        asked[i] = True
        found = np.unique(lab[np.append(linked(i), i)])
        if len(found) > 1:
            lab[np.isin(lab, found)] = found[0]


def forest_of(ids: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the smallest id of its component."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, lab, ids)
    own = least[lab] != ids
    return ids[own], least[lab][own]


def by_sketch(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    def linked(i: int) -> np.ndarray:
        near = np.bitwise_count(sketches ^ sketches[i]).sum(axis=1) <= most
        return np.nonzero(near & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))[0]

    return forest_of(ids, connect(len(ids), np.ones(len(ids)), linked))


class SetIndex:
    """Which of some sets are linked with a set: 100 times the shared shingles is at least percent times those of either."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.fromiter(map(len, sets), np.int64, len(sets)), percent
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked(self, one: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.flat, one, side="left"), np.searchsorted(self.flat, one, side="right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.nonzero((100 * shared >= self.percent * (self.sizes + len(one) - shared)) & (shared > 0))[0]


def by_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact links, as a forest."""
    index = SetIndex(sets, percent)
    return forest_of(ids, connect(len(ids), index.sizes, lambda i: index.linked(sets[i])))


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by keys, each whole."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        starts = np.nonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))[0]
        if rest and (rest[0][keys].to_numpy()[0] == k[0]).all():
            starts = starts[1:]
            rest.append(batch.iloc[: starts[0] if len(starts) else len(batch)])
            if not len(starts):
                continue
        if rest:
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.iloc[a:b]
        rest = [batch.iloc[starts[-1] :]]
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, high, low, bands, sketch) of each row of docs (doc_id, text); high and low, null without shingles or id, name the set."""

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.iloc[i : i + 500]
                sets = [shingles(t, width) for t in batch["text"]]
                mins = np.stack([samples(s) for s in sets])
                high = [int(np.add.reduce(mix(s ^ _MIX)).view(np.int64)) for s in sets]
                low = [int(np.bitwise_xor.reduce(mix(s + _PRIME)).view(np.int64)) ^ len(s) for s in sets]
                out = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets], "high": high, "low": low})
                out["bands"] = list(band_keys(mins).view(np.int64))
                out["sketch"] = [x.tobytes() for x in odd_sketches(mins)]
                none = (out["n_shingles"] == 0) | out["doc_id"].isna()
                out["high"] = out["high"].astype("Int64").mask(none)
                out["low"] = out["low"].astype("Int64").mask(none)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as a forest of each bucket, of classes (id, n, bands, sketch) that the sketches let pass."""
    rows = classes.count()

    def keys(batches):
        for batch in batches:
            yield np.concatenate([np.zeros(0, np.int64), *batch["bands"]]).view(np.uint64)

    shared = bloom.seen_twice(classes.select("bands"), keys, bloom.log2_bits(rows * BANDS))

    def suspects(batches):
        for batch in batches:
            if len(batch):
                k = np.concatenate(batch["bands"].to_numpy())
                at = np.nonzero(shared.holds(k.view(np.uint64)))[0]
                yield batch[["id", "n", "sketch"]].iloc[at // BANDS].assign(key=k[at])

    found = written(classes.mapInPandas(tidy(suspects), "id long, n long, sketch binary, key long"), "suspects")
    most = most_differing(percent / 100 - MARGIN)

    def compare(batches):
        out_a, out_b = [], []
        for g in groups(batches, ["key"]):
            if len(g) > 1:
                sketches = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
                a, b = by_sketch(g["id"].to_numpy(), g["n"].to_numpy(), sketches, most, percent)
                out_a.append(a)
                out_b.append(b)
            if len(out_a) > 2000:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()
                out_a, out_b = [], []
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()

    big = written(found.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("b")).where(F.col("rows") > BUCKET_ROWS).select("key", "b"), "big")
    stars = found.join(big, "key").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    small = found.join(big, "key", "left_anti").select("key", "id", "n", "sketch")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data and much work: not to be put together by its size
    return small.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(tidy(compare), cc.EDGE).union(stars)


def confirmed(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b), as a forest of each group, that hold on full sets. members (id, n, component_id): written, the candidate groups."""
    wanted = bloom.seen(members, "id", members.count())

    def sets(batches):
        for whole in batches:
            batch = whole[whole["doc_id"].notna()]
            batch = batch[wanted.holds(bloom.of_longs(batch["doc_id"].to_numpy(np.int64)))]
            yield pd.DataFrame({"id": batch["doc_id"].to_numpy(np.int64), "shingles": [shingles(t, width).tobytes() for t in batch["text"]]})

    full = docs.select("doc_id", "text").mapInPandas(tidy(sets), "id long, shingles binary").join(members, "id")
    full = written(full, "sets")

    def compare(batches):
        for g in groups(batches, ["component_id"]):
            if len(g) > 1:
                a, b = by_sets(g["id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["shingles"]], percent)
                yield pd.DataFrame({"a": a, "b": b})

    big = full.groupBy("component_id").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).where((F.col("rows") > GROUP_ROWS) | (F.col("size") > GROUP_SHINGLES))
    big = written(big.select("component_id", F.ceil(F.col("rows") / GROUP_BLOCK).alias("blocks")), "big")
    if not big.count():
        return full.repartition("component_id").sortWithinPartitions("component_id").mapInPandas(tidy(compare), cc.EDGE)
    small = full.join(big, "component_id", "left_anti").select("component_id", "id", "shingles")
    parted = written(by_prefixes(full.join(big.select("component_id"), "component_id").select("component_id", "id", "n", "shingles"), percent), "parted")
    large = parted.groupBy("component_id").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).where((F.col("rows") > GROUP_ROWS) | (F.col("size") > GROUP_SHINGLES))
    large = written(large.select("component_id", F.ceil(F.col("rows") / GROUP_BLOCK).alias("blocks")), "large")
    small = small.union(parted.join(large, "component_id", "left_anti").select("component_id", "id", "shingles"))
    out = small.repartition("component_id").sortWithinPartitions("component_id").mapInPandas(tidy(compare), cc.EDGE)
    return out.union(spread(parted.join(large, "component_id"), percent)) if large.count() else out


def by_prefixes(members: DataFrame, percent: int) -> DataFrame:
    """members (component_id, id, n, shingles: written) with groups of their own that share a rare shingle, named by their smallest id; those that share none are left out.

    Of two sets that share so many of their shingles, each has a shared one among the first len - ceil(len percent / 100) + 1 of its own, whatever the order of all shingles is. It is by
    counters, then by hash. A counter of one shows that no other member has a shingle; the others are shuffled by shingle and group, a row each."""
    wide = np.uint64(64 - COUNTERS)

    def places(s: np.ndarray) -> np.ndarray:
        return (mix(s) >> wide).astype(np.int64)

    def count(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(places(np.frombuffer(b"".join(batch["shingles"]), np.uint64)), minlength=len(total))
        for i, part in enumerate(total.reshape(64, -1)):
            if part.any():
                yield pd.DataFrame({"part": [i], "n": [part.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [g["part"].iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in g["n"]).tobytes()]})

    counts = np.zeros((64, (1 << COUNTERS) // 64), np.int64)
    for r in members.select("shingles").mapInPandas(tidy(count), "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary").collect():  # at most 64 rows, the sketch
        counts[r["part"]] = np.frombuffer(r["n"], np.int64)
    known = members.sparkSession.sparkContext.broadcast(counts.ravel())

    def rare(batches):
        for batch in batches:
            ids, found = [], []
            for i, x in zip(batch["id"], batch["shingles"], strict=True):
                s = np.frombuffer(x, np.uint64)
                n = known.value[places(s)]
                first = np.lexsort((s, n))[: len(s) + 1 - -(-len(s) * percent // 100)]
                shared = s[first[n[first] > 1]]
                ids.append(np.full(len(shared), i, np.int64))
                found.append(shared.view(np.int64))
            yield pd.DataFrame({"id": np.concatenate([np.zeros(0, np.int64), *ids]), "shingle": np.concatenate([np.zeros(0, np.int64), *found])})

    held = written(members.select("id", "shingles").mapInPandas(tidy(rare), "id long, shingle long").join(members.select("id", "component_id"), "id"), "rare")
    least = held.groupBy("component_id", "shingle").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("component_id", "shingle", "a")
    stars = held.join(least, ["component_id", "shingle"]).where("id <> a").select(F.col("id").alias("b"), "a").distinct()
    return members.drop("component_id").join(cc.components(written(stars, "stars")), "id")


def spread(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of large groups, as a forest. members: (id, shingles, component_id, blocks)."""
    group = ["component_id", "block"]
    members = written(members.select("component_id", "id", "shingles", "blocks", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).alias("block")), "spread")
    state = members.select("component_id", "id").distinct().withColumns({"label": F.col("id"), "asked": F.lit(False)})
    most, turn = PIVOTS, 0

    def compare(batches):
        for g in groups(batches, group):
            pivot = g["pivot"].to_numpy(bool)
            if pivot.any() and not pivot.all():
                ids, sets = g["id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["shingles"]]
                index = SetIndex([sets[i] for i in np.nonzero(~pivot)[0]], percent)
                own, label = ids[~pivot], g["label"].to_numpy()[~pivot]
                for i in np.nonzero(pivot)[0].tolist():
                    hit = index.linked(sets[i])
                    hit = hit[own[hit] != ids[i]]
                    if len(hit):
                        yield pd.DataFrame({"component_id": g["component_id"].iloc[0], "label": np.unique(label[hit]), "pivot": ids[i]})

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        """The pivots of a group (some thousands at most), joined where one label is linked with both; every pivot's own label is among its links."""
        names, at = np.unique(g[["pivot", "other"]].to_numpy(np.int64), return_inverse=True)
        at = at.reshape(-1, 2)
        lab = cc.labels(len(names), at[:, 0], at[:, 1])
        return pd.DataFrame({"component_id": g["component_id"].iloc[0], "pivot": names, "root": names[lab]})

    while True:
        sizes = state.groupBy("component_id", "label").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("component_id").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        left = Observation()
        open_ = state.join(largest, "component_id").where("label <> largest AND NOT asked")
        outside = open_.join(open_.groupBy("component_id").agg(F.count("*").alias("others")), "component_id").observe(left, F.count("*").alias("n"))
        drawn = F.col("others").cast("double") * F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) < F.lit(float(most << 30))
        pivots = written(outside.where(drawn).select("id", F.col("label").alias("own")), "pivots")
        if not left.get["n"]:
            return state.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
        labelled = members.join(state.select("id", "label"), "id")
        sent = members.join(pivots.select("id"), "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = labelled.select(*group, "id", "shingles", "label", F.lit(False).alias("pivot")).union(sent.select(*group, "id", "shingles", F.col("id"), F.lit(True)))
        dealt = both.repartition(*group).sortWithinPartitions(*group)
        links = written(dealt.mapInPandas(tidy(compare), "component_id long, label long, pivot long"), "links")
        own = members.select("component_id", "id").distinct().join(pivots, "id").select("component_id", F.col("own").alias("label"), F.col("id").alias("pivot"))
        links = links.union(own).distinct()
        first = links.groupBy("component_id", "label").agg(F.min("pivot").alias("other"))
        roots = links.join(first, ["component_id", "label"]).select("component_id", "pivot", "other").distinct().groupBy("component_id").applyInPandas(joined, "component_id long, pivot long, root long")
        merged = first.join(roots, (first["component_id"] == roots["component_id"]) & (F.col("other") == F.col("pivot"))).select(first["component_id"], "label", "root")
        least = merged.groupBy("component_id", "root").agg(F.min("label").alias("now"))
        renamed = merged.join(least, ["component_id", "root"]).select("component_id", "label", "now")
        after = state.join(renamed, ["component_id", "label"], "left").join(pivots.select("id", F.lit(True).alias("hit")), "id", "left")
        state = written(after.select("component_id", "id", F.coalesce("now", "label").alias("label"), (F.col("asked") | F.coalesce("hit", F.lit(False))).alias("asked")), "state")
        most, turn = min(MORE * most, MOST_PIVOTS), turn + 1


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of docs."""
    return _grouped(docs, written(signatures(docs, width), "signatures"), width, percent)


def _grouped(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    first = F.min_by(F.struct("doc_id", "n_shingles", "bands", "sketch"), "doc_id").alias("x")
    classes = signed.where("high IS NOT NULL").groupBy("high", "low").agg(first)
    classes = written(classes.select("high", "low", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch"), "classes")
    groups_ = cc.components(candidates(classes, percent))
    members = written(classes.select("id", "n").join(groups_, "id"), "members")
    comps = cc.components(confirmed(docs, members, width, percent))
    named = classes.select("high", "low", "id").join(comps, "id", "left").select("high", "low", F.coalesce("component_id", "id").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "high", "low").join(written(named, "named"), ["high", "low"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY) -> DataFrame:
    """docs with one document of each group: the one with the smallest id."""
    signed = written(signatures(docs, width), "signatures")
    lost = written(_grouped(docs, signed, width, percent).where("NOT kept").select("doc_id").distinct(), "lost")
    kept = bloom.without(docs, lost)
    again = written(signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "again")
    if not again.count():
        return kept
    repeats = bloom.suspected(docs.sparkSession, again, "doc_id", kept["doc_id"])
    same = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*[F.col(c) for c in docs.columns])))
    number = "_" + max(docs.columns, key=len)
    return kept.where(~repeats).unionByName(kept.where(repeats).withColumn(number, F.row_number().over(same)).where(F.col(number) == 1).drop(number))


def op8_minhash_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


QUERIES = {"op8_minhash_dedup": op8_minhash_dedup}
ORACLE = {
    "op8_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r(id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id"""
}
