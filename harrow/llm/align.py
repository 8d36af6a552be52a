"""Alignment of two tokenizers over the same texts: groups of tokens between shared cuts, and counts of linked id pairs.

Both tokenizers cut a text into tokens that cover its bytes. A byte offset where tokens of both end is a shared cut; two
neighbouring cuts hold a group, the least run of tokens of one side that spells a run of the other. Groups are found by
divide and conquer: an interval of tokens takes the A end nearest its middle that bisection finds among the B ends too,
is cut there, and both halves go on alike; an interval without such an end is a leaf, a group. The intervals of all texts of
a block step together, as numpy arrays.

Encoding is the libraries' own. Both split a text at single spaces between visible characters whatever stands around them, if the
vocabularies are of that kind (checked), so that the parts between are encoded once and kept by a worker, KEPT_PARTS at most.

Two tokens are linked where their byte ranges overlap. Links are summed by id pair in each block of texts, blocks by shuffle,
and the sums come back to the blocks that hold a pair: a pair is sent once for each block, not for each text, and the largest
count of each B id is a table no longer than B's vocabulary. Blocks are bounded by BLOCK_CHARS or one text.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte for byte with a space before
it, has no tokens: zeros, and '' for groups. Rows are treated one by one, repeated ids too. Other columns pass through, but
for the text, which is dropped, and those named like the ones added, which they replace. No rows in, no rows out.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.bpe import byte_letters, slices
from harrow.llm.shared import documents, tidy, with_fields, written

BLOCK_CHARS = 2_000_000
KEPT_PARTS = 400_000
JOINED = 256  # parts encoded as one text
CALLED = 64  # such texts in one call of a library
#: A space that no vocabulary split at spaces joins with what is before it. Left out at its sides is all that counts as white space, or as nothing, in any version of Unicode, and the sign that stands for a space.
_VISIBLE = "[!-~\u00a1-\u167f\u1681-\u180d\u180f-\u1fff\u2010-\u2027\u2030-\u205e\u2070-\u2580\u2582-\u2fff\u3001-\ud7ff\uf900-\ufdff]"
SPACE = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")
_EDGES = re.compile(f"{_VISIBLE}(.*{_VISIBLE})?", re.S)
ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string"}
INNER = {"_block": "long", "_is_block": "boolean", "_pairs": "array<long>", "_times": "array<long>"}


class ByteLevel:
    """A vocabulary file in the tokenizers library's format, on the level of bytes. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.raw = f.read()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        out = Tokenizer.from_str(self.raw)
        out.encode_special_tokens = True
        return out

    @cached_property
    def token_bytes(self) -> list[bytes]:
        byte = {x: bytes([i]) for i, x in enumerate(byte_letters())}
        vocab = self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            out[i] = b"".join(byte.get(x) or x.encode("utf-8") for x in token)
        return out

    @cached_property
    def splits(self) -> bool:
        """Whether words with the space before them are encoded on their own."""
        spec = json.loads(self.raw)
        return spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of the texts with a space before them."""
        return [x.ids for x in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def __getstate__(self):
        return {"raw": self.raw}


class Pieces:
    """A model file in the sentencepiece library's format, which puts the space before a text itself."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = f.read()

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        sp = self.library
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]

    @cached_property
    def splits(self) -> bool:
        """Whether no piece goes on over a space into the next word."""
        sp = self.library
        return not any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []

    def __getstate__(self):
        return {"raw": self.raw}


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end at a shared cut.

    Ends ascend over all texts; bounds hold each text's first token and the last's end. Every text ends at a shared cut.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    a_cut[a_bounds[1:] - 1] = b_cut[b_bounds[1:] - 1] = True
    low, high = a_bounds[:-1], a_bounds[1:]  # of A tokens: B's bounds follow from the cuts
    tried = np.zeros(len(low), np.int64)
    while len(low):
        # the middle first, then one further to either side in turn
        far = (tried + 1) >> 1
        at = ((low + high - 2) >> 1) + np.where(tried & 1, far, -far)
        inside = (at >= low) & (at < high - 1)
        at = np.where(inside, at, low)
        found = np.searchsorted(b_ends, a_ends[at])
        hit = inside & (b_ends[found] == a_ends[at])
        a_cut[at[hit]] = b_cut[found[hit]] = True
        # halves stand where their interval stood, so that what is searched ascends
        lows = np.stack([low, np.where(hit, at + 1, low)], 1).ravel()
        highs = np.stack([np.where(hit, at + 1, high), high], 1).ravel()
        tries = np.stack([np.where(hit, 0, tried + 1)] * 2, 1).ravel()
        alive = np.stack([np.ones(len(hit), bool), hit], 1).ravel() & (tries < highs - lows)
        low, high, tried = lows[alive], highs[alive], tries[alive]
    return a_cut, b_cut


def linked(a_ends: np.ndarray, a_lens: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens whose bytes overlap."""
    first = np.searchsorted(b_ends, a_ends - a_lens, side="right")
    count = np.searchsorted(b_ends, a_ends) - first + 1
    a = np.repeat(np.arange(len(a_ends)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Aligner:
    """Aligns the texts of a block."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = (a, b)
        self.names = [pa.array(x.token_bytes, pa.binary()) for x in self.sides]
        self.lens = [np.array([len(t) for t in x.token_bytes], np.int64) for x in self.sides]
        n_a, n_b = map(len, self.lens)
        self.n_b = n_b
        self.words = pa.array([f"{i},".encode() for i in range(n_a)] + [f"{i}|".encode() for i in range(n_a)] + [f"{i},".encode() for i in range(n_b)] + [f"{i};".encode() for i in range(n_b)], pa.binary())
        self.offset = (0, n_a, 2 * n_a, 2 * n_a + n_b)
        self.splits = a.splits and b.splits
        self.fresh()

    def fresh(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.size = [np.zeros(0, np.int64) for _ in self.sides]
        self.start = [np.zeros(0, np.int64) for _ in self.sides]

    def learn(self, parts: list[str]) -> None:
        """Encodes parts not met before. Many that can stand between single spaces go as one text, whose tokens are told apart by their bytes; a text whose tokens spell something else goes part by part."""
        edges = [bool(self.splits and _EDGES.fullmatch(p)) for p in parts]
        parts = [p for p, e in zip(parts, edges, strict=True) if e] + [p for p, e in zip(parts, edges, strict=True) if not e]
        n = sum(edges)
        groups = [parts[i : min(n, i + JOINED)] for i in range(0, n, JOINED)]
        ends = [np.cumsum([len(p.encode("utf-8")) + 1 for p in g]) for g in groups]
        for k, side in enumerate(self.sides):
            ids, sizes = [self.flat[k]], []
            for i in range(0, len(groups), CALLED):
                for own, g, end in zip(side.encode([" ".join(g) for g in groups[i : i + CALLED]]), groups[i : i + CALLED], ends[i : i + CALLED], strict=True):
                    own = np.array(own, np.int32)
                    done = np.cumsum(self.lens[k][own])
                    at = np.searchsorted(done, end)
                    if done[-1] != end[-1] or (done[at] != end).any():
                        apart = side.encode(g)
                        own, at = np.array([*chain.from_iterable(apart)], np.int32), np.cumsum([len(x) for x in apart]) - 1
                    ids.append(own)
                    sizes.append(np.diff(np.concatenate([[-1], at])))
            for i in range(n, len(parts), JOINED):
                apart = side.encode(parts[i : i + JOINED])
                ids.append(np.array([*chain.from_iterable(apart)], np.int32))
                sizes.append(np.array([len(x) for x in apart], np.int64))
            size = np.concatenate([np.zeros(0, np.int64), *sizes])
            self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.size[k], self.flat[k] = np.concatenate([self.size[k], size]), np.concatenate(ids)
        self.at.update(zip(parts, range(len(self.at), len(self.at) + len(parts)), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Of each side all ids, how many each text has, and the tokens' bytes."""
        if len(self.at) > KEPT_PARTS:
            self.fresh()
        split = [SPACE.split(t) for t in texts] if self.splits else [[t] for t in texts]
        self.learn(list(set(chain.from_iterable(split)) - self.at.keys()))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        part = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for flat, start, size, names in zip(self.flat, self.start, self.size, self.names, strict=True):
            own = size[part]
            ends = np.cumsum(own)
            ids = flat[np.arange(int(own.sum())) + np.repeat(start[part] - ends + own, own)]
            out.append((ids, np.diff(np.concatenate([[0], ends])[bounds]), names.take(pa.array(ids))))
        return out

    def align(self, texts: list[str | None]) -> dict:
        """n_a, n_b, n_groups, n_links and groups of each text, and which pairs are linked how often in it: text, pair, times."""
        n = len(texts)
        asked = np.array([i for i, t in enumerate(texts) if t], np.int64)
        own = [texts[i] for i in asked.tolist()]
        coded = self.encode(own)
        whole = np.ones(len(own), bool)
        wanted = [b" " + t.encode("utf-8") for t in own]
        for ids, counts, tokens in coded:
            offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
            data = memoryview(tokens.buffers()[2] or b"").cast("B")
            at = offsets[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
            for k, want in enumerate(wanted):
                whole[k] &= at[k + 1] - at[k] == len(want) and data[at[k] : at[k + 1]] == want
        (a, a_n), (b, b_n) = [(ids[np.repeat(whole, counts)], counts[whole]) for ids, counts, _ in coded]
        good = asked[whole]
        out = {x: np.zeros(n, np.int64) for x in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [b""] * n, "text": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        if not len(good):
            return out
        a_lens = self.lens[0][a]
        a_ends, b_ends = np.cumsum(a_lens), np.cumsum(self.lens[1][b])
        a_bounds, b_bounds = [np.concatenate([[0], np.cumsum(x)]) for x in (a_n, b_n)]
        a_cut, b_cut = shared_cuts(a_ends, b_ends, a_bounds, b_bounds)
        a_last, b_last = np.nonzero(a_cut)[0], np.nonzero(b_cut)[0]  # of each group
        a_group, b_group = [np.cumsum(x) - x for x in (a_cut, b_cut)]  # of each token
        out["n_a"][good], out["n_b"][good] = a_n, b_n
        out["n_groups"][good] = np.add.reduceat(a_cut.astype(np.int64), a_bounds[:-1])
        # A's tokens of a group, then B's, each with the mark that follows it
        code = np.empty(len(a) + len(b), np.int64)
        b_before = np.concatenate([[0], b_last + 1])
        code[np.arange(len(a)) + b_before[a_group]] = a + np.where(a_cut, self.offset[1], self.offset[0])
        code[np.arange(len(b)) + a_last[b_group] + 1] = b + np.where(b_cut, self.offset[3], self.offset[2])
        marked = self.words.take(pa.array(code))
        at = np.frombuffer(marked.buffers()[1], np.int32, len(code) + 1)[a_bounds + b_bounds].tolist()
        data = memoryview(marked.buffers()[2])
        for k, i in enumerate(good.tolist()):
            out["groups"][i] = bytes(data[at[k] : at[k + 1] - 1])
        left, right = linked(a_ends, a_lens, b_ends)
        text = np.searchsorted(a_bounds, left, side="right") - 1
        out["n_links"][good] = np.bincount(text, minlength=len(good))
        pair = a[left].astype(np.int64) * self.n_b + b[right]
        wide = np.int64(len(self.lens[0])) * self.n_b
        every = np.sort(text * wide + pair)
        new = np.concatenate([[True], every[1:] != every[:-1]])
        start = np.nonzero(new)[0]
        text, pair = np.divmod(every[start], wide)
        return out | {"text": good[text], "pair": pair, "times": np.diff(np.concatenate([start, [len(every)]]))}


class Sides:
    """Both tokenizers, and the aligner that a worker keeps for its tasks with the parts that it has met."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.pair = (a, b)

    @cached_property
    def aligner(self) -> Aligner:
        return Aligner(*self.pair)

    def __getstate__(self):
        return {"pair": self.pair}


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links and groups (`a1,a2|b1;a3|b2,b3`: ids of A and of B) added.

    Rows of blocks stand among them, with the pairs that all texts of a block link; tally() sums these and leaves them out.
    """
    kept = [c for c in docs.columns if c not in {text, *ADDED, *INNER}]
    docs = docs.select(*kept, F.col(text).alias("_text"))
    schema = with_fields(docs.select(kept).schema, **ADDED)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(c, T._parse_datatype_string(kind) if kind.startswith("array") else T.StructType.fromDDL(f"x {kind}")["x"].dataType) for c, kind in INNER.items()])
    sides = docs.sparkSession.sparkContext.broadcast(Sides(ByteLevel(a_path), Pieces(b_path)))
    added = [*ADDED]

    def run(batches):
        aligner, block = sides.value.aligner, TaskContext.get().partitionId() << 33
        longs = lambda x: pa.array(x, pa.int64())
        lists = lambda bounds, x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), longs(x))
        for whole in batches:
            for batch in slices(whole, "_text", BLOCK_CHARS):
                found, n = aligner.align(batch.column("_text").to_pylist()), batch.num_rows
                columns = [batch.column(c) for c in kept] + [longs(found[c]) for c in added[:-1]] + [pa.array(found["groups"], pa.binary()).cast(pa.string())]
                bounds = np.searchsorted(found["text"], np.arange(n + 1))
                columns += [longs(np.full(n, block)), pa.array(np.zeros(n, bool)), lists(bounds, found["pair"]), lists(bounds, found["times"])]
                out = pa.RecordBatch.from_arrays(columns, names=[*kept, *added, *INNER])
                yield out
                order = np.argsort(found["pair"], kind="stable")
                pair, times = found["pair"][order], found["times"][order]
                start = np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0] if len(pair) else np.zeros(0, np.int64)
                own = [[block], [True], [pair[start]], [np.add.reduceat(times, start) if len(start) else times]]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in out.schema if f.name not in INNER), *(pa.array(x, out.schema.field(c).type) for x, c in zip(own, INNER, strict=True))], names=out.schema.names)
                block += 1

    return docs.mapInArrow(tidy(run), schema)


def tally(aligned: DataFrame, b_size: int) -> DataFrame:
    """What align() gave (columns may have been added or dropped), with n_best and count_sum in place of its blocks.

    The count of a pair is how many links of the corpus have it. n_best: links whose count is the highest of their B id.
    """
    aligned = written(aligned.drop("n_best", "count_sum"), "aligned")
    pairs = aligned.where("_is_block").select("_block", F.explode(F.arrays_zip("_pairs", "_times")).alias("x")).select("_block", F.col("x._pairs").alias("_pair"), F.col("x._times").alias("_n"))
    counts = written(pairs.groupBy("_pair").agg(F.sum("_n").alias("_count")), "pairs")
    b_id = F.col("_pair") % b_size
    highest = counts.groupBy(b_id.alias("_b")).agg(F.max("_count").alias("_most"))  # no more rows than B has ids
    counts = counts.withColumn("_b", b_id).join(F.broadcast(highest), "_b").select("_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best"))
    back = pairs.select(F.col("_block").alias("_of"), "_pair").join(counts, "_pair")
    docs = aligned.where("NOT _is_block").drop("_is_block")
    out = [c for c in docs.columns if c not in INNER]

    def settle(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("_pair")
        sizes = own["_pairs"].map(len).to_numpy(np.int64)
        result = own[out].assign(n_best=np.int64(0), count_sum=np.int64(0))
        if sizes.sum():
            at = np.searchsorted(known["_pair"].to_numpy(), np.concatenate(own["_pairs"].to_list()))
            times = np.concatenate(own["_times"].to_list())
            ends = np.cumsum(sizes)
            for name, value in (("n_best", times * known["_best"].to_numpy()[at]), ("count_sum", times * known["_count"].to_numpy()[at])):
                total = np.concatenate([[0], np.cumsum(value)])
                result[name] = total[ends] - total[ends - sizes]
        return result

    schema = with_fields(docs.select(out).schema, n_best="long", count_sum="long")
    return docs.groupBy("_block").cogroup(back.groupBy("_of")).applyInPandas(settle, schema)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    a, b = default_paths()
    a, b = a_path or a, b_path or b
    aligned = align(documents(spark, sf_dir).select("doc_id", "text"), a, b)
    groups = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = tally(aligned.withColumn("groups_sha256", F.when(~F.col("_is_block"), groups)).drop("groups"), len(Pieces(b).token_bytes))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE: dict = {}
