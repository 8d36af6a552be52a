"""BPE encoding and decoding with a public vocabulary of words with word ends.

Text is normalised (NFC, runs of white space to a space, lower case), split into words, and each word's bytes are merged.
Merging uses a segment tree over the ranks of adjacent pairs: a leaf holds the rank of the pair that starts there (and its
place), an inner node the smaller of its two; the root is thus the leftmost pair of lowest rank. A merge changes three
leaves, whose paths to the root are recomputed, until the root says that no pair can be merged. The trees of many words
are rows of one numpy matrix and step together; words are grouped by the size of their tree.

A text is never cut; each task keeps the words it has met, CACHE_WORDS at most, and starts anew beyond that.
Special tokens written in a text become their ids, as in the tokenizers library. Decoding joins the tokens of the
vocabulary with one space, as that library does for a vocabulary without a decoder.

Defined results: null and empty texts have no tokens and decode to the empty text. Rows are treated one by one; other columns
pass through, but for those named like the one added, which it replaces. A null list of ids decodes to null.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.shared import documents, sha256_hex, text_or_empty, tidy

CACHE_WORDS = 200_000
SLICE_CHARS = 1_000_000
LONG = 1024  # bytes; words beyond it are stepped one by one
NONE = np.int64(1) << np.int64(62)
# First and last code points that newer Unicode tables than the library's (16.0) make letters or numbers; to the library they are neither.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1C89, 0x1C89), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CB, 0xA7CC), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DA), (0xA7DC, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10D50, 0x10D65), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Capital letters that the library lowers and older Python tables don't know, as first, last and the small letter of the first.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_SMALL = {c: small + c - a for a, b, small in CAPITALS for c in range(a, b + 1)}
# Fixed value: how the vocabulary's words are found in normalised text.
_START, _LETTER, _NUMBER, _NEWER = r"'s|'t|'re|'ve|'m|'ll|'d|", r"\p{L}", r"\p{N}", "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
WORDS = regex.compile(rf"{_START}[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: The same for texts with a code point that RARE finds.
ALL_WORDS = regex.compile(rf"(?V1){_START}[{_LETTER}--[{_NEWER}]]+|[{_NUMBER}--[{_NEWER}]]|[^\s[[{_LETTER}{_NUMBER}]--[{_NEWER}]]]+")
RARE = regex.compile(f"[{_NEWER}{''.join(map(chr, _SMALL))}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies on the byte level: itself if printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordBpe:
    """A vocabulary file in the tokenizers library's format, of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.table, self.merged_list = None, self.merged.tolist()
        self.leads = {x[0] for x in self.special}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or -1; a negative token makes no pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, in an order of their own, with each word's start among them and its number."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, done = [np.zeros(0, np.int32)], 0
        classes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 2))).astype(int))
        for k in np.nonzero(lens > LONG)[0].tolist():
            ids = self._encode_long(words[k])
            start[k], size[k] = done, len(ids)
            flat.append(ids)
            done += len(ids)
        for width in np.unique(classes[(lens > 0) & (lens <= LONG)]).tolist():
            rows = np.nonzero((classes == width) & (lens > 0) & (lens <= LONG))[0]
            step = max(1, 400_000 // width)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                ids, counts = self._encode([words[k] for k in some.tolist()], width)
                start[some], size[some] = done + np.cumsum(counts) - counts, counts
                flat.append(ids)
                done += len(ids)
        return np.concatenate(flat), start, size

    def _encode(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        n, lens = len(words), np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        place = np.arange(size)
        live = place < lens[:, None]
        token = np.where(live, self.inner[raw], -1)
        token[np.arange(n), lens - 1] = self.last[raw[np.arange(n), lens - 1]]
        # one more column: what lies beyond either end, a token that makes no pair
        token = np.concatenate([token, np.full((n, 1), -1)], axis=1)
        after = np.tile(np.minimum(place + 1, size), (n, 1))
        after = np.concatenate([np.where(place + 1 < lens[:, None], after, size), np.full((n, 1), size)], axis=1)
        before = np.concatenate([np.tile(np.where(place == 0, size, place - 1), (n, 1)), np.full((n, 1), size)], axis=1)
        tree = np.full((n, 2 * size), NONE)

        def leaf(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            rank = self.rank(left, right)
            return np.where(rank >= 0, rank * size + at, NONE)

        tree[:, size:] = leaf(token[:, :size], token[:, 1:], place)
        for level in range(size.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        row = np.nonzero(tree[:, 1] < NONE)[0]
        while len(row):
            rank, at = np.divmod(tree[row, 1], size)
            gone = after[row, at]
            follow, lead = after[row, gone], before[row, at]
            new = self.merged[rank]
            token[row, at], token[row, gone] = new, -1
            after[row, at], before[row, follow] = follow, at
            after[row, gone] = size
            tree[row, size + at] = leaf(new, token[row, follow], at)
            tree[row, size + gone] = NONE
            has = lead < size
            led, lead_at = row[has], lead[has]
            tree[led, size + lead_at] = leaf(token[led, lead_at], new[has], lead_at)
            for r, node in ((row, size + at), (row, size + gone), (led, size + lead_at)):
                while node[0] > 1 if len(node) else False:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        kept = token[:, :size] >= 0
        return token[:, :size][kept].astype(np.int32), kept.sum(axis=1)

    def _encode_long(self, word: bytes) -> np.ndarray:
        """As _encode, for one word whose tree would step alone: the same tree in plain numbers, where a step costs a few levels of one path."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ranks, merged, n = self.table, self.merged_list, len(word)
        token = self.inner[np.frombuffer(word, np.uint8)].tolist()
        token[-1] = int(self.last[word[-1]])
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        tree = [none] * (2 * size)

        def leaf(at: int) -> int:
            then = after[at]
            rank = ranks.get(token[at] << 32 | token[then], -1) if then >= 0 else -1
            return rank * size + at if rank >= 0 else none

        def update(at: int, value: int) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        tree[size : size + n] = [leaf(i) for i in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            token[at], token[gone] = merged[rank], -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            update(gone, none)
            update(at, leaf(at))
            if before[at] >= 0:
                update(before[at], leaf(before[at]))
        return np.array([t for t in token if t >= 0], np.int32)

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of special tokens, in order."""
        if not any(c in text for c in self.leads):
            return words_of(text)
        out, done = [], 0
        for m in self.marks.finditer(text):
            out += words_of(text[done : m.start()])
            out.append(self.special[m[0]])
            done = m.end()
        return out + words_of(text[done:])


def words_of(text: str) -> list[str]:
    """White space only separates words, so that it needs no normalising of its own."""
    if text.isascii():
        return WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
    return ALL_WORDS.findall(text.translate(_SMALL)) if RARE.search(text) else WORDS.findall(text)


class Encoder:
    """Encodes many texts, keeping words met."""

    def __init__(self, bpe: WordBpe, most: int = CACHE_WORDS):
        self.bpe, self.most = bpe, most
        self._fresh()

    def _fresh(self) -> None:
        self.at: dict[str | int, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin and the last's end."""
        if len(self.at) > self.most:
            self._fresh()
        split = [self.bpe.pieces(t) if t else [] for t in texts]
        if new := list(set().union(*split) - self.at.keys()):
            marks = [w for w in new if isinstance(w, int)]
            new = marks + [w for w in new if not isinstance(w, int)]
            ids, start, size = self.bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in new[len(marks) :]])
            start = np.concatenate([np.arange(len(marks)), start + len(marks)]) + len(self.flat)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.array(marks, np.int32), ids])
            self.start = np.concatenate([self.start, start])
            self.size = np.concatenate([self.size, np.ones(len(marks), np.int64), size])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        first, size = self.start[word], self.size[word]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[take], bounds


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS):
    """A batch in parts of about so many characters of a column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        n = max(1, int(np.searchsorted(sizes, done + chars, side="right")) - start)
        yield batch.slice(start, n)
        start += n


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text added, as array<int>."""
    docs = docs.drop(ids)
    bpe = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    def run(batches):
        encoder = Encoder(bpe.value)
        for whole in batches:
            for batch in slices(whole, text):
                flat, bounds = encoder.encode(batch.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each list of ids added."""
    df = df.drop(text)
    tokens = df.sparkSession.sparkContext.broadcast(WordBpe(path).tokens)

    def run(batches):
        names = pa.array(tokens.value, pa.string())
        for whole in batches:
            lists = whole.column(ids)
            for start in range(0, whole.num_rows, 512):
                batch, own = whole.slice(start, 512), lists.slice(start, 512)
                words = names.take(own.flatten())
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                again = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words)
                texts = pc.if_else(pc.is_null(own), pa.scalar(None, pa.string()), pc.binary_join(again, " "))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir, path: str | None = None) -> DataFrame:
    path = path or default_path()
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    both = decode(encode(docs, path).select("doc_id", "ids"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict = {}
