"""Language ID: scripts narrow the candidates, then Viterbi over the words' scores labels the spans of each text.

A word is a run of letters of one script. Its score for a language is the log-probability of its letter trigrams and of
the whole word, relative to the best language and clipped, so that one odd word cannot outweigh its neighbours. Only
languages that write in the word's script compete; words that no language can hold go to the state und. Going from one
language to another costs SWITCH, so that Viterbi gives spans, also of texts in several languages.

Learning: from labelled rows alone, SAMPLE documents of each language in expectation (a documented bound; documents are
chosen by a hash of their id), read whole. Every label is learned, however rare. Counts are summed by Spark into BUCKETS hashed
features for each language, so that what reaches the driver is bounded by languages times BUCKETS, whatever the corpus.

Defined results: a null text, or one without a letter, is und with score 0 and no spans. With nothing to learn from, every text is
und. A text whose letters no language can hold gets the most frequent language with score 0. Rows are judged one by one;
other columns pass through, but for those named like the ones added, which they replace.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.bpe import slices
from harrow.llm.shared import documents, tidy

SAMPLE = 3000
BUCKETS = 1 << 16
SWITCH, CLIP, NEVER = 6.0, 4.0, -1e6
UND = "und"
LEAST_SHARE = 0.005  # of a language's letters, for a script to count as one of its own
SLICE, TOGETHER = 250_000, 3_000_000  # code points featured at once, and labelled at once, with up to FEW states
FEW = 5  # with more states both shrink, so that words times states stay the same
HELD = 400  # dense counts that a task holds before it passes them on
# First code points of script ranges and the script that begins there.
SCRIPTS = [
    (0, "other"), (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"),
    (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
NAMES = list(dict.fromkeys(name for _, name in SCRIPTS))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@functools.cache
def letter_scripts() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + its script."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.searchsorted([a for a, _ in SCRIPTS], np.arange(0x110000), side="right") - 1
    return np.where(letters, 1 + np.array([NAMES.index(n) for _, n in SCRIPTS])[script], 0).astype(np.uint8)


def features(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Words of all texts, one after the other: their text, first and last place, script and hashed features."""
    lowered = [_lower(t or "") for t in texts]
    lens = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("\0".join([*lowered, "\0"]).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = letter_scripts()[np.minimum(codes, 0x10FFFF)]
    inside = script > 0
    joined = inside[1:] & (script[1:] == script[:-1])  # the next code point continues the word
    first = np.nonzero(inside & ~np.concatenate([[False], joined]))[0]
    last = np.nonzero(inside & ~np.concatenate([joined, [False]]))[0]
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    doc = np.searchsorted(starts, first, side="right") - 1
    at = np.nonzero(inside)[0]
    size = last - first + 1
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    own = codes[at].astype(np.uint64)
    left = np.concatenate([[np.uint64(0)], own[:-1]]) if len(own) else own
    right = np.concatenate([own[1:], [np.uint64(0)]]) if len(own) else own
    left[begin], right[begin + size - 1] = 0, 0
    mixed = left * _A + own * _B + right * _C
    mixed ^= mixed >> np.uint64(29)
    mixed *= _B
    trigram = (mixed >> np.uint64(48)).astype(np.int64)
    within = (np.arange(len(at)) - np.repeat(begin, size)).astype(np.uint64)
    word = np.add.reduceat(mixed * (within * _A | np.uint64(1)), begin) if len(begin) else np.zeros(0, np.uint64)
    word = ((word * _C) >> np.uint64(48)).astype(np.int64)
    spans = {"doc": doc, "start": first - starts[doc], "end": last + 1 - starts[doc], "size": size}
    return {k: v.astype(np.int32) for k, v in spans.items()} | {"script": script[first] - 1, "trigram": trigram, "begin": begin, "word": word}


def _lower(text: str) -> str:
    """Lower case that keeps every code point's place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Model:
    def __init__(self, langs: list[str], trigrams: np.ndarray, words: np.ndarray, scripts: np.ndarray):
        """Counts by feature and language, and by script and language; langs: the most frequent first."""
        self.langs = langs
        self.trigram = np.log((trigrams + 0.5) / (trigrams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
        self.word = np.log((words + 0.1) / (words.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)
        self.allowed = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.allowed &= scripts > 0

    def emissions(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """The score of each word for each language, and last for und."""
        n = len(f["word"])
        if not n:
            return np.zeros((0, len(self.langs) + 1), np.float32)
        total = np.add.reduceat(self.trigram[f["trigram"]], f["begin"], axis=0) + self.word[f["word"]]
        allowed = self.allowed[f["script"]]
        total = np.where(allowed, total, NEVER)
        best = total.max(axis=1, keepdims=True)
        out = np.where(allowed, np.maximum(total - best, -CLIP), NEVER)
        return np.concatenate([out, np.where(allowed.any(axis=1), NEVER, 0.0)[:, None]], axis=1).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of each word. scores: word by state, all sequences one after the other; lengths: their words."""
    n, states = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right").tolist()
    kind = np.min_scalar_type(-states)  # the smallest signed type that holds every state
    came = np.zeros(scores.shape, kind)
    value, own = np.zeros((n, states), np.float32), np.arange(states, dtype=kind)
    for t, k in enumerate(active):
        at, now = start[:k] + t, value[:k]
        best = now.argmax(axis=1)
        moved = (now[np.arange(k), best] - switch)[:, None]
        came[at] = np.where(now >= moved, own, best[:, None])
        value[:k] = np.maximum(now, moved) + scores[at] if t else scores[at]
    out = np.zeros(len(scores), kind)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        out[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows (doc_id, text, lang) without nulls; None if there are none."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def passed(sums):
        for (lang, kind), counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pd.DataFrame({"lang": lang, "kind": kind, "at": at, "n": counts[at].astype(np.int64)})

    def count(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for i in range(0, len(texts), 200):
                    f = features(texts.iloc[i : i + 200].tolist())
                    for kind, values, weights, width in ((0, f["trigram"], None, BUCKETS), (1, f["word"], None, BUCKETS), (2, f["script"], f["size"], len(NAMES))):
                        counts = np.bincount(values, weights, minlength=width)
                        sums[lang, kind] = sums.get((lang, kind), 0) + counts
                if len(sums) > HELD:
                    yield from passed(sums)
                    sums = {}
        yield from passed(sums)

    found = chosen.select("lang", "text").mapInPandas(tidy(count), "lang string, kind int, at int, n long")
    totals = found.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros((width, len(langs))) for width in (BUCKETS, BUCKETS, len(NAMES))]
    place = {lang: i for i, lang in enumerate(langs)}
    for (lang, kind), rows in totals.groupby(["lang", "kind"]):
        tables[kind][rows["at"], place[lang]] = rows["n"]
    return Model(langs, *tables)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def label(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of its letters in spans of that language), known (the share in spans of any language) and spans (lang, start, end in code points) added."""
    docs = docs.drop("lang_pred", "score", "known", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batch: pa.RecordBatch, found: list[dict], scores: list[np.ndarray]) -> pa.RecordBatch:
        own, n = shared.value, batch.num_rows
        f = {k: np.concatenate([x[k] for x in found]) for k in ("doc", "start", "end", "size")}
        state = viterbi(np.concatenate(scores), np.bincount(f["doc"], minlength=n))
        letters = np.zeros((n, len(own.langs) + 1))
        np.add.at(letters, (f["doc"], state), f["size"])
        best, total = letters[:, :-1].argmax(axis=1), letters.sum(axis=1)
        names = np.array([*own.langs, UND], object)
        pred = np.where(total > 0, names[best], UND)
        score = letters[np.arange(n), best] / np.maximum(total, 1)
        known = letters[:, :-1].sum(axis=1) / np.maximum(total, 1)
        opens = np.nonzero((np.diff(f["doc"], prepend=-1) != 0) | (np.diff(state, prepend=-1) != 0))[0]
        closes = np.concatenate([opens[1:] - 1, [len(state) - 1]]) if len(opens) else opens
        parts = pa.StructArray.from_arrays([pa.array(names[state[opens]], pa.string()), pa.array(f["start"][opens].astype(np.int32)), pa.array(f["end"][closes].astype(np.int32))], names=["lang", "start", "end"])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(f["doc"][opens], minlength=n))])
        spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64()), spans], names=[*batch.schema.names, "lang_pred", "score", "known", "spans"])

    def run(batches):
        part_of = max(1, (len(shared.value.langs) + 1) / FEW)
        for whole in batches:
            for batch in slices(whole, text, int(TOGETHER / part_of)):
                found, scores, done = [], [], 0
                for part in slices(batch, text, int(SLICE / part_of)):
                    f = features(part.column(text).to_pylist())
                    scores.append(shared.value.emissions(f))
                    found.append({k: f[k] for k in ("start", "end", "size")} | {"doc": f["doc"] + np.int32(done)})
                    done += part.num_rows
                if found:
                    yield judged(batch, found, scores)

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType()), T.StructField("spans", SPANS)]
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0), "known": F.lit(0.0), "spans": F.array().cast(SPANS)})
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def labelled_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = label(docs.select("doc_id", "text"), learn(labelled_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict = {}
