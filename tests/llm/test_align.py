"""Alignment of tokenizers against a plain version: libraries on whole texts, cuts by set intersection, links by loops."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import align

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "é", " ", "1", "23", ".", "!?", "'s", "'", "中", "文", "　", "​", "😀", "<s>", "<|endoftext|>", "▁", "\x1c", " ", "Ж", "\x00", "ab", "the", " the", "᠎", "﻿", "́", "</s>", "<0x41>"]


@pytest.fixture(scope="module")
def sides():
    a, b = align.default_paths()
    return align.ByteLevel(a), align.Pieces(b)


def plain(texts, sides):
    """Per text n_a, n_b, groups and links, or None without tokens."""
    a, b = sides
    out = []
    for t in texts:
        own = (a.library.encode(" " + t, add_special_tokens=False).ids, b.library.encode(t)) if t else ([], [])
        spelled = [[s.token_bytes[i] for i in ids] for s, ids in zip(sides, own, strict=True)]
        if not t or any(b"".join(x) != (" " + t).encode() for x in spelled):
            out.append(None)
            continue
        ends = [list(accumulate(map(len, x))) for x in spelled]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            left, right = [], []
            while i < len(own[0]) and ends[0][i] <= cut:
                left.append(own[0][i])
                i += 1
            while j < len(own[1]) and ends[1][j] <= cut:
                right.append(own[1][j])
                j += 1
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        links, low = [], 0
        for i, end in enumerate(ends[0]):
            while ends[1][low] <= end - len(spelled[0][i]):
                low += 1
            j = low
            while j < len(own[1]) and ends[1][j] - len(spelled[1][j]) < end:
                links.append((own[0][i], own[1][j]))
                j += 1
        out.append((len(own[0]), len(own[1]), groups, links))
    return out


def rows(ids, texts, sides):
    found = plain(texts, sides)
    count = Counter(x for f in found if f for x in f[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    empty = (0, 0, 0, 0, 0, 0, "")
    return sorted((i, *(empty if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))) for i, f in zip(ids, found, strict=True))


def test_query_against_plain_version(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, align.op11_token_alignment(spark, SF).collect()))
    assert got == rows([r["doc_id"] for r in docs], [r["text"] for r in docs], sides)


def test_odd_texts(spark, sides):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " ", "x", "x", "a" * 5000, "中" * 3000, "ab " * 4000, " " * 3000, "\n" * 500 + "end", "▁", "a ▁ b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({c: F.lit(f"mine {c}") for c in ("other", "n_a", "_block", "groups")})
    out = align.tally(align.align(df, *align.default_paths()), len(sides[1].token_bytes))
    assert set(out.columns) == {"doc_id", "other", *align.ADDED, "n_best", "count_sum"}
    got = out.collect()
    assert all(r["other"] == "mine other" for r in got)
    digest = lambda r: hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else r["groups"]
    assert sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], digest(r)) for r in got) == rows(range(len(texts)), texts, sides)


def test_parts_are_encoded_as_in_whole_texts(sides):
    rnd = random.Random(5)
    texts = [x for x in ("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 40))) for _ in range(5000)) if x]
    aligner = align.Aligner(*sides)
    assert aligner.splits
    for side, (ids, counts, _) in zip(sides, aligner.encode(texts), strict=True):
        bounds = [0, *accumulate(counts.tolist())]
        assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [list(x) for x in side.encode(texts)]


def test_cuts_of_any_intervals():
    rnd = random.Random(7)
    for _ in range(200):
        a, b, a_bounds, b_bounds, base = [], [], [0], [0], 0
        for _ in range(rnd.randint(1, 5)):
            size = rnd.randint(1, 60)
            for ends, bounds in ((a, a_bounds), (b, b_bounds)):
                ends += sorted({base + rnd.randint(1, size) for _ in range(rnd.randint(0, 40))} | {base + size})
                bounds.append(len(ends))
            base += size
        got = align.shared_cuts(*map(np.array, (a, b, a_bounds, b_bounds)))
        assert [x for x, c in zip(a, got[0], strict=True) if c] == sorted(set(a) & set(b)) == [x for x, c in zip(b, got[1], strict=True) if c]


def test_no_rows(spark, sides):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.tally(align.align(df, *align.default_paths()), len(sides[1].token_bytes)).count() == 0
