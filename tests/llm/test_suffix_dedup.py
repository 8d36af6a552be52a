import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from harrow.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, kept string, _sd_id string, SPANS string, id string"


def brute(rows, length=200):
    found = Counter()
    for _, t, *_ in rows:
        b = S.utf8(t)
        found.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t, *_ in rows:
        b = S.utf8(t)
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if found[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [10**9, 15, 3])
def test_against_brute_force(spark, many):
    rnd = random.Random(5)
    words = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [words(rnd.randint(150, 700)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [rnd.choice([words(rnd.randint(0, 300)), rnd.choice(passages)[rnd.randint(0, 80) : rnd.randint(100, 700)]]) for _ in range(rnd.randint(0, 5))]
        rows.append((i, "".join(parts), "x"))
    rows = [(*r, "s", None, "i") for r in rows]
    more = [(1000, "x" * 1000, None), (1001, None, None), (1002, "", None), (5, rows[5][1], None), (None, passages[0] + "q", None), (None, passages[0] + "q", None), (1003, "a\0b" * 150, None)]
    rows += [(*r, "s", None, "i") for r in more]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6), many=many).collect()
    assert all(r["_sd_id"] == "s" and r["SPANS"] is None and r["id"] == "i" for r in got)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got], key=str) == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merged_transforms_mark_what_repeats():
    rnd, length = random.Random(3), 30
    for _ in range(25):
        base = [bytes(rnd.choice(b"ab") for _ in range(200)) for _ in range(3)]
        parts, number, info = [{} for _ in range(4)], 0, {}
        for _ in range(rnd.randint(2, 60)):
            k, high = rnd.randrange(3), rnd.randint(0, length - 4)
            low, b = rnd.randint(0, high), bytearray(base[k])
            for _ in range(rnd.randint(0, 3)):
                b[rnd.randrange(60, 140)] = rnd.choice(b"ab")
            rnd.choice(parts)[k * 7 + 2**63 * (k % 2), high, bytes(b[100 - high : 100 - low + length])] = rnd.random() < 0.1
        shards = []
        for p in parts:
            if p:
                key, left, several = np.array([k for k, _, _ in p], np.uint64), np.array([x for _, x, _ in p]), np.array(list(p.values()))
                order, reach, words, _, symbols, _ = S.transform(key, left, [d for _, _, d in p], length)
                rows = np.arange(number, number + len(p))
                info |= dict(zip(rows.tolist(), [(*k, v) for k, v in p.items()], strict=True))
                number += len(p)
                shards.append({"keys": key[order], "rows": rows[order], "lefts": (left * 2 + several)[order].astype(np.int16), "reaches": reach.astype(np.int16), "words": words, "bytes": symbols})
        found, _, marks = S.merged_marks(shards, length)
        strings = lambda k, x, d: {o: (k, o, d[x - o : x - o + length]) for o in range(max(0, length - len(d) + x), x + 1)}
        count = Counter(y for k, x, d, s in info.values() for y in list(strings(k, x, d).values()) * (1 + s))
        for i, n in enumerate(found.tolist()):
            own = strings(*info[n][:3])
            assert marks[i].tolist() == [o in own and count[own[o]] > 1 for o in range(marks.shape[1])]
