"""Manifests against a tree built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from harrow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The top, and of each node its siblings left and right on each level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            proofs[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[k] = i // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([own[g][0] for g in names])
    out = []
    for g, top in zip(names, above, strict=True):
        for (_, _, digest, row), proof in zip(sorted(groups[g], key=lambda x: x[:3]), own[g][1], strict=True):
            whole = proof + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            at = leaf((*row[:4], row[4].replace("\n", ""))) if tampered else digest
            for left, right in whole:
                at = h(left, at, right)
            out.append((row[0], digest, own[g][0], root, h(*(a + b for a, b in whole)), at, at == root))
    return out


def query(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        df = df.withColumns({c: F.lit("mine") for c in ("g", "id", "h", "n", "i", "word", "proof", "subroot")})
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("spread", [1, 70_000, 1 << 40])
def test_manifest_against_plain_tree(spark, tmp_path, spread):
    rnd = random.Random(spread)
    rows = [(i * spread - 7 * spread, rnd.choice(["s", "s", "s", "t", None, "", "ü", "-"]), rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice([None, "", "a\nb", "é\n\n", "x" * 1000])) for i in range(300)]
    assert query(spark, rows, tmp_path, extra=True) == sorted(plain(rows), key=str)


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = [(i % 9 if i % 5 else None, "s", None, i % 4, f"t\n{i % 7}") for i in range(120)] + [(5, "s", None, 1, "t\n1")] * 30 + [(1, None, None, None, None)]
    assert query(spark, rows, tmp_path) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, "a\nb")], [(i, "s", "", 0, "") for i in range(82)]])
def test_small_tables(spark, tmp_path, rows):
    assert query(spark, rows, tmp_path) == sorted(plain(rows), key=str) if rows else query(spark, rows, tmp_path) == []


def test_places_without_sorting(spark):
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, 65, 1 << 22, (1 << 22) + 1, 1 << 38, -(1 << 40)]
    df = spark.createDataFrame([(g, i, "x") for g in ("a", "b") for i in ids], "g string, id long, h string")
    got = {(r["g"], r["id"]): (r["i"], r["n"]) for r in merkle.ranked(df).collect()}
    assert got == {(g, i): (k, len(ids)) for g in ("a", "b") for k, i in enumerate(sorted(ids))}
