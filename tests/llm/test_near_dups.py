"""MinHash and embedding near-dedup against brute force, components, and the pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import components, embeddings, minhash

SF = "/root/testdata/sf0.001"


def grouped(n, linked):
    lab = list(range(n))
    for a, b in linked:
        x, y = lab[a], lab[b]
        lab = [min(x, y) if v in (x, y) else v for v in lab]
    return lab


def near_texts(seed=1, n=160):
    rnd = random.Random(seed)
    words = lambda k: [rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvwxyz") + str(rnd.randint(0, 99)) for _ in range(k)]
    bases = [words(rnd.randint(60, 200)) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = words(1)[0]
        out.append(" ".join(w))
    return out + ["", None, "one", "One", "two words", "one"]


@pytest.mark.parametrize(("width", "bucket", "block"), [(2, 4096, 256), (5, 7, 5)])
def test_minhash_against_brute_force(spark, monkeypatch, width, bucket, block):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bucket)  # small, so that buckets become stars and groups are spread over blocks
    monkeypatch.setattr(minhash, "GROUP_ROWS", block)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", block)
    monkeypatch.setattr(minhash, "MORE", 3)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    texts = near_texts()

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(len(sets), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_texts_of_one_template(spark, monkeypatch):
    """Half a text is the template's: all share bands, none are linked but planted copies."""
    for name, value in (("BUCKET_ROWS", 8), ("GROUP_ROWS", 16), ("GROUP_BLOCK", 16)):
        monkeypatch.setattr(minhash, name, value)
    rounds = []
    spread = minhash.spread
    monkeypatch.setattr(minhash, "spread", lambda *x: rounds.append(1) or spread(*x))
    rnd = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    texts = [" ".join(template + [f"w{rnd.randrange(10**9)}" for _ in range(60)]) for _ in range(1500)]
    texts[100:110] = [f"{' '.join(texts[7].split()[:-1])} x{i}" for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: 7 if 100 <= i < 110 else i for i in range(1500)} and not rounds


def test_prefixes_part_no_linked_sets(spark):
    sets = [minhash.shingles(t, 2) for t in near_texts(5, 120) if t]
    members = spark.createDataFrame([(1, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "component_id long, id long, n long, shingles binary")
    of = {r["id"]: r["component_id"] for r in minhash.by_prefixes(minhash.written(members, "members"), 80).collect()}
    own = [set(s.tolist()) for s in sets]
    for a in range(len(own)):
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                assert of[a] == of[b]


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()], key=str)
    assert got == [(2, 2, True), (2, 2, True), (3, 2, False), (None, None, True)]
    assert sorted(str(r["doc_id"]) for r in minhash.dedup(df).collect()) == ["2", "None"]
    both = minhash.dedup(df.union(spark.createDataFrame([(2, "other words under the same id", "x")], df.schema))).collect()
    assert sorted(str(r["doc_id"]) for r in both) == ["2", "2", "None"] and all(r["kept"] == "x" for r in both)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketches_estimate_similarity():
    rnd = np.random.default_rng(0)
    for similarity in (0.5, 0.8, 0.95):
        shared = int(1000 * similarity)
        guesses = []
        for _ in range(20):
            x = rnd.integers(0, 1 << 63, 1000 + 1000 - shared, np.uint64)
            a, b = x[:1000], np.concatenate([x[:shared], x[1000:]])
            true = shared / (2000 - shared)
            bits = np.bitwise_count(np.bitwise_xor(*minhash.odd_sketches(np.stack([minhash.samples(a), minhash.samples(b)])))).sum()
            guesses.append(1 + minhash.BITS / (4 * minhash.HASHES) * np.log(max(1e-9, 1 - 2 * bits / minhash.BITS)))
        assert abs(np.mean(guesses) - true) < 0.06


@pytest.mark.parametrize("parts", [1, 5])
def test_components(spark, parts):
    rnd = random.Random(parts)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    want = grouped(600, edges)
    got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    assert got == {v: want[v] for e in edges for v in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "few"), [(2048, 256), (2048, 1), (16, 1), (16, 20)])
def test_embeddings_against_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(embeddings, "FEW", few)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 24))
    x = (centres[rnd.integers(0, 12, 240)] + rnd.normal(size=(240, 24)) * rnd.choice([0.02, 0.2, 0.35], 240)[:, None]).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, []), (302, [0.0] * 24), (303, [None] + [1.0] * 23), (304, [float("nan")] * 24), (305, [float("inf")] * 24), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e-30] * 24)]
    good = {i: np.array(v, np.float64) for i, v in rows if i not in range(300, 306)}
    ids = sorted(good)
    linked = [(a, b) for a in ids for b in ids if b < a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95]
    want = grouped(310, linked)
    number = [sum(i in e for e in linked) for i in range(310)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == {i: (number[i], want[i], want[i] == i) for i, _ in rows}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_against_its_steps(spark):
    import corpus_pipeline as P
    from harrow.llm import bpe, langid, line_dedup, mixing
    from tests.llm.test_line_dedup import brute as brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "BPE"]
    one = P.language(spark, docs, SF)
    model = langid.learn(langid.labelled_rows(docs))
    good = {r["doc_id"] for r in langid.label(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    kept = one.collect()
    assert {r["doc_id"] for r in kept} == good and one.columns == docs.columns
    two = P.lines(spark, one, SF)
    lined = {r["doc_id"]: r for r in two.collect()}
    assert sorted(((i, r["text"]) for i, r in lined.items()), key=str) == sorted(((i, t) for i, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in kept])), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lined.values())
    ids = sorted(lined)
    sets = [set(minhash.shingles(lined[i]["text"], 5).tolist()) for i in ids]
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = [i for k, i in enumerate(ids) if grouped(len(ids), linked)[k] == k]
    three = P.near_copies(spark, two, SF)
    assert sorted(r["doc_id"] for r in three.collect()) == first and three.columns == docs.columns
    four = P.mixture(spark, three, SF)
    con = duckdb.connect()
    con.register("three", three.select("doc_id", "source", "lang", "text").toPandas())
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(x[0] for x in con.execute(mixing._oracle("three")).fetchall()) and 0 < four.count() < len(first)
    final = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    assert sorted(final) == sorted(r["doc_id"] for r in four.collect())
    assert all(r["ids"] == library.encode(lined[i]["text"], add_special_tokens=False).ids for i, r in final.items())
    assert line_dedup.MIN_CHARS == 10


def test_pipeline_keeps_mixed_and_unlabelled_texts(spark):
    import corpus_pipeline as P
    from harrow.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 800 AND lang IS NOT NULL AND text NOT LIKE '%|%' AND text NOT LIKE '%*%'").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    cut = lambda lang, n: (text[lang] * 3)[:n]
    three = " ".join([cut("en", 800), cut("de", 700), cut("fr", 500)])
    more = spark.createDataFrame([(10**9, three), (10**9 + 1, "Ω" * 200 + " the end"), (10**9 + 2, "12 !")], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    judged = langid.label(more.limit(1), langid.learn(langid.labelled_rows(both))).first()
    assert judged["score"] < 0.5 < judged["known"]
    assert [r["doc_id"] for r in P.language(spark, both, SF).where("doc_id >= 1000000000").collect()] == [10**9]
    bare = P.language(spark, both.withColumn("lang", F.lit(None).cast("string")), SF)
    assert bare.columns == docs.columns and bare.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in both.collect())
    assert bare.where("lang <> 'und'").count() == 0
