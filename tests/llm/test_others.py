"""URL filters, BPE, PII, language ID, mixing and quality rules."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.llm import shared, bpe, langid, mixing, pii, quality, url_filter

SF = "/root/testdata/sf0.01"


def test_shift_and_against_regular_expressions():
    rnd = random.Random(3)
    some = lambda n: bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, n)))
    for _ in range(300):
        patterns = [[some(12) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 14))]
        texts = [some(30) for _ in range(12)] + [b"ab".join(p) for p in patterns] + [b"".join(p) for p in patterns]
        hit = url_filter.ShiftAnd(patterns).matches(texts)
        for i, t in enumerate(texts):
            for k, p in enumerate(patterns):
                assert hit[i, k] == bool(re.fullmatch(b"(?s)" + b".*".join(map(re.escape, p)), t))


def test_urls(spark):
    urls = ["https://Sub.Example.org/es/x?y#z", "http://example.org/en/12", "http://org/en", "https://example.com/de/", "https://x.com/fr/a", "https://evil.net/x.org/", "no address", None, "", "://", "http://example.org", "http://spam.example.net/" + "a" * 5000, "http://spam.example.net/"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(1, urls[1], "y")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got if r["page_id"] != 1] == [("example.org/es/", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block")]
    assert [r["rule"] for r in got if r["page_id"] == 1] == ["example.org/en/1"] * 2
    assert got[0]["host"] == "sub.example.org" and got[0]["path"] == "/es/x"


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    letters = "aAbBéÉ ñßΣσς中文字🎉👍🏽́  \t\n'stvemlld.,!<|endoftext|>12½٣ﬁ​"
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b <|startoftext|>", "ΑΣ ΑΣΑ", "x" * 5000, "", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    both = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5), path), path)
    got = {r["doc_id"]: r for r in both.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first()["decoded"] is None


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-%_+é1 ", max_size=24))
def test_emails_as_the_pattern_finds_them(text):
    assert [m.span() for m in pii._emails(text)] == [m.span() for m in pii.EMAIL.finditer(text)]


def test_pii(spark):
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    text = f"é mail a.b@x.org, ip 10.0.0.300 and 10.0.0.3, card {card} or 4111 1111 1111 1112, call +1 (017) 555-7713, iban {iban}, token = \"0a1b2c3d4e5f60718293a4b5\" commit 0a1b2c3d4e5f60718293a4b6"
    found = {(k, text[a:b]) for k, a, b, _ in pii.spans_of(text)}
    assert {("email", "a.b@x.org"), ("ip", "10.0.0.3"), ("card", card), ("phone", "+1 (017) 555-7713"), ("iban", iban)} <= found
    assert ("card_like", "4111 1111 1111 1112") in found and not any(v == "10.0.0.300" for _, v in found)
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "x " * 50_000)], "doc_id long, text string")
    rows = pii.find_pii(df).orderBy("doc_id").collect()
    assert [len(r["pii"]) for r in rows[2:]] == [0, 0, 0] and rows[0]["pii"] == rows[1]["pii"]
    hidden = pii.redact(df).where("doc_id = 1").first()["text"]
    assert "a.b@x.org" not in hidden and "[email]" in hidden and hidden.startswith("é mail")
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("after", ["", " BIC", " 2024"])
def test_iban_of_whole_groups(after):
    for one in ("AT61 1904 3002 3457 3201", "AT611904300234573201"):
        assert [(a, b) for k, a, b, _ in pii.spans_of(one + after) if k == "iban"] == [(0, len(one))]


def _iban(country: str, account: str) -> str:
    rest = int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    return f"{country}{98 - rest:02}{account}"


@pytest.mark.parametrize("country", ["NO", "BE", "AT", "DE", "ES", "PL", "FR", "MT", "ZZ"])
def test_ibans_before_other_tokens(country):
    one = _iban(country, ("1904300234573201" * 2)[: pii.IBAN_LENGTHS.get(country, 20) - 4])
    grouped = " ".join(one[i : i + 4] for i in range(0, len(one), 4))
    for written in (one, grouped):
        for before in ("", "account ", "RG20 2301 4711 "):
            for after in ("", ".", " BIC", " BICX", " 2024 EUR", " COBADEFFXXX", "\nBIC", " and"):
                text = before + written + after
                assert [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "iban"] == [written]
    assert not [x for x in pii.spans_of(one[:-1] + str((int(one[-1]) + 1) % 10) + " BIC") if x[0] == "iban"]


def test_secrets_of_any_length():
    for n in (24, 128, 129, 5000):
        value = ("0a1B2c3D4e5F60718293" * 250)[:n]
        text = f"token = {value}."
        assert [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "secret"] == [value]


def test_language_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(langid.labelled_rows(docs))
    judged = langid.label(docs, model).where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    text = {r["lang"]: r["text"] for r in docs.where("n_chars BETWEEN 800 AND 1200 AND text NOT LIKE '%|%' AND text NOT LIKE '%*%'").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = text["en"] + " " + text["de"]
    rows = [(1, mixed, "x"), (2, None, None), (3, "12 !", None), (4, "", None), (5, "Ω" * 50, None), (1, mixed, None)]
    got = langid.label(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).orderBy("doc_id").collect()
    spans = got[0]["spans"]
    assert {"en", "de"} <= {s["lang"] for s in spans} and 0 < got[0]["score"] < 1 and got[0]["spans"] == got[1]["spans"]
    assert sum(s["end"] - s["start"] for s in spans if s["end"] <= len(text["en"]) and s["lang"] == "en") > 0.8 * len(text["en"])
    assert [(r["lang_pred"], r["score"]) for r in got[2:5]] == [("und", 0.0)] * 3
    assert got[5]["lang_pred"] == model.langs[0] and got[5]["score"] == 0 and [s["lang"] for s in got[5]["spans"]] == ["und"]
    assert langid.learn(langid.labelled_rows(docs.limit(0))) is None
    assert langid.label(docs.select("doc_id", "text").limit(2), None).select("lang_pred").distinct().first()[0] == "und"


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(4)
    for _ in range(30):
        lengths = rnd.integers(0, 6, 4)
        scores = rnd.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
        got, a = langid.viterbi(scores, lengths, 0.7), 0
        for n in lengths:
            s = scores[a : a + n]
            value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            if n:
                assert abs(value(tuple(got[a : a + n])) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-4
            a += n


def test_more_labels_than_a_byte_holds(spark):
    import numpy as np

    rnd = np.random.default_rng(7)
    states = rnd.integers(0, 200, 40)
    scores = np.full((40, 200), -4.0, np.float32)
    scores[np.arange(40), states] = 0
    assert langid.viterbi(scores, np.full(20, 2), 0.5).tolist() == states.tolist()
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{w} {w[::-1]} " * 6, f"l{i:03}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    got = langid.label(docs, langid.learn(docs)).collect()
    assert len(got) == 300 and all(r["lang_pred"] == r["lang"] and r["score"] == 1 for r in got)
    assert all([s["lang"] for s in r["spans"]] == [r["lang"]] for r in got)


CELLS = "source string, lang string, topic string, tokens double"


def weights(cells, source, both):
    """Each cell's tokens times its three factors."""
    rows = cells.join(source, "source").join(both, ["lang", "topic"])
    return [(r, r["tokens"] * r["f_source"] * r["f_lang"] * r["f_topic"]) for r in rows.collect()]


def test_raking_to_given_targets(spark):
    rnd = random.Random(9)
    cells = [(s, lang, t, float(rnd.randint(1, 1000))) for s in ("a", "b", "") for lang in ("en", "de", "fr") for t in ("x", "y")]
    targets = {"source": {"a": 0.5}, "lang": {"en": 0.2, "de": 0.3, "fr": 0.5}, "topic": {"y": 0.7, "x": 0.3}}
    table = shared.written(spark.createDataFrame(cells, CELLS), "cells")
    source, both, most, gap = mixing.rake(table, targets)
    got = weights(table, source, both)
    total = sum(w for _, w in got)
    assert gap <= mixing.TOLERANCE and most == pytest.approx(max(w / r["tokens"] for r, w in got))
    own = {s: sum(c[3] for c in cells if c[0] == s) for s in ("b", "")}
    want = targets | {"source": {"a": 0.5, "b": 0.5 * own["b"] / sum(own.values()), "": 0.5 * own[""] / sum(own.values())}}
    for d, some in want.items():
        for name, share in some.items():
            assert sum(w for r, w in got if r[d] == name) / total == pytest.approx(share, abs=5e-4)


@pytest.mark.parametrize(
    "targets",
    [{"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, {"source": {"a": 0.7, "b": 0.7}}, {"source": {"nowhere": 0.5}}, {"source": {"a": 0.3, "b": 0.3}}, {"source": {"a": 0.0}}, {"country": {"a": 1.0}}],
)
def test_targets_that_cannot_be_met(spark, targets):
    cells = shared.written(spark.createDataFrame([("a", "en", "x", 5.0), ("b", "de", "x", 5.0)], CELLS), "cells")
    with pytest.raises(ValueError):
        mixing.rake(cells, targets)


def test_default_targets_that_contradict_each_other_say_so(spark):
    docs = spark.createDataFrame([(i, *s, "word " * n) for i, (s, n) in enumerate([(("a", "en"), 50), (("b", "en"), 5), (("c", "de"), 20)])], "doc_id long, source string, lang string, text string")
    rows = mixing.mix(docs).collect()
    assert rows and all(mixing.TOLERANCE < r["mix_gap"] < 0.2 for r in rows)


def test_mixing_samples_by_probability(spark):
    docs = [(i, "a" if i % 3 else "b", "en", "some words of a text") for i in range(3000)]
    kept = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, lang string, text string"), {"source": {"a": 0.5, "b": 0.5}}).collect()
    by = {s: [r for r in kept if r["source"] == s] for s in "ab"}
    assert len(by["b"]) == 1000 and abs(len(by["a"]) - 1000) < 100 and {round(r["mix_p"], 3) for r in by["a"]} == {0.5}


def test_mixing_edges(spark):
    rows = [(1, "a", "en", "some words"), (1, "a", "en", "some words"), (2, None, None, None), (3, "b", "de", ""), (None, "b", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("mix_p", F.lit("x")).withColumn("Mix_Gap", F.lit("x"))
    kept = mixing.mix(df).collect()
    assert sum(r["doc_id"] == 1 for r in kept) in (0, 2) and all(0 < r["mix_p"] <= 1 for r in kept)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n", "w " * 8, "a b c d e f g h " * 40, "\n".join(["a line of words here"] * 30), "$ # * " * 30, "x" * 100_000])
def test_quality_edges(spark, text):
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    rows = quality.judge(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["n_words"] == len((text or "").split()) and not rows[0]["kept"]


def test_quality_repeats_by_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        w = r["text"].split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
        assert r["n_repeat_words"] == len(covered)
    assert quality.judge(got.select("doc_id", "text").limit(0)).count() == 0
