import pytest

from harrow.llm.line_dedup import drop_lines, keys_of

SCHEMA = "doc_id long, text string, n_lines string, lang string"


def brute(rows):
    first, docs = {}, {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            for k in keys_of(t):
                docs.setdefault(k, set()).add(i)
    first = {k: min(v) for k, v in docs.items() if len(v) > 1}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = lines if i is None or t is None else [x for x in lines if first.get(x.strip(" \t\n\x0b\x0c\r").encode().translate(None).lower(), i) == i]
        out.append((i, t if t is None or len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    long = "A line that repeats"
    rows = [(i, f"own line {i} here\n{long}\n  {long.upper()}\t\nshort\n\nÄÖÜ äöü äöü {i % 3}\r", "x", None) for i in range(40)]
    rows += [(100, None, None, None), (101, "", None, "en"), (None, long, None, None), (None, None, None, None), (5, f"{long}\nagain in five", None, None), (102, "\n\n", None, None), (103, "é" * 9 + "\n" + "e" * 10, None, None), (104, "é" * 9 + "\n" + "e" * 10, None, None)]
    rows += [(200, "\n".join(f"line number {j} of a long text" for j in range(5000)), None, None)]
    got = drop_lines(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]  # the clashing column is replaced
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], key=str) == brute(rows)


def test_empty(spark):
    assert drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0
