"""Line dedup: a line that several documents hold stays only in the one with the smallest id.

Two Bloom filters, of line hashes seen once and seen twice, are built over all documents (see bloom.py). Only lines whose
hash the second filter holds are shuffled, with their text, to be confirmed exactly and given their first document. Of the
documents only those that lose a line (and the few that a third filter takes for such) are shuffled.

Defined results: a null or empty text is one empty line and stays as it is. Lines are counted by documents, so that a line
repeated only within one document stays. Rows that share a doc_id count as one document. Rows with a null doc_id take no
part and stay as they are. Other columns pass through, but for those named like the ones added, which they replace. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bloom
from harrow.llm.shared import documents, sha256_hex, tidy, with_fields, written

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes: only A-Z change


def long_enough(key: bytes, least: int = MIN_CHARS) -> bool:
    """At least so many code points; key is UTF-8."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def keys_of(text: str, least: int = MIN_CHARS) -> set[bytes]:
    return {k for k in map(line_key, text.encode("utf-8", "surrogatepass").split(b"\n")) if long_enough(k, least)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text, ...) with text shortened, and n_lines (before) and n_dropped added."""
    docs = docs.drop("n_lines", "n_dropped")
    used = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = used.agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("n")).first()["n"] or 0

    def hashes_of(batches):
        for batch in batches:
            yield np.concatenate([np.zeros(0, np.uint64), *(_hashes(keys_of(t, min_chars)) for t in batch["text"])])

    suspected = bloom.seen_twice(used, hashes_of, bloom.log2_bits(lines))

    def suspects(batches):
        for batch in batches:
            ids, keys, digests = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if own := list(keys_of(text, min_chars)):
                    hit = [k for k, yes in zip(own, suspected.holds(_hashes(own)), strict=True) if yes]
                    ids += [doc_id] * len(hit)
                    keys += hit
                    digests += map(xxhash.xxh3_128_digest, hit)
            yield pd.DataFrame({"doc_id": ids, "key": keys, "digest": digests})

    found = written(used.mapInPandas(tidy(suspects), "doc_id long, key binary, digest binary"), "lines")
    repeated = found.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.first("digest").alias("digest")).where("first_id < last_id")
    # confirmed on the lines themselves; from here on digests stand for them. Both sides of the join are then shuffled as they are, and Spark can split the partition of a frequent line
    repeated = written(repeated.select("digest", "first_id"), "repeated")
    losing = found.select("doc_id", "digest").join(repeated, "digest").where("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    losing = written(losing, "losing")
    suspect = bloom.suspected(docs.sparkSession, losing, "doc_id", docs["doc_id"])
    prefix = "own_"
    joined = docs.where(suspect).withColumnsRenamed({c: prefix + c for c in docs.columns}).join(losing, F.col(f"{prefix}doc_id") == F.col("doc_id"), "left").drop("doc_id")
    schema = with_fields(docs.schema, n_lines="long", n_dropped="long")

    def keep(batches):
        for batch in batches:
            out = batch.drop(columns="digests").rename(columns=lambda c: c[len(prefix) :])
            texts, before, dropped = [], [], []
            for text, digests in zip(out["text"], batch["digests"], strict=True):
                lost = set() if digests is None or text is None else set(map(bytes, digests))
                if not lost:
                    texts.append(text)
                    before.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                keys = map(line_key, lines)
                kept = [x for x, k in zip(lines, keys, strict=True) if not (long_enough(k, min_chars) and xxhash.xxh3_128_digest(k) in lost)]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            out["text"] = texts
            yield out.assign(n_lines=before, n_dropped=dropped)

    n_lines = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).cast("long")
    rest = docs.where(~suspect).select(*docs.columns, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return rest.unionByName(joined.mapInPandas(tidy(keep), schema))


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
_BLANK = r"[ \t\n\v\f\r]"
ORACLE = {
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.*, r.first_id IS NOT NULL AND k.doc_id <> r.first_id AS lost FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM j GROUP BY doc_id"""
}
