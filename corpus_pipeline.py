"""A corpus from documents to tokens: language ID, line dedup, near-dedup, mixing, BPE.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the last return the
columns of documents; n_chars follows the text. SQL can express neither the first stage nor the last, so that ORACLE_SQL is
None; tests hold run() against the same steps done by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, langid, line_dedup, minhash, mixing
from harrow.llm.shared import documents, text_or_empty, written

#: A document goes if it has no letters, or if less than half of its letters are in spans of known languages, of one or of several.
LEAST_KNOWN = 0.5


def beside(docs: DataFrame, used: list[str], operator) -> DataFrame:
    """What operator makes of docs, whose other columns keep their names and values whatever the operator adds: they pass through it under names of their own."""
    own = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c not in used}
    out = operator(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages; a missing lang becomes the most frequent language found. With no labelled row to learn from, all with letters stay."""
    model = langid.learn(langid.labelled_rows(docs))
    known = F.col("text").rlike(r"\p{L}") if model is None else (F.col("lang_pred") != langid.UND) & (F.col("known") >= LEAST_KNOWN)

    def operator(own: DataFrame) -> DataFrame:
        return langid.label(own, model).where(known).withColumn("lang", F.coalesce("lang", "lang_pred"))

    return beside(docs, ["doc_id", "text", "lang"], operator)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has are gone."""
    out = beside(docs, ["doc_id", "text"], line_dedup.drop_lines)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words and a similarity of 0.8."""
    return beside(docs, ["doc_id", "text"], minhash.dedup)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares of tokens."""
    return beside(docs, ["doc_id", "text", "lang", "source"], mixing.mix)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded)."""
    path = bpe.default_path()
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", text_or_empty().alias("text")), path).drop("text")
    return bpe.decode(encoded, path).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("mixing", mixture), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
