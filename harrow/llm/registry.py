"""Queries of this subpackage by name, with their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from harrow.llm import align, bpe, embeddings, html_text, langid, line_dedup, merkle, minhash, mixing, pii, quality, suffix_dedup, url_filter

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLE: dict = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}

for _module in (langid, line_dedup, suffix_dedup, url_filter, bpe, pii, mixing, quality, minhash, embeddings, align, html_text, merkle):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
