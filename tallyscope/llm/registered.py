"""Imports every query module of this folder and the pipeline, which fills the catalogue."""

import corpus_pipeline
from tallyscope.llm import (  # noqa: F401
    decontaminate,
    embedding_dedup,
    extraction,
    hard_negatives,
    jaccard_join,
    language,
    mixing,
    private_data,
    sharding,
    spelling,
    tokens,
    warc,
)
from tallyscope.llm.common import CHECKS, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["CHECKS", "QUERIES"]
