"""From raw documents to token files: five stages over the whole table.

Each stage takes what the one before kept.  All but the last return the columns of
``documents``; the last writes the token files and returns their documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import decontaminate, langid, mixing, near_copies, token_planes
from loadlens.llm.common import stored, table
from loadlens.llm.queries import TOKENIZER, language_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    return langid.keep_identified(docs, language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of texts at a similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its share."""
    return mixing.repeat(mixing.mix(docs))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; one row per document read back from them."""
    return token_planes.digest(token_planes.write_tokens(docs, public_tokenizers.path(TOKENIZER)).documents())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: Tokenisation and trained models cannot be said in SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
