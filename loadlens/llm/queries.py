"""The text operators over the given tables, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    langid,
    line_quality,
    mixing,
    pii,
    sharding,
    simhash,
    token_counts,
    token_planes,
    toxicity,
    turn_repair,
)
from loadlens.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
#: Share of documents, as a remainder of crc32, kept out of language training.
LANGUAGE_FOLDS = 5
#: Documents with this remainder are kept out of toxicity training.
TOXICITY_FOLDS, HELD_OUT = 4, 2
#: A document counts as toxic from this score on.
TOXIC_FROM = 0.3
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of a shard: small, so that the check tables have many.
SHARD_LIMIT = 1 << 20


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def language_model(documents: DataFrame) -> langid.LanguageModel:
    """Trained on the documents that are not held out."""
    return langid.fit(documents.where(fold("doc_id", LANGUAGE_FOLDS) != 0))


@query("op1_extendible_shards", sharding.SQL.format(limit=SHARD_LIMIT))
def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


@query("op2_trie_token_counts")
def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path(VOCABULARY)
    counted = token_counts.count_tokens(docs, vocabulary, public_tokenizers.PATTERN)
    return counted.select("doc_id", "_tokens.n_pretokens", "_tokens.n_tokens")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", TOXICITY_FOLDS) == HELD_OUT
    model = toxicity.fit(docs, labels.where(~held_out))
    score = toxicity.toxicity_of(model, F.col("text"))
    scored = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = (fold("doc_id", LANGUAGE_FOLDS) == 0).alias("held_out")
    return found.select("doc_id", held_out, "_language.lang_pred", "_language.score")


@query("op5_pareto_mix", mixing.SQL)
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", *[f"_mix.{c}" for c in ("size", "source_size", "target", "taken")])


@query("op6_decontaminate", decontaminate.SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_table(pii.sanitised(table(spark, sf_dir, "documents")))


@query("op8_exact_dedup", exact_dedup.SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("fp")


@query("op10_token_planes")
def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = token_planes.write_tokens(docs, public_tokenizers.path(TOKENIZER))
    return token_planes.digest(written.documents())


@query("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.damaged(conversations), every=conversations)


@query("op12_line_quality", line_quality.SQL)
def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = line_quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", f"{found}.*")


@query("op13_conversation_trie")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.with_shared_starts(turns))
