"""The registered queries over the operators of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bursar.llm import byte_bpe, collocations, jaccard_join, language_id, language_model, mixing, multi_index, packing, prefix_trie, quality, sharding, substring_dedup, toxicity
from bursar.llm.common import id_remainder, read
from bursar.llm.oracle import PHRASE_COLLOCATIONS, PREFIX_TRIE, QUALITY_RULES

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    samples = language_id.labelled_sample(documents, modulus=3, held_out=1)
    found = language_id.identify(documents.select("doc_id", "text"), samples)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"),
                        F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"),
                        F.col("lid_rate").alias("phrase_rate"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, stats = language_model.learn_and_score(read(spark, sf_dir, "documents"), modulus=7, held_out=2)
    return scored.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"),
                         F.col("lm_tokens").alias("n_tokens"), F.col("lm_known").alias("n_known"),
                         F.lit(stats.tokens).cast("long").alias("train_tokens"), F.col("lm_base").alias("base_score"),
                         F.col("lm_score").alias("score"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_decode(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                   public_tokenizers.PATTERN)
    return coded.select("doc_id", F.col("bpe_count").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents")).drop("text_hash", "class_key")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    sample, totals = toxicity.labelled_sample(documents, read(spark, sf_dir, "labels"), modulus=4, held_out=2)
    tagged = toxicity.tag(documents.select("doc_id", "text"), toxicity.fit(sample, totals))
    return tagged.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"),
                         F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.col("tox_spans").alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "padded")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_language_id, op3_language_model, op4_byte_bpe, op5_jaccard_join, op6_sharding,
    op7_toxicity, op8_substring_dedup, op9_mixing, op10_multi_index, op11_collocations, op12_packing, op13_prefix_trie)}

#: DuckDB SQL by query, where SQL can express it.
ORACLE: dict[str, str] = {"op1_quality_rules": QUALITY_RULES, "op11_collocations": PHRASE_COLLOCATIONS,
                          "op13_prefix_trie": PREFIX_TRIE}
