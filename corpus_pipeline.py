"""Corpus pipeline: the stages over documents, each written and read again before the next."""

from __future__ import annotations

import re
import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bursar.llm import byte_bpe, jaccard_join, language_id, mixing, substring_dedup
from bursar.llm.common import aside, read
from bursar.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: no letter, or hardly a phrase of any of them.

    Learns from the labelled rows of its own input; without any, everything is kept.
    """
    samples = language_id.labelled_sample(docs, modulus=None)
    if not samples:
        return docs
    base, back = aside(docs, lambda c: c.startswith("lid_"))
    found = language_id.identify(base, samples)
    return back(found.filter((F.col("lid_lang") != language_id.UNKNOWN)
                             & (F.col("lid_rate") <= language_id.MAX_PHRASE_RATE)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of the text (n_chars follows)."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix."""
    return mixing.in_mix_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit), and digests of the ids and
    of the bytes they decode to, and mix_position: the row's place in the order of the files read."""
    coded = byte_bpe.encode_decode(in_file_order(spark, docs.select("doc_id", "lang", "source", "text"), docs),
                                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.col("bpe_count").alias("n_tokens"),
                        F.col("bpe_ids").alias("token_ids"), F.sha2("bpe_ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"), "mix_position")


def in_file_order(spark: SparkSession, out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out``, columns of ``docs``, with mix_position: part number by part number, row by row of the files.

    Readers take files in any order, so the order in which a stage wrote its rows is only in their names and
    row numbers. The driver holds a count for each file. Null where ``docs`` does not come from files.
    """
    try:
        placed = docs.select(*out.columns, F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        return out.withColumn("mix_position", F.lit(None).cast("long"))
    files = docs.select(F.col("_metadata.file_path").alias("mix_file")).groupBy("mix_file").count().collect()
    part = lambda path: (int(m[1]) if (m := re.search(r"part-(\d+)[^/]*$", path)) else -1, path)
    files.sort(key=lambda r: part(r.mix_file))
    offsets, before = [], 0
    for r in files:
        offsets.append((r.mix_file, before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "mix_file string, mix_offset long")
    return (placed.join(F.broadcast(starts), "mix_file")
            .withColumn("mix_position", F.col("mix_offset") + F.col("mix_row")).select(*out.columns, "mix_position"))


STAGES = [("language_id", identify_language), ("near_copies", drop_near_copies), ("repeats", cut_repeats),
          ("mixing", mix_sources), ("byte_bpe", tokenize)]

#: SQL cannot express suffix automata, MinHash posteriors, chaining or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
