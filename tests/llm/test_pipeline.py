"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from bursar.llm import byte_bpe, jaccard_join, mixing, substring_dedup
from tests.llm.conftest import SF
from tests.llm.test_methods import brute_links


def test_pipeline(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "repeats", "mixing", "byte_bpe"]
    docs, after = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas()) if name != "byte_bpe" else stage(spark, docs, SF)
        after[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == documents.columns
    lettered = {r.doc_id: r.text for r in documents.collect() if r.text and any(map(str.isalpha, r.text))}
    assert set(after["language_id"]) == set(lettered)
    classes = brute_links({i: set(jaccard_join.shingles(t).tolist()) for i, t in lettered.items()})
    assert set(after["near_copies"]) == {i for i, (_, c) in classes.items() if c == i}
    # No run of 50 words is left in two documents, and only words that repeat an earlier document went.
    first = {}
    for i in sorted(after["repeats"]):
        words = after["repeats"][i].text.encode().split()
        for gram in {tuple(words[k:k + 50]) for k in range(len(words) - 49)}:
            assert first.setdefault(gram, i) == i
    for i, r in after["repeats"].items():
        assert r.n_chars == len(r.text) if r.text != lettered[i] else r.n_chars == after["near_copies"][i].n_chars
    report = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(list(after["near_copies"].values()), documents.schema)).collect()}
    assert {i for i, r in report.items() if r.repeated_words < r.n_words} == set(after["repeats"])
    assert {i: r.text for i, r in after["mixing"].items()} == {i: r.text for i, r in after["repeats"].items()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert set(after["byte_bpe"]) == set(after["mixing"])
    for i, r in after["byte_bpe"].items():
        ids = np.array(library.encode_ordinary(after["mixing"][i].text), "<u4")
        assert (r.n_tokens, bytes(r.token_ids)) == (len(ids), ids.tobytes())
        assert r.decoded_sha256 == hashlib.sha256(after["mixing"][i].text.encode()).hexdigest()


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns[:4] == ["doc_id", "lang", "source", "n_tokens"]


def test_the_mix_reaches_the_result(spark, documents, tmp_path):
    docs = documents.select("doc_id", "lang", "source", "text")
    corpus_pipeline.mix_sources(spark, docs, SF).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    want = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert sorted(r.mix_position for r in got) == list(range(documents.count()))
    for r in got:
        assert r.mix_position == want[r.doc_id].mix_position
        assert want[r.doc_id].mix_release <= want[r.doc_id].mix_slot < want[r.doc_id].mix_deadline
