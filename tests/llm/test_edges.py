"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest

from bursar.llm import (byte_bpe, jaccard_join, language_id, language_model, mixing, multi_index, quality, sharding,
                        substring_dedup, toxicity)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_quality(odd, none, odd_rows):
    got = by_id(quality.quality_rules(odd))
    assert sum(map(len, got.values())) == len(odd_rows)
    assert [r.kept for r in got[1]] == [True, True] and got[None][0].doc_id is None
    for k in (3, 4, 5):
        assert got[k][0].n_words == 0 and got[k][0].base_failed and not got[k][0].kept
    assert got[8][0].n_words == 30_000
    assert quality.quality_rules(none).count() == 0


def test_language_id(odd, none, odd_rows):
    samples = language_id.labelled_sample(odd, modulus=None)
    got = by_id(language_id.identify(odd, samples).select("doc_id", "text", "lid_lang", "lid_score", "other_column"))
    assert sum(map(len, got.values())) == len(odd_rows)
    for k in (3, 4, 5, 10):
        assert (got[k][0].lid_lang, got[k][0].lid_score) == ("und", 0.0)
    assert {r.lid_lang for r in got[1]} <= {"en", "de"} and 0.5 <= got[8][0].lid_score <= 1
    assert language_id.identify(none, samples).count() == 0
    assert language_id.labelled_sample(none) == {}
    assert {r.lid_lang for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_language_model(odd, none, odd_rows):
    scored, stats = language_model.learn_and_score(odd)
    got = by_id(scored)
    assert sum(map(len, got.values())) == len(odd_rows)
    assert got[3][0].lm_tokens == got[4][0].lm_tokens == got[5][0].lm_tokens == 1
    assert got[8][0].lm_tokens == 30_001 and got[8][0].lm_score < 0
    assert got[1][0] == got[1][1]
    scored, stats = language_model.learn_and_score(none)
    assert scored.count() == 0 and stats.tokens == 0


def test_bpe(odd, none, odd_rows):
    coded = byte_bpe.encode_decode(odd, RANKS, byte_bpe.PATTERN, as_array=True)
    assert set(odd.columns) <= set(coded.columns)
    got = sorted((str(r.doc_id), r.bpe_text) for r in coded.collect())
    assert got == sorted((str(i), t or "") for i, t, *_ in odd_rows)
    assert byte_bpe.encode_decode(none, RANKS, byte_bpe.PATTERN).count() == 0


def test_jaccard(odd, none, odd_rows):
    got = by_id(jaccard_join.jaccard_join(odd))
    assert sum(map(len, got.values())) == len(odd_rows)
    assert [(r.n_links, r.class_id) for r in got[1]] == [(2, 1), (2, 1)] and got[2][0].class_id == 1
    assert (got[7][0].class_id, got[7][0].n_links, got[6][0].n_links) == (6, 1, 1)
    for k in (3, 4, 5):
        assert (got[k][0].class_id, got[k][0].n_links, got[k][0].n_shingles) == (k, 0, 0)
    assert jaccard_join.jaccard_join(none).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, None, 6, 8, 9, 10, 11]))


def test_sharding(odd, none, odd_rows):
    rows = sharding.shard_by_bytes(odd).collect()
    assert len(rows) == len(odd_rows)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1} and {r.text_crc32 for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_toxicity(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 0), (7, 0), (8, 0), (None, 1), (3, None), (99, 1)],
                                   "doc_id long, toxic int")
    sample, totals = toxicity.labelled_sample(odd, labels, modulus=None)
    model = toxicity.fit(sample, totals)
    got = by_id(toxicity.tag(odd, model).select("doc_id", "tox_score", "tox_spans", "other_column"))
    assert sum(map(len, got.values())) == len(odd_rows)
    assert got[3][0].tox_score == got[4][0].tox_score and got[3][0].tox_spans == []
    assert all(0 <= r.tox_score <= 1 for x in got.values() for r in x)
    assert toxicity.tag(none, model).count() == 0
    empty, totals = toxicity.labelled_sample(none, labels.limit(0))
    assert toxicity.fit(empty, totals) is None
    assert {r.tox_score for r in toxicity.tag(odd, None).collect()} == {0.0}


def test_substring_dedup(odd, none, odd_rows):
    got = by_id(substring_dedup.report(odd))
    assert sum(map(len, got.values())) == len(odd_rows)
    assert [r.repeated_words for r in got[1]] == [0, 0] and got[2][0].repeated_words == 80
    assert got[6][0].n_passages == 0 and got[7][0].repeated_words == 120
    assert got[3][0].n_words == 0 and got[8][0].repeated_words == 0
    cut = substring_dedup.without_repeats(odd)
    assert cut.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert (7, "extra") in texts and 2 not in {i for i, _ in texts} and (3, None) in texts
    assert {r.n_chars for r in cut.filter("doc_id = 7").collect()} == {5}
    assert substring_dedup.report(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0


def test_mixing(odd, none, odd_rows):
    rows = mixing.mixed(odd, block_rows=2).collect()
    assert sorted(r.mix_position for r in rows) == list(range(len(odd_rows)))
    ordered = mixing.in_mix_order(odd)
    assert ordered.columns == odd.columns and ordered.count() == len(odd_rows)
    assert {r.mix_stream for r in ordered.collect()} == {r.mix_stream for r in odd.collect()}
    assert mixing.mixed(none).count() == 0 and mixing.in_mix_order(none).count() == 0
    given = mixing.mixed(odd, weights={"a": 0.7, None: 0.1}, block_rows=1).collect()
    assert sorted(r.mix_position for r in given) == list(range(len(odd_rows)))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.95, 0.1, 0.0, 0.0]),
            (4, None), (5, [0.0, 0.0, 0.0, 0.0]), (6, [1.0, None, 0.0, 0.0]), (7, [float("nan"), 0.0, 0.0, 0.0]),
            (8, [float("inf"), 0.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, []), (None, [0.0, 1.0, 0.0, 0.0]), (11, [0.0, 0.0, 2.0, 0.1])]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")


def test_multi_index(vectors):
    got = {}
    for r in multi_index.near_duplicates(vectors).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[3] == [(3, 1, False)]
    for k in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[k] == [(0, k, True)]
    assert got[None] == [(0, None, True)]
    assert multi_index.near_duplicates(vectors.limit(0)).count() == 0
    assert multi_index.near_duplicates(vectors.filter("vec_id = 1")).collect()[0].n_links == 0
