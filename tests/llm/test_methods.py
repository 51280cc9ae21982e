"""Each method against a brute-force version, an exact round trip or known properties."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bursar.llm import (byte_bpe, common, jaccard_join, language_id, language_model, mixing, multi_index, quality,
                        queries, sharding, substring_dedup, toxicity)
from tests.llm.conftest import SF

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
words_text = st.lists(st.sampled_from(["a", "b", "c#", "dd", "\n", "é", " "]), max_size=60).map(" ".join)


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


# ---------------------------------------------------------------------------------------- quality rules

@given(words_text)
@settings(max_examples=200, deadline=None)
def test_text_counts(text):
    words = text.split(" ")
    words = [w for part in text.split() for w in [part]]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = [any(grams[tuple(words[k:k + 3])] > 1 for k in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words))]
    lines = [x for x in text.split("\n") if x.split()]
    assert quality.text_counts(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                                         len(lines) - len(set(lines)), sum(inside))


def test_sketch_quartiles(spark):
    rnd = random.Random(4)
    values = [int(rnd.lognormvariate(5, 2)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    cells = df.groupBy(quality.cell("v").alias("cell")).count().collect()
    assert sum(r["count"] for r in cells) == 3000
    for r in cells:
        assert any(r.cell <= v < r.cell * (1 + 1 / 64) + 1 for v in values)


def test_outliers_of_their_group_fail(spark, prose):
    rows = [(k, prose(k, 100), "en", "a") for k in range(300)] + [(1000, prose(7, 100).replace(" ", "##* "), "en", "a")]
    rows += [(2000 + k, prose(k, 100).replace(" ", "#* "), "en", "code") for k in range(300)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert sum(r.kept for r in got.values()) == 600  # symbols are usual in the other source


def test_quality_rules_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(queries.ORACLE["op1_quality_rules"])
    got = queries.op1_quality_rules(spark, SF)
    assert sorted(tuple(map(str, r)) for r in got.select(*rel.columns).collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())


# ------------------------------------------------------------------------------------------ language ID

@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), max_size=80))
@settings(max_examples=150, deadline=None)
def test_cross_parsing(sample, text):
    table = language_id.suffix_automaton(sample, 4)
    state, phrases = 0, 1
    for k, c in enumerate(text):
        step = int(table[state * 4 + c])
        phrases += (step & 1) if k else 0
        state = step >> 1
    inside = {tuple(sample[a:b]) for a in range(len(sample)) for b in range(a + 1, len(sample) + 1)}
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) + 1 and tuple(text[at:at + n]) in inside and at + n < len(text) and tuple(text[at:at + n + 1]) in inside:
            n += 1
        want, at = want + 1, at + n
    assert phrases == max(want, 1)


def test_parser_counts_blocks():
    parser = language_id.Parser({"x": ["abcabd " * 30], "y": ["zzyx " * 30]})
    texts = [language_id.normalised(t) for t in ("abcabd " * 100, "zzyx", "", "q" * 300)]
    got = parser.phrases(texts)
    for t, row in zip(texts, got):
        codes = parser.codes(t).tolist()
        for table, n in zip(parser.tables, row):
            want = 0
            for k in range(0, len(codes), language_id.BLOCK):
                state = 0
                for j, c in enumerate(codes[k:k + language_id.BLOCK]):
                    step = int(table[state * parser.letters + c])
                    want += 1 if j == 0 else step & 1
                    state = step >> 1
            assert n == want


def test_language_id_held_out(spark, documents):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    known = [(r.lang, got[r.doc_id].lang_pred) for r in documents.collect() if r.lang and remainder(r.doc_id, 3) == 1]
    assert all(got[i].held_out == (remainder(i, 3) == 1) for i in got)
    assert len(known) > 30 and np.mean([a == b for a, b in known]) > 0.97


# --------------------------------------------------------------------------------------- language model

def test_gradients():
    rng = np.random.default_rng(0)
    m = language_model
    w = {k: v.astype(np.float64) for k, v in m.initial(rng.random(m.WORDS) * 100, rng.random(m.RARE_CLASSES) * 50).items()}
    codes = rng.integers(0, m.WORDS + m.RARE_CLASSES, (6, 5)).astype(np.int32)
    real, fresh = np.ones((6, 5), bool), np.zeros((6, 5), bool)
    real[4:, 3], fresh[0], fresh[3, 1] = False, True, True
    start = np.zeros((5, m.HIDDEN))
    _, grads, _ = m.window_gradients(w, codes, real, fresh, start)
    for name in w:
        for _ in range(4):
            flat = grads[name].reshape(-1)
            at = int(rng.choice(np.flatnonzero(np.abs(flat) > 1e-4)))
            value, eps = w[name].reshape(-1)[at], 1e-4
            out = []
            for d in (eps, -eps):
                w[name].reshape(-1)[at] = value + d
                out.append(m.window_gradients(w, codes, real, fresh, start)[0])
            w[name].reshape(-1)[at] = value
            assert -(out[0] - out[1]) / 2 / eps == pytest.approx(flat[at], rel=0.05, abs=2e-3)


def test_probabilities_add_up_and_state_is_carried():
    m = language_model
    rng = np.random.default_rng(1)
    w = m.initial(rng.random(m.WORDS) * 9, rng.random(m.RARE_CLASSES) * 9)
    h = rng.standard_normal((1, m.HIDDEN)).astype(np.float32)
    every = np.arange(m.WORDS + m.RARE_CLASSES)
    logp, _, _ = m.output(w, np.repeat(h, len(every), 0), every, False)
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    text = rng.integers(0, m.WORDS + m.RARE_CLASSES, 300).astype(np.int32)
    other = rng.integers(0, m.WORDS, 20).astype(np.int32)
    h, want = np.zeros((1, m.HIDDEN), np.float32), 0.0
    for c in text:
        want += float(m.output(w, h, np.array([c]), False)[0][0])
        h, _ = m.gates(w["inputs"][[c]], w["state"], h)
    assert m.text_log_probabilities(w, [other, text])[1] == pytest.approx(want, rel=1e-4)


def test_language_model_query(spark, texts, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", 1500)  # the other words take the joined path
    got = {r.doc_id: r for r in queries.op3_language_model(spark, SF).collect()}
    words = {i: [w.lower() for w in (t or "").encode().split()] for i, t in texts.items()}
    count = Counter()
    for i, w in words.items():
        if remainder(i, 7) != 2:
            count.update([*w, None])
    total, distinct = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(w) + 1, total, remainder(i, 7) == 2)
        assert r.n_known == sum(count[x] > 0 for x in [*w, None])
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (total + distinct + 1)) for x in [*w, None]), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# --------------------------------------------------------------------------------------------- byte BPE

@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, byte_bpe.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeinrst 1.\n", max_size=200), st.text(alphabet="aé漢😀 ́", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_library(encoder, reference, text):
    packed = encoder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
    assert "".join(byte_bpe.decode_stream(packed, {r: t for t, r in RANKS.items()})) == text


def test_bpe_query(spark, texts, reference):
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    for r in queries.op4_byte_bpe(spark, SF).collect():
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_long_pieces_and_small_caches(encoder, reference, monkeypatch):
    text = "a" * 30_000 + " " + "=" * 5000 + "ab" * 9000 + "漢字" * 3000
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 20)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 10)
    small = byte_bpe.Encoder(RANKS, byte_bpe.PATTERN)
    for text in ("unbelievable reinterpretations " * 20, "zxqwvkjhgfdsapoiuytrewqlmnbvcxz" * 30):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_utf8_stream(data, cuts):
    stream, out, bounds = byte_bpe.Utf8Stream(), [], [0, *sorted(cuts), len(data)]
    for a, b in zip(bounds, bounds[1:]):
        out.append(stream.feed(data[a:b]))
        assert len(stream.open) <= 3
    out.append(stream.feed(b"", end=True))
    assert "".join(out) == data.decode("utf-8", "replace")


# ----------------------------------------------------------------------------------------- Jaccard join

def brute_links(sets: dict, threshold: float = 0.8):
    links, parent = Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common_items = len(sets[a] & sets[b])
        if common_items and common_items >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in sets}


def test_posterior():
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n in (10, 30):
        for m in range(n + 1):
            density = grid ** m * (1 - grid) ** (n - m)
            above = density[grid >= 0.8].sum() / density.sum()
            assert (m >= jaccard_join.least_matches(n, 0.8, 1e-3)) == (above >= 1e-3)


def test_jaccard_query(spark, texts):
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in texts.items()}
    want = brute_links(sets)
    assert any(n for n, _ in want.values())
    assert {r.doc_id: (r.n_links, r.class_id) for r in queries.op5_jaccard_join(spark, SF).collect()} == want


def test_large_group_of_near_copies_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BAND_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 16)
    base, rows = prose(5, 150).split(), []
    for k in range(90):
        own = list(base)
        own[k] = f"own{k}"
        if k % 3 == 0:
            own[149 - k % 7] = f"more{k}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    want = brute_links({i: set(jaccard_join.shingles(t).tolist()) for i, t in rows})
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        ca, cb = parent.setdefault(a, {a}), parent.setdefault(b, {b})
        if ca is not cb:
            ca |= cb
            for x in cb:
                parent[x] = ca
    assert got == {x: min(c) for x, c in parent.items() if len(c) > 1}


# ---------------------------------------------------------------------------------------------- sharding

def serial(groups: dict[str, int]) -> list[int]:
    heap = [(0, s) for s in range(8)]
    for _, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_sharding_equals_the_serial_schedule(spark, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    groups = Counter()
    for t in texts.values():
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    loads = Counter()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        loads[r.shard] += r.size
    assert sorted(loads.values()) == serial(groups)
    assert len({(texts[r.doc_id], r.shard) for r in rows}) == len(set(texts.values()))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_with_parcels(spark, documents):
    rows = sharding.shard_by_bytes(documents, head_groups=20, parcels=64).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert len(rows) == documents.count() and max(loads.values()) <= 1.1 * min(loads.values())


# ---------------------------------------------------------------------------------------------- toxicity

@given(st.lists(st.lists(st.floats(-4, 4), max_size=150), min_size=1, max_size=4), st.lists(st.floats(0.1, 5), min_size=4, max_size=4))
@settings(max_examples=60, deadline=None)
def test_marginals(docs, potentials):
    a = np.array(potentials).reshape(2, 2)
    got = toxicity.marginals(np.array([s for d in docs for s in d], float), np.array([len(d) for d in docs]), a)
    want = []
    for d in docs:
        phi = np.array([[1, np.exp(s)] for s in d]).reshape(-1, 2)
        alpha, prior = np.zeros((len(d), 2)), np.array([1.0, 0.0])
        for t in range(len(d)):
            prior = (prior @ a) * phi[t]
            prior /= prior.sum()
            alpha[t] = prior
        beta = np.ones(2)
        p = np.zeros(len(d))
        for t in range(len(d) - 1, -1, -1):
            both = alpha[t] * beta
            p[t] = both[1] / both.sum()
            beta = a @ (phi[t] * beta)
            beta /= beta.sum()
        want += p.tolist()
    assert got == pytest.approx(np.array(want), abs=1e-9)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = [(labels[i], got[i]) for i in labels if got[i].held_out]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    toxic, clean = [r.score for y, r in held if y], [r.score for y, r in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8
    assert np.mean([r.predicted for y, r in held if not y]) < 0.1
    for r in got.values():
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(texts[r.doc_id]) and texts[r.doc_id][s.start:s.end].split()


# --------------------------------------------------------------------------------------- substring dedup

@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
@settings(max_examples=200, deadline=None)
def test_chains(anchors):
    x, y = np.array([a for a, _ in anchors]), np.array([b for _, b in anchors])
    k, g = substring_dedup.SEED_WORDS, substring_dedup.GAP
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    out = substring_dedup.chains(x, y)
    assert sorted(i for c in out for i in c) == list(range(len(x)))
    for c in out:
        assert all(x[p] < x[q] and y[p] < y[q] for p, q in zip(c, c[1:]))
    # The largest score of any chain is at most what the exhaustive recursion finds.
    best = {}
    for i in order:
        best[i] = max([float(k)] + [best[j] + min(k, x[i] - x[j], y[i] - y[j]) - g * ((x[i] - x[j]) + (y[i] - y[j]) - 2 * min(k, x[i] - x[j], y[i] - y[j]))
                                    for j in best if x[j] < x[i] and y[j] < y[i]])

    def value(c):
        total = float(k)
        for p, q in zip(c, c[1:]):
            new = min(k, x[q] - x[p], y[q] - y[p])
            total += new - g * ((x[q] - x[p]) + (y[q] - y[p]) - 2 * new)
        return total

    assert max(map(value, out)) <= max(best.values()) + 1e-9
    if len(set(x)) == len(set(y)) == len(x) and all(abs(int(p) - int(q)) >= k for p, q in itertools.permutations(x, 2)) \
            and all(abs(int(p) - int(q)) >= k for p, q in itertools.permutations(y, 2)):
        assert max(map(value, out)) == pytest.approx(max(best.values()))


def test_exact_passages_are_all_found(spark, texts):
    first, cover = {}, {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        mark, new = np.zeros(len(words), bool), []
        for k in range(len(words) - 49):
            gram = tuple(words[k:k + 50])
            if first.get(gram, i) != i:
                mark[k:k + 50] = True
            else:
                new.append(gram)
        for gram in new:
            first.setdefault(gram, i)
        cover[i] = mark
    assert sum(m.sum() for m in cover.values()) > 300
    for r in queries.op8_substring_dedup(spark, SF).collect():
        mark = np.zeros(r.n_words, bool)
        for p in r.passages:
            mark[p.start:p.end] = True
            assert p.end - p.start >= 50 and p.ref_doc_id < r.doc_id and p.n_equal >= 0.8 * (p.end - p.start)
        assert not (cover[r.doc_id] & ~mark).any() and r.repeated_words == mark.sum()


def test_fuzzy_passage_and_fragments(spark, prose):
    passage = prose(50, 70).split()
    fuzzy = passage[:]
    for k in (15, 33, 34, 52):
        fuzzy[k] = f"new{k}"
    del fuzzy[60]
    docs = [(1, prose(61, 100) + " " + " ".join(passage[:35]) + " " + prose(62, 50)),  # half of it, first in the order
            (2, prose(63, 80) + " " + " ".join(passage) + " " + prose(64, 60)),
            (3, prose(65, 90) + " " + " ".join(fuzzy) + " " + prose(66, 40)),
            (4, prose(67, 30) + " " + " ".join(passage) + " " + prose(68, 30)), (5, prose(69, 300))]
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_passages == got[2].n_passages == got[5].n_passages == 0
    assert abs(got[3].repeated_words - 69) <= 3 and abs(got[4].repeated_words - 70) <= 3
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept[2] == docs[1][1] and len(kept[4].split()) in range(57, 64)


@pytest.mark.parametrize("changed, recall", [(2, 1), (5, 0.99), (8, 0.98), (10, 0.9)])
def test_planted_passages_with_changed_words(spark, changed, recall):
    rnd, rows = random.Random(changed), []
    own = lambda n: [f"w{rnd.getrandbits(60)}" for _ in range(n)]
    for k in range(100):
        passage = own(50)
        rows.append((k, " ".join(own(80) + passage + own(80))))
        for at in rnd.sample(range(1, 49), changed):
            passage[at] = own(1)[0]
        rows.append((1000 + k, " ".join(own(80) + passage + own(80))))
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_passages == 0 for k in range(100))
    found = [got[1000 + k] for k in range(100) if got[1000 + k].n_passages]
    for r in found:
        assert all(77 <= p.start and p.end <= 133 and p.ref_doc_id == r.doc_id - 1000 for p in r.passages)
        assert all(p.n_equal >= 0.8 * (p.end - p.start) for p in r.passages)
    assert len(found) >= 100 * recall


def test_passage_made_of_pieces_of_earlier_documents(spark, prose):
    own = lambda seed: prose(seed, 60)
    rows, rnd = [], random.Random(12)
    for k in range(10):
        passage = [f"w{rnd.getrandbits(60)}" for _ in range(70)]
        # Every seed of the passage occurs in one of the pieces, none of which is a passage.
        for j, text in enumerate([passage[:30], passage[20:50], passage[40:], passage, passage]):
            rows.append((10 * k + j, " ".join([own(1000 + 20 * k + j), *text, own(2000 + 20 * k + j)])))
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(10):
        assert all(got[10 * k + j].n_passages == 0 for j in range(4))
        assert {p.ref_doc_id for p in got[10 * k + 4].passages} == {10 * k + 3} and 70 <= got[10 * k + 4].repeated_words <= 73


def test_cut_out():
    assert substring_dedup.cut_out("a b\n c  d e", [(1, 3)]) == "a d e"
    assert substring_dedup.cut_out("a b c", [(0, 3)]) == "" and substring_dedup.cut_out(" a b c", [(2, 3), (1, 2)]) == " a "


# ------------------------------------------------------------------------------------------------ mixing

@given(st.lists(st.tuples(st.integers(1, 60), st.floats(0.05, 5)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_schedule_keeps_windows(streams):
    blocks, weights = [n for n, _ in streams], [w for _, w in streams]
    plan = mixing.schedule(blocks, weights, 64)
    assert plan["slots"] == sum(blocks)
    taken = {}
    ends = {}
    for p in plan["phases"]:
        assert p["from"] == ends.get(p["stream"], 0)
        ends[p["stream"]] = p["to"]
        for j in range(p["to"] - p["from"]):
            slot = p["start"] + j // p["share"] * 64 + int(p["places"][j % p["share"]])
            assert slot not in taken
            taken[slot] = p["stream"]
            assert p["start"] + j * 64 // p["share"] <= slot < p["start"] - (-(j + 1) * 64 // p["share"])
    assert sorted(taken) == list(range(sum(blocks))) and [ends[s] for s in range(len(blocks))] == blocks


def test_many_blocks_stay_within_a_block_of_the_true_weights():
    weights = np.array([0.2, 0.3, 0.1234567, 0.3765433])
    plan = mixing.schedule([100_000] * 4, weights.tolist())
    for p in plan["phases"][:4]:
        t = np.array([0, *(np.asarray(p["places"]) + 1)])
        assert p["to"] == len(p["places"]) and p["start"] == 0
        assert (abs(np.arange(len(t)) - t * weights[p["stream"]]) < 1 + 1e-3).all()
    assert plan["slots"] == 400_000


@pytest.mark.parametrize("weights", [None, {f"s{k:02}": (1 + k % 2) / 60 for k in range(40)}])
def test_sources_beyond_the_streams_keep_their_weights(spark, weights):
    rows = [(100 * k + j, f"s{k:02}") for k in range(40) for j in range(50)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_rows=2, max_streams=8).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.mix_position)]
    assert sorted(r.mix_position for r in got) == list(range(2000))
    first = Counter(order[:600])
    for k in range(40):
        want = 600 / 40 if weights is None else 600 * (1 + k % 2) / 60
        assert abs(first[f"s{k:02}"] - want) <= 4


def test_mix_stays_within_a_block(spark):
    rows = pd.DataFrame([r.asDict() for r in mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"),
                                                          block_rows=2).collect()]).sort_values("mix_position")
    assert rows["mix_position"].tolist() == list(range(len(rows)))
    assert ((rows["mix_release"] <= rows["mix_slot"]) & (rows["mix_slot"] < rows["mix_deadline"])).all()
    first_out = rows.groupby("mix_stream")["mix_slot"].max().min() + 1
    share = rows.groupby("source").size() ** 0.5
    share = share / share.sum()
    for t in range(1, int(first_out)):
        given_out = rows[rows["mix_slot"] < t].groupby("source")["mix_slot"].nunique().reindex(share.index, fill_value=0)
        assert (abs(given_out - t * share) < 1.01).all()


# -------------------------------------------------------------------------------------------- multi-index

def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    index = multi_index.Index(rng.standard_normal((7, 3)), rng.standard_normal((7, 3)))
    points = rng.standard_normal((20, 6))
    got = index.cells(points, 30)
    for p, cells in zip(points, got):
        d1, d2 = ((index.first - p[:3]) ** 2).sum(1), ((index.second - p[3:]) ** 2).sum(1)
        o1, o2 = np.argsort(d1), np.argsort(d2)
        heap, seen, want = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
        while len(want) < 30:
            _, a, b = heapq.heappop(heap)
            want.append(o1[a] * 7 + o2[b])
            for na, nb in ((a + 1, b), (a, b + 1)):
                if na < 7 and nb < 7 and (na, nb) not in seen:
                    seen.add((na, nb))
                    heapq.heappush(heap, (d1[o1[na]] + d2[o2[nb]], na, nb))
        assert cells.tolist() == want


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((120, 16))
    x = np.concatenate([centres, np.repeat(centres[:4], 60, 0) + rng.standard_normal((240, 16)) * 0.35, centres[:10]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    unit = multi_index.unit(x)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].component_id <= i for i in got) and all(got[360 + k].component_id == got[k].component_id for k in range(10))


def _pairs(rng, n, dim=16, cosine=0.92):
    """n vectors and a neighbour of each at the given cosine."""
    x = multi_index.unit(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = multi_index.unit(side - (side * x).sum(1, keepdims=True) * x)
    return x, cosine * x + (1 - cosine ** 2) ** 0.5 * side


def _found(spark, x):
    """Links found and true links of each vector, and one row of the result."""
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    unit = multi_index.unit(x)
    near = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    return np.array([got[i].n_links for i in range(len(x))]), near, got[0]


def test_a_large_group_does_not_hide_lost_links(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    rng = np.random.default_rng(8)
    group = rng.standard_normal((1, 16)) + rng.standard_normal((400, 16)) * 0.05
    links, near, _ = _found(spark, np.concatenate([*_pairs(rng, 150), group]))
    assert (near[300:] >= 399).all() and links[:300].sum() >= 0.97 * near[:300].sum()


@pytest.mark.parametrize("most", [16_000, 80])
def test_rare_neighbours_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(multi_index, "PER_CELL", 1)
    monkeypatch.setattr(multi_index, "QUERIES", 2)
    monkeypatch.setattr(multi_index, "MOST_QUERIES", most, raising=False)
    rng = np.random.default_rng(9)
    links, near, row = _found(spark, np.concatenate([*_pairs(rng, 30, 16, 0.902), rng.standard_normal((1500, 16))]))
    assert near.sum() == 60 and (links == near).all() and row.measured_recall == 1
