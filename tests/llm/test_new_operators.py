"""Collocations, packing and the prefix trie against brute-force versions and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bursar.llm import collocations, packing, prefix_trie, queries, word_codes
from tests.llm.conftest import SF


# ------------------------------------------------------------------------------------ collocations

def brute_collocations(rows, min_count, top):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, straight from the definition."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in phrases.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in phrases.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def found_in(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("shards,cells", [(1, 1 << 12), (3, 1 << 12), (2, 8)])
def test_collocations_equal_brute_force(spark, shards, cells):
    """Also with one shard, and with so few cells that everything counts as reached from the first step on."""
    rnd = np.random.default_rng(4)
    words = ["of", "the", "a", "New", "york", "city", "é", "zz"]
    rows = [(" ".join(rnd.choice(words, size=int(rnd.integers(1, 40)), p=[.2, .2, .15, .1, .1, .1, .1, .05])).replace("zz", ", x.\t"),
             rnd.choice(["en", "de", None])) for _ in range(400)]
    rows += [("city of the new york city", "en")] * 40 + [(None, "en"), ("", None), (" \t\n", "de")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = found_in(collocations.collocations(df, min_count=20, top=25, shards=shards, cells=cells))
    want = brute_collocations(rows, 20, 25)
    assert len(want) > 40 and {r[0] for r in want} == {"en", "de", "und"}
    assert got == want


def test_collocations_of_odd_rows(spark, odd, odd_rows, none):
    rows = [(r[1], r[2]) for r in odd_rows]
    assert found_in(collocations.collocations(odd, min_count=2)) == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(none).count() == 0


def test_chunks_cut_only_between_pieces():
    text = "alpha beta gamma. " * 50 + "x" * 900 + " y, z"
    whole = re.findall(r"[^\x20\x09.,]+", text)
    for limit in (7, 64, 1000, 10 ** 6):
        words = []
        for chunk in word_codes.chunks([text, None, "", "END of"], limit):
            codes, _, starts, ends, lower = word_codes.words_of(chunk)
            assert (codes != 0).all()
            words += [lower[a:b].decode() for a, b in zip(starts, ends)]
        assert words == [w.lower() for w in whole] + ["end", "of"]


# ----------------------------------------------------------------------------------------- packing

def check_packing(pieces, sizes, losses, limits):
    """(example, start, length, loss, sequence, offset, padded): each token once, all limits, gapless offsets."""
    by_example, by_sequence = defaultdict(list), defaultdict(list)
    for k, start, length, loss, sequence, offset, padded in pieces:
        assert length > 0
        by_example[k].append((start, length, loss))
        by_sequence[sequence].append((offset, length, loss, padded))
    for k, size in enumerate(sizes):
        at = 0
        for start, length, loss in sorted(by_example[k]):
            assert start == at and loss == max(0, start + length - max(start, size - losses[k]))
            at += length
        assert at == size
    for parts in by_sequence.values():
        at, total = 0, sum(p[1] for p in parts)
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert total <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]
        assert {p[3] for p in parts} == {total if total & (total - 1) == 0 else limits[0]}
    return by_sequence


@given(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70)), max_size=40),
       st.sampled_from([(32, 4, 32), (32, 3, 9), (16, 1, 16), (64, 50, 5)]), st.integers(1, 200))
@settings(max_examples=150, deadline=None)
def test_packer_keeps_all_limits(examples, limits, lot):
    sizes = np.array([a for a, _ in examples], np.int64)
    losses = np.array([min(a, b) for a, b in examples], np.int64)
    packer, order, pieces, held = packing.Packer(limits), [], [], []
    for k in range(0, len(sizes), 7):
        packer.add(sizes[k:k + 7], losses[k:k + 7])
        held += range(k, min(k + 7, len(sizes)))
        if sizes[:k + 7].sum() % lot == 0 or k + 7 >= len(sizes):
            packer.fill(k + 7 >= len(sizes))
            done, found = packer.take_done()
            placed = [e for e, d in zip(held, done) if d]
            held = [e for e, d in zip(held, done) if not d]
            pieces += [(e, *p) for e, ps in zip(placed, found) for p in ps]
    assert not held
    check_packing(pieces, sizes, losses, limits)


def test_pack_instruction_data(spark):
    """Conversations as examples: the assistant's turns bear the loss; all three limits bind somewhere."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    examples = turns.selectExpr("conv_id * 100 + turn as id", "cast(length(text) as int) as tokens", "if(role = 'assistant', cast(length(text) / 2 as int), 0) as loss",
                                "'x' as packed_pieces").repartition(3)
    rows = examples.collect()
    out = packing.pack(examples, (2048, 6, 500), "tokens", "loss", lot_tokens=20_000)
    assert out.columns[:4] == ["id", "tokens", "loss", "packed_pieces"]
    got = {r[0]: r for r in out.toDF("id", "tokens", "loss", "clash", "pieces").collect()}
    assert len(got) == len(rows) and {r.clash for r in got.values()} == {"x"}
    ids = {r.id: k for k, r in enumerate(rows)}
    sequences = check_packing([(ids[i], *p) for i, r in got.items() for p in r.pieces], [r.tokens for r in rows], [r.loss for r in rows], (2048, 6, 500))
    used = [(sum(p[1] for p in s), len(s), sum(p[2] for p in s), s[0][3]) for s in sequences.values()]
    assert any(n == 6 for _, n, _, _ in used) and any(loss == 500 for _, _, loss, _ in used)
    assert sum(t for t, *_ in used) >= 0.99 * sum(p for *_, p in used)


def brute_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packed_documents(rows, docs):
    ids = {}
    for (doc_id, _), found in zip(docs, brute_ids([t for _, t in docs])):
        ids.setdefault(doc_id, []).append(np.array(found, "<u4"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert pieces.keys() == ids.keys()
    for doc_id, copies in ids.items():
        want = Counter()
        for a in copies:
            mine = sorted({p for p in pieces[doc_id] if p[3] == len(a)})
            want[len(a)] += len(a)
            for start, length, crc, _ in mine:
                assert zlib.crc32(a[start:start + length].tobytes()) == crc
        got = Counter()
        for start, length, _, total in pieces[doc_id]:
            got[total] += length
        assert got == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.padded))
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and parts[0][2] == (at if at & (at - 1) == 0 else 2048)
    return sum(r.length for r in rows) / sum(p[0][2] for p in by_sequence.values())


def test_packing_query(spark, documents, texts):
    rows = queries.op12_packing(spark, SF).collect()
    assert check_packed_documents(rows, list(texts.items())) > 0.99


def test_packing_of_odd_rows(spark, odd, odd_rows, none):
    rows = packing.packed_documents(odd, public_tokenizers.path("word_bpe_49k.json")).selectExpr("*", "crc32(ids) as ids_crc32").collect()
    check_packed_documents(rows, [(r[0], r[1]) for r in odd_rows])
    assert packing.packed_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@given(st.text(alphabet=st.sampled_from(list("aZ's'tré1２ \t\n\x0b\x0c\x1c\x85  ́　日😀<|>.,-ẛſİΣς")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_are_tokenized_as_whole_texts(text):
    words = packing.built(("packing", "test"), lambda: packing.Words(public_tokenizers.path("word_bpe_49k.json")))
    assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------------------------- prefix trie

def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows as the contract says, from a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        parts = [below(q) for q in children[p]]
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        return sum(x for x, _ in parts) or 1, saved + sum(s for _, s in parts)

    out = []
    for p, m in members.items():
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def bushy():
    """Shared prefixes of all lengths, nested truncations of one long conversation, exact copies, odd rows."""
    rnd = np.random.default_rng(8)
    rows = []
    for c in range(60):
        rows += [(c, k, "user" if k % 2 == 0 else None, f"t{k}-{rnd.integers(0, 2)}" if rnd.random() < .9 else None) for k in range(int(rnd.integers(0, 9)))]
    long = [(f"r{k % 3}", f"long {k} é") for k in range(45)]
    for i, c in enumerate(range(100, 200, 5)):  # their own bases: rebuilt as they are
        rows += [(c, k, r, t) for k, (r, t) in enumerate(long[:45 - 2 * i])]
    for c in range(300, 340, 5):
        rows += [(c, k, "user", f"copy {k}") for k in range(4)]
    return rows + [(None, 0, "user", "lost"), (400, None, "b", "x"), (400, None, "a", "y"), (400, 1, None, None), (400, 1, None, None), (401, 0, "a", "")]


@pytest.mark.parametrize("group_turns", [prefix_trie.GROUP_TURNS, 200, 1])
def test_trie_equals_brute_force(spark, group_turns):
    """Whole in one task, in stretches of levels, and level by level."""
    rows = bushy()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert nodes_of(prefix_trie.prefix_trie(df, group_turns)) == brute_trie(rows)


def test_ends_are_hashed_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = [(c, 0, "u", "same") for c in range(0, 2500, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes_of(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_trie_of_an_empty_table_and_clashing_columns(spark):
    rows = bushy()[:80]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, keys string, depth string, n_convs string")
    assert nodes_of(prefix_trie.prefix_trie(df)) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------ multi-index, rare neighbours

def test_rare_neighbours_of_a_large_table_without_all_pairs(spark):
    """50,000 vectors, 20 linked pairs: all found, by visiting few of the cells."""
    from bursar.llm import multi_index
    rng = np.random.default_rng(12)
    n, dim = 50_000, 16
    x = multi_index.unit(rng.standard_normal((n, dim)))
    x[n - 20:] = multi_index.made_neighbours(x[:20], 0.93)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    unit = multi_index.unit(x)
    want = {(i, n - 20 + i) for i in range(20)}
    for k in range(0, n, 2000):
        a, b = np.nonzero(unit[k:k + 2000] @ unit.T >= 0.9)
        want |= {(int(i), int(j)) for i, j in zip(a + k, b) if i < j}
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).filter("n_links > 0 or vec_id = 5").collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * 2 * len(want)
    assert all(got[n - 20 + i].component_id == i for i in range(20) if (i, n - 20 + i) in want and i in got) and len(got) >= 38
    visits = got[5].visited_cells
    assert 1 < visits * multi_index.PER_CELL < n / 4 and got[5].measured_recall >= 0.99


def test_probers_travel_with_one_cell(spark, monkeypatch):
    """Rows that meet: members with all the cells that they visit, probers, one for each visited cell, with their own alone."""
    from bursar.llm import multi_index
    monkeypatch.setattr(multi_index, "BLOCK", 3)
    visited = [[k % 4, (k + 1) % 4, (k + 2) % 4] for k in range(20)]
    df = spark.createDataFrame([(k, 1, b"x", c) for k, c in enumerate(visited)], "node long, rows long, raw binary, cells array<long>")
    rows = multi_index.meetings(df).collect()
    pairs = Counter((p.node, q.node) for p in rows if not p.member for q in rows if q.member and (p.cell, p.m, p.p) == (q.cell, q.m, q.p))
    assert pairs == Counter((i, j) for i in range(20) for j in range(20) if visited[j][0] in visited[i])
    assert all(r.cells == (visited[r.node] if r.member else visited[r.node][:1]) for r in rows)


# ---------------------------------------------------------------------------- substring dedup, single anchors

def test_repeats_leave_no_finished_work_on_disk(spark, tmp_path, monkeypatch):
    """Seeds that are linked and chains that are aligned make room for what follows; low bytes are never kept."""
    from bursar.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "scratch", lambda _, name: str(tmp_path / name))
    passage = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, f"a{k} b{k} {passage} c{k}") for k in range(5)], "doc_id long, text string")
    _, passages = substring_dedup.repeated_passages(df)
    assert passages.count() == 4
    kept = {p.name: spark.read.parquet(str(p)).columns for p in (tmp_path / "repeats").iterdir()}
    assert "low" not in kept["words"] and not any("bucket" in c for c in kept.values())
    assert kept["chains"] == passages.columns


def test_phrases_travel_with_each_word_once():
    """A block of phrases holds each distinct code once: far less than 8 bytes a word, and the same phrases."""
    from bursar.llm import collocations
    rng = np.random.default_rng(5)
    for words, n, k in ((300, 5000, 4), (70_000, 90_000, 2), (3, 1, 1)):
        codes = rng.integers(1, 1 << 63, words).astype(np.uint64)[np.minimum(rng.zipf(1.3, (n, k)) - 1, words - 1)]
        codes = codes[np.lexsort(codes.T[::-1])]
        codes, hashes, since, f = collocations.summed(codes, collocations.phrase_hashes(codes, "x"), np.zeros(n, np.uint8), np.arange(1, n + 1) * 1000)
        blocks = list(collocations._blocks(collocations.STATE, "x", codes, hashes, since, f, 1))
        got = [collocations._unpacked(k, *b[4:]) for b in blocks]
        assert sorted(zip(map(tuple, got[0][0].tolist()), got[0][2].tolist())) == sorted(zip(map(tuple, codes.tolist()), f.tolist()))
        assert words != 300 or len(blocks[0][4]) < codes.nbytes / 3


def test_frequent_words_travel_as_numbers(spark, monkeypatch):
    """Codes that all tasks know take a fraction of their bytes; what is known changes no result."""
    rng = np.random.default_rng(8)
    head = np.unique(rng.integers(1, 1 << 63, 20_000).astype(np.uint64))
    codes = np.concatenate([rng.choice(head, (3000, 2)), rng.integers(1, 1 << 63, (30, 2)).astype(np.uint64)])
    raw = collocations.packed(codes, head)
    assert (collocations.unpacked(2, raw, head) == codes).all() and len(raw) < len(collocations.packed(codes)) / 2
    assert (collocations.unpacked(2, collocations.packed(codes[:0], head), head) == codes[:0]).all()
    texts = [(" ".join(rng.choice(list("abcdefgh"), 30)) + ", " + " ".join(rng.choice(list("stuvw"), 9)), rng.choice(["en", "de"])) for _ in range(60)]
    df, chosen, found = spark.createDataFrame([(t, str(x)) for t, x in texts], "text string, lang string").repartition(3), collocations.head_words, []
    for most in (0, 3, 1000):
        monkeypatch.setattr(collocations, "head_words", lambda merged, most=most: found.append(chosen(merged, most)) or found[-1])
        got = [tuple(r) for r in collocations.collocations(df, min_count=5, top=40).collect()]
        assert sorted(got) == sorted(brute_collocations(texts, 5, 40)) and len(got) > 20
    assert [len(x) <= most for x, most in zip(found, (0, 3, 1000))] == [True] * 3 and len(found[2]) == 13


def test_net_learns_and_scores_alike_in_any_lanes(spark):
    """Windows without padding take shorter ways: gradients are those of the same window with a padded lane beside it."""
    from bursar.llm import language_model as lm
    rng = np.random.default_rng(6)
    w = lm.initial(rng.integers(1, 50, lm.WORDS).astype(float), rng.integers(1, 50, lm.RARE_CLASSES).astype(float))
    codes = rng.integers(0, lm.WORDS + lm.RARE_CLASSES, (lm.WINDOW, 5)).astype(np.int32)
    fresh = np.zeros(codes.shape, bool)
    fresh[0], fresh[7, 2] = True, True
    real, h = np.ones(codes.shape, bool), np.zeros((5, lm.HIDDEN), np.float32)
    wide = lambda x, fill: np.concatenate([x, np.full((len(x), 1), fill, x.dtype)], axis=1)
    logp, grads, state = lm.window_gradients(w, codes, real, fresh, h)
    other, more, _ = lm.window_gradients(w, wide(codes, 3), wide(real, False), wide(fresh, False), np.zeros((6, lm.HIDDEN), np.float32))
    assert abs(logp - other) < 1e-3 and all(np.allclose(grads[k], more[k], atol=1e-4) for k in grads)
    short, texts = codes[:0, 0], [codes[:, k] for k in range(5)]
    alone = [lm.text_log_probabilities(w, [t])[0] for t in texts]
    assert np.allclose(lm.text_log_probabilities(w, [*texts, short]), [*alone, 0], atol=1e-3)


def test_small_batches_are_scored_together_in_blocks():
    """Arrow batches are scored side by side up to a number of characters; rows of any block have the same output."""
    import pandas as pd
    from bursar.llm import language_model as lm
    parts = [pd.DataFrame({"text": ["ab", None]}), pd.DataFrame({"text": [None, None]}), pd.DataFrame({"text": ["x" * 9]}),
             pd.DataFrame({"text": ["abc", ""]}), pd.DataFrame({"text": ["y"]})]
    each = lm.TEXT_CHARS
    for chars, sizes in ((8 * each + 15, [8]), (8 * each + 14, [7, 1]), (5 * each + 11, [5, 3]), (3 * each + 8, [2, 2, 1, 3]), (0, [2, 2, 1, 2, 1])):
        got = list(lm.gathered(iter(parts), "text", chars))
        assert [sum(map(len, held)) for held in got] == sizes and [id(p) for held in got for p in held] == [id(p) for p in parts]
    assert list(lm.gathered(iter([]), "text", 5)) == []
    for word in ("a", "the", "é", "né", "éa", "aé1", "日本", "😀x", "\x00", "x\ud800"):
        last = word[-2:].encode("utf-8", "surrogatepass")
        assert lm.rare_class(word.encode("utf-8", "surrogatepass")) == lm.zlib.crc32(last) % lm.RARE_CLASSES
    rng = np.random.default_rng(8)
    w = lm.initial(rng.integers(1, 50, lm.WORDS).astype(float), rng.integers(1, 50, lm.RARE_CLASSES).astype(float))
    n = lm.OUTPUT_BLOCK + 77
    h, code = rng.standard_normal((n, lm.HIDDEN)).astype(np.float32), rng.integers(0, lm.WORDS + lm.RARE_CLASSES, n).astype(np.int32)
    for learn in (False, True):
        logp, _, dh = lm.output(w, h, code, learn)
        for a, b in ((0, 50), (lm.OUTPUT_BLOCK - 20, n)):
            alone, _, back = lm.output(w, h[a:b], code[a:b], learn)
            assert np.allclose(logp[a:b], alone, atol=1e-4) and (not learn or np.allclose(dh[a:b], back, atol=1e-5))


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_single_anchors_that_lead_to_a_passage_are_kept(data):
    """Whatever the alignment accepts around one anchor, the look at the low bytes lets through."""
    from bursar.llm import substring_dedup as sd
    rnd = np.random.default_rng(data.draw(st.integers(0, 10 ** 6)))
    n, at = 140, 60
    y = rnd.integers(0, 2 ** 32, n, dtype=np.uint32)
    x = y.copy()
    changed = rnd.choice(n, data.draw(st.integers(0, 60)), replace=False)
    x[changed] = rnd.integers(0, 2 ** 32, len(changed), dtype=np.uint32)
    shift = data.draw(st.integers(-3, 3))  # words put in or left out somewhere
    cut = int(rnd.integers(70, 130))
    x = np.concatenate([x[:cut], rnd.integers(0, 2 ** 32, shift, dtype=np.uint32), x[cut:]]) if shift > 0 else np.delete(x, range(cut, cut - shift))
    x[at:at + sd.SEED_WORDS] = y[at:at + sd.SEED_WORDS]
    found = [p for p in sd.passages_of(x, y, np.array([at]), np.array([at])) if p[0] <= at and at + sd.SEED_WORDS <= p[1] and p[1] - p[0] <= 55]
    w = sd.MIN_WORDS
    crop = lambda a, fill: np.pad(a.astype(np.uint8), (w, w + 50), constant_values=fill)[at:at + 2 * w + sd.SEED_WORDS]
    if found:
        assert sd.alike_nearby(crop(x, 0)[None], crop(y, 1)[None], sd.MIN_WORDS, sd.MIN_EQUAL)[0]


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_many_alignments_are_those_of_each_chain(data):
    """Chains that are aligned side by side give the passages that each gives by itself, in any order of rows."""
    from bursar.llm import substring_dedup as sd
    rnd = np.random.default_rng(data.draw(st.integers(0, 10 ** 6)))
    rows, expected = [], []
    for k in range(12):
        y = rnd.integers(0, data.draw(st.sampled_from((3, 2 ** 32))), rnd.integers(10, 300), dtype=np.uint32)
        x = np.where(rnd.random(len(y)) < rnd.choice((0.0, 0.1, 0.3)), rnd.integers(0, 2 ** 32, len(y), dtype=np.uint32), y)
        cut = int(rnd.integers(0, len(x)))
        x = np.concatenate([x[:cut], rnd.integers(0, 2 ** 32, rnd.integers(0, 6), dtype=np.uint32), x[cut + int(rnd.integers(0, 6)):]])
        n = sd.SEED_WORDS
        at = [(i, j) for i in range(0, len(x) - n + 1) for j in range(max(0, i - 6), min(len(y) - n, i + 6) + 1) if (x[i:i + n] == y[j:j + n]).all()]
        if not at:
            continue
        ax, ay = np.array([at[i] for i in sorted(rnd.choice(len(at), min(len(at), 8), replace=False).tolist())]).T
        x0, y0 = rnd.integers(0, 1000, 2).tolist()
        for chain in sd.chains(ax, ay):
            cx, cy = ax[chain], ay[chain]
            expected += [(len(rows), x0 + a, x0 + b, y0 + c, e) for a, b, c, e in sd.passages_of(x, y, cx, cy)]
            rows.append((x.tobytes(), y.tobytes(), (cx + x0).astype(np.int32).tobytes(), (cy + y0).astype(np.int32).tobytes(), x0, y0))
    if rows:
        *lists, x0, y0 = zip(*rows)
        got = sd.passages_of_many(*lists, np.array(x0), np.array(y0))
        assert sorted(zip(*(v.tolist() for v in got))) == sorted(expected)


def test_two_anchors_chain_as_many_do():
    """Pairs of documents with two anchors, which are not chained one by one, give the chains of chains()."""
    from bursar.llm import substring_dedup as sd
    rnd = np.random.default_rng(3)
    expected, place, ref = [], [], []
    for k in range(400):
        x, y = np.sort(rnd.integers(0, rnd.choice((8, 40, 400)), 2)), rnd.integers(0, rnd.choice((8, 40, 400)), 2)
        if x[0] == x[1] and y[0] == y[1]:
            continue
        place, ref = [*place, *(((k + 500) << sd.PLACE_BITS) + x)], [*ref, *((k << sd.PLACE_BITS) + y)]
        expected += [(k + 500, k, tuple(sorted(zip(x[c].tolist(), y[c].tolist())))) for c in sd.chains(x, y)]
    frame = sd._frame([(0, sd.planes(np.array(place)), sd.planes(np.array(ref)))], False)
    got = []
    for pdf in sd._chains(type("Sent", (), {"value": (np.zeros(0, np.int64), np.zeros(0, np.int64))}))(iter([frame])):
        for r in pdf.itertuples():
            at = [np.frombuffer(raw, np.int32).tolist() for raw in (r.ax, r.ay)]
            assert (r.n, r.x, r.y) == (len(at[0]), at[0][0], at[1][0])
            got.append((r.rank, r.ref, tuple(sorted(zip(*at)))))
    assert sorted(got) == sorted(expected) and {len(c) for *_, c in expected} == {1, 2}


def test_repeats_count_hot_seeds_where_the_links_come(spark, tmp_path, monkeypatch):
    """The sampled counts are gone once the links are written: only the folders of the job itself are left."""
    from bursar.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "scratch", lambda _, name: str(tmp_path / name))
    substring_dedup.repeated_passages(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    assert {p.name for p in tmp_path.iterdir()} == {"repeats"}


def test_near_copies_hold_no_sketches_once_they_are_known(spark):
    """What is returned refers to narrow rows: signatures and bands do not stay on disk for as long as it lives."""
    from bursar.llm import jaccard_join
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " w60"), (4, "other")], "doc_id long, text string")
    for out in (jaccard_join.jaccard_join(df), jaccard_join.one_of_each(df)):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "LogicalRDD" in plan and "signature" not in plan and "bands" not in plan
        assert sorted(r.doc_id for r in out.collect()) in ([1, 2, 3, 4], [1, 4])


def test_texts_are_dealt_out_once_for_both_sides_of_a_chain(spark, tmp_path, monkeypatch):
    """The later of two joins with the same columns of the documents uses what the first one has shuffled."""
    from bursar.llm import substring_dedup
    plans, kept = {}, substring_dedup.written

    def written(df, path):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, path)

    monkeypatch.setattr(substring_dedup, "written", written)
    monkeypatch.setattr(substring_dedup, "scratch", lambda _, name: str(tmp_path / name))
    passage = " ".join(f"w{k}" for k in range(60))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([(k, f"a{k} b{k} {passage} c{k}") for k in range(5)], "doc_id long, text string")
        _, passages = substring_dedup.repeated_passages(df)
        got = sorted((r.ref_doc_id, r.start, r.end, r.ref_start, r.n_equal) for r in passages.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(0, 2, 62, 2, 60)] * 4
    assert "ReusedExchange" in plans["links"] and "ReusedExchange" in plans["aligned"]


@given(st.data())
@settings(max_examples=30, deadline=None)
def test_seeds_of_many_texts_are_those_of_each(data):
    """Texts side by side, of any length, give the least k-mer of each window of each text, the first of equals."""
    from bursar.llm import substring_dedup as sd
    from bursar.llm.word_codes import _BASE
    rnd = np.random.default_rng(data.draw(st.integers(0, 10 ** 6)))
    lengths = [0, 1, 4, 5, 6, 8, 9, 19, 20, 34, 35, 36, 50, 51, 70]
    texts = [rnd.integers(0, rnd.choice((2, 50, 2 ** 32)), rnd.choice(lengths), dtype=np.uint32) for _ in range(data.draw(st.integers(1, 8)))]
    expected = []
    for number, t in enumerate(texts):
        words = sd.mixed(t.astype(np.uint64) + np.uint64(1)).tolist()
        for k, window in ((sd.SEED_WORDS, sd.WINDOW), *sd.CONTEXTS):
            sums = [sum(w * pow(_BASE, k - 1 - j, 1 << 64) for j, w in enumerate(words[a:a + k])) % (1 << 64) for a in range(len(t) - k + 1)]
            h = sd.mixed(np.array(sums, np.uint64)).tolist()
            least = {min(range(a, min(a + window, len(h))), key=lambda p: (h[p] >> sd.PLACE_BITS, p)) for a in range(max(1, len(h) - window + 1))} if h else set()
            expected += [(int(np.uint64(h[p]).astype(np.int64)), number, p) for p in least]
    assert sorted(zip(*(v.tolist() for v in sd.every_seed(texts)))) == sorted(expected)
