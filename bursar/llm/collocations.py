"""Phrase collocations by dynamic itemset counting: lengths interleaved over cyclic scans of the shards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm import word_codes
from bursar.llm.common import cut, few_rows_at_once, runs, scratch, small_batches, written
from bursar.llm.jaccard_join import mixed

#: Words of a phrase at most, occurrences it needs, rows reported for each language.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Shards of one cycle; one is scanned in each step.
SHARDS = 2
#: Cells of the table that tells the step from which a phrase counts as reached: one byte each, a table for
#: each length but the last. When it fills up, more phrases are counted than need be, never fewer.
CELLS = 1 << 22
NEVER = 255

#: Words, the most frequent of the first step, that all tasks know by number: 8 bytes each.
HEAD_WORDS = 1 << 19
NO_HEAD = np.zeros(0, np.uint64)
#: Words of one row of the written chunks.
ROW_WORDS = 500_000

#: Phrases that a task counts before it hands them on, and words of the texts to each bucket of phrases.
HELD_PHRASES, BUCKET_WORDS = 800_000, 2_000_000


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of texts of one language as packed codes with a 0 between pieces."""
    number, held, size = 0, {}, Counter()

    def row(lang: str) -> pd.DataFrame:
        nonlocal number
        codes = np.concatenate([c for part in held.pop(lang) for c in (part, np.zeros(1, np.uint64))][:-1])
        number += 1
        return pd.DataFrame({"lang": [lang], "number": [number - 1], "n": [size.pop(lang)], "codes": [packed(codes[:, None])]})

    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=True):
            for chunk in word_codes.chunks(part["text"].tolist()):
                codes, pieces, *_ = word_codes.words_of(chunk)
                if not len(codes):
                    continue
                held.setdefault(lang, []).append(word_codes.with_breaks(codes, pieces))
                size[lang] += len(codes)
                if size[lang] >= ROW_WORDS:
                    yield row(lang)
                elif sum(size.values()) >= 4 * ROW_WORDS:  # many languages with few words each
                    yield row(max(size, key=size.get))
    for lang in sorted(held):
        yield row(lang)


def grams(codes: np.ndarray, lang: str, lengths: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of 1, 2, ... ``lengths`` codes that begin at each position, for one language."""
    h = mixed(codes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))
    yield h
    for k in range(1, lengths):
        h = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[k:]) if len(h) else h
        yield h


def phrase_hashes(codes: np.ndarray, lang: str) -> np.ndarray:
    """The same hashes of phrases, one a row of codes."""
    h = mixed(codes[:, 0] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))
    for k in range(1, codes.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k])
    return h


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(cells - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(cells - 1)).astype(np.int64)


def summed(codes: np.ndarray, hashes: np.ndarray, since: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal rows of ``codes`` (one column a word) made one, their counts added, in the order of their hashes."""
    order = np.argsort(hashes, kind="stable")
    codes, hashes = codes[order], hashes[order]
    new = np.ones(len(codes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    if (codes[1:][~new[1:]] != codes[:-1][~new[1:]]).any():  # two phrases share a hash: put them in order themselves
        again = np.lexsort((*codes.T, hashes))
        order, codes, hashes = order[again], codes[again], hashes[again]
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(f[order], starts) if len(starts) else f[:0]
    return codes[starts], hashes[starts], since[order][starts], sums


_BLOCK = "kind int, bucket int, lang string, k int, codes binary, since binary, f binary"
STATE, DONE, CELLS_SET = range(3)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: equal high bytes then lie together and are compressed away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def packed(codes: np.ndarray, head: np.ndarray = NO_HEAD) -> bytes:
    """Rows of codes (one column a word), column by column: each distinct code once and the numbers of these, byte plane by
    byte plane, compressed. Of codes in ``head`` (sorted) only the steps from place to place there are kept."""
    words, number = np.unique(codes.T, return_inverse=True)
    place = np.searchsorted(head, words)
    known = np.zeros(len(words), bool)
    known[place < len(head)] = head[place[place < len(head)]] == words[place < len(head)]
    order = np.concatenate([np.flatnonzero(known), np.flatnonzero(~known)])
    to = np.empty(len(words), np.uint16 if len(words) <= 1 << 16 else np.uint32)
    to[order] = np.arange(len(words))
    parts = _planes(np.diff(place[known], prepend=0).astype(np.uint32)), _planes(words[~known]), _planes(to[number.ravel()])
    return np.array([codes.shape[0], len(words), int(known.sum())], np.uint32).tobytes() + pa.compress(b"".join(parts), "zstd", asbytes=True)


def unpacked(k: int, raw: bytes, head: np.ndarray = NO_HEAD) -> np.ndarray:
    n, distinct, known = np.frombuffer(raw, np.uint32, 3).tolist()
    size = 2 if distinct <= 1 << 16 else 4
    data = np.frombuffer(pa.decompress(raw[12:], 4 * known + 8 * (distinct - known) + size * n * k, "zstd", asbytes=True), np.uint8)
    a, b = 4 * known, 4 * known + 8 * (distinct - known)
    values = lambda part, width: np.ascontiguousarray(part.reshape(width, -1).T).view(f"u{width}").ravel()
    words = np.concatenate([head[np.cumsum(values(data[:a], 4), dtype=np.int64)], values(data[a:b], 8)])
    return words[values(data[b:], size)].reshape(k, n).T


def _blocks(kind: int, lang: str, codes: np.ndarray, hashes: np.ndarray, since: np.ndarray, f: np.ndarray, buckets: int,
            head: np.ndarray = NO_HEAD) -> Iterator[tuple]:
    """Phrases of one language and length as packed rows, one for each bucket of their hashes (which are in order).

    Within a bucket they are sorted, and codes lie word by word, so that equal words lie together.
    """
    bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        order = a + np.lexsort(codes[a:b].T[::-1])
        counts = f[order]
        # Counts in as few bytes as the largest of them needs; their number tells how many.
        yield (kind, int(bucket[a]), lang, codes.shape[1], packed(codes[order], head), since[order].astype(np.uint8).tobytes(),
               counts.astype(np.min_scalar_type(int(counts.max()))).tobytes())


def _unpacked(k: int, codes: bytes, since: bytes, f: bytes, head: np.ndarray = NO_HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(k, codes, head), np.frombuffer(since, np.uint8), np.frombuffer(f, f"u{len(f) // len(since)}").astype(np.int64)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])


def _count(step: int, shards: int, max_words: int, buckets: int, tables, words):
    """Counts one shard: each phrase whose two subphrases are reached, for one full cycle from then on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached, head = tables.value, words.value
        held: dict[tuple[str, int], list] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal size
            out = []
            for (lang, _), parts in held.items():
                out += _blocks(STATE, lang, *summed(*(np.concatenate([p[c] for p in parts]) for c in range(4))), buckets, head)
            held.clear()
            size = 0
            for a in range(0, len(out), 100):
                yield _rows(out[a:a + 100])

        for pdf in batches:
            for lang, raw in zip(pdf["lang"], pdf["codes"]):
                codes = unpacked(1, raw).ravel()
                since = None  # the step from which the shorter phrase at each position counts as reached
                for k, h in enumerate(grams(codes, lang, max_words), 1):
                    if not len(h):
                        break
                    begins = np.where(codes != 0, 0, NEVER).astype(np.uint8) if k == 1 else np.maximum(since[:-1], since[1:])
                    live = np.flatnonzero(begins != NEVER)
                    if not len(live):
                        break
                    first = begins[live].astype(np.int64)
                    now = live[(first <= step) & (first > step - shards)]
                    if len(now):
                        runs_now = np.stack([codes[now + j] for j in range(k)], axis=1)
                        counted = summed(runs_now, h[now], begins[now], np.ones(len(now), np.int64))
                        held.setdefault((lang, k), []).append(counted)
                        size += len(counted[1])
                    if k < max_words:
                        since = np.full(len(h), NEVER, np.uint8)
                        a, b = cells_of(h[live], len(reached[k - 1]))
                        since[live] = np.maximum(reached[k - 1][a], reached[k - 1][b])
                if size >= HELD_PHRASES:
                    yield from flush()
        if size:
            yield from flush()
    return run


def _merge(step: int, shards: int, max_words: int, min_count: int, buckets: int, cells: int, words):
    """The buckets' phrases so far with the new counts: what goes on, what is done, and the cells of what is reached."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = words.value
        for group in runs(batches, ["bucket"]):
            out = []
            for (lang, k), part in group.groupby(["lang", "k"]):
                blocks = [_unpacked(k, *r, head) for r in zip(part["codes"], part["since"], part["f"])]
                codes, since, f = (np.concatenate([b[c] for b in blocks]) for c in range(3))
                codes, h, since, f = summed(codes, phrase_hashes(codes, lang), since, f)
                often = f >= min_count
                if k < max_words and often.any():
                    found = np.unique(np.concatenate(cells_of(h[often], cells))).astype(np.int32)
                    out.append((CELLS_SET, int(part["bucket"].iloc[0]), lang, k, found.tobytes(), b"", b""))
                complete = since.astype(np.int64) <= step - shards + 1
                for kind, chosen in ((STATE, ~complete), (DONE, complete & often)):
                    if chosen.any():
                        out += _blocks(kind, lang, codes[chosen], h[chosen], since[chosen], f[chosen], buckets, head)
            if out:
                yield _rows(out)
    return run


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k, raw in zip(pdf["k"], pdf["codes"]):
            found = np.frombuffer(raw, np.int32)
            yield pd.DataFrame({"k": np.full(len(found), k), "cell": found})


def _phrases(words):
    """Done phrases, one a row: their codes in a row, each most significant byte first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, k, *block in zip(pdf["lang"], pdf["k"], pdf["codes"], pdf["since"], pdf["f"]):
                codes, _, f = _unpacked(k, *block, words.value)
                raw, width = codes.astype(">u8").tobytes(), 8 * k
                yield pd.DataFrame({"lang": lang, "phrase": [raw[a:a + width] for a in range(0, len(raw), width)], "f": f})
    return run


def _cell(f: np.ndarray) -> np.ndarray:
    """Counts in cells, eight for each doubling: the more the higher, few hundred in all."""
    return np.floor(8 * np.log2(f)).astype(np.int64)


def _word_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for block in zip(pdf["codes"], pdf["since"], pdf["f"]):
            cell, n = np.unique(_cell(_unpacked(1, *block)[2]), return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": n})


def _words_from(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in zip(pdf["codes"], pdf["since"], pdf["f"]):
                codes, _, f = _unpacked(1, *block)
                found = codes[_cell(f) >= least, 0]
                if len(found):
                    yield pd.DataFrame({"codes": [found.tobytes()]})
    return run


def head_words(merged: DataFrame, most: int = HEAD_WORDS) -> np.ndarray:
    """Sorted codes of the words that were counted most in the first step, ``most`` at most. What they are changes only how
    phrases are packed."""
    words = merged.filter((F.col("k") == 1) & (F.col("kind") != CELLS_SET)).select("codes", "since", "f")
    least = total = None
    for r in sorted(words.mapInPandas(_word_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect(), reverse=True):
        total = r.n + (total or 0)
        if total > most or r.cell < 8:  # words that occurred once do not pay
            break
        least = r.cell
    if least is None:
        return NO_HEAD
    found = words.mapInPandas(_words_from(least), "codes binary").collect()
    return np.unique(np.concatenate([np.frombuffer(r["codes"], np.uint64) for r in found]))


def frequent_phrases(chunks: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shards: int = SHARDS,
                     cells: int = CELLS) -> DataFrame:
    """(lang, phrase, f): every phrase of 1 to ``max_words`` words with f >= ``min_count``; a phrase is the codes of
    its words, f all its occurrences.

    Step t counts shard t modulo ``shards``. Single words are counted from step 0; a longer phrase from the step
    after both its subphrases (without its last and without its first word) have reached ``min_count``, in
    whatever part of the data was counted by then. Each is counted for exactly one full cycle, wherever it
    began, so its count is that of all data. What has completed its cycle leaves the running state. The
    tables that tell tasks which subphrases are reached have a fixed size: two cells a phrase, each with the step
    at which it was set. A cell shared by chance only activates a phrase too early, which is then counted over its
    own full cycle all the same. Counts travel and rest in packed blocks by a hash of the phrase, frequent words as numbers; tasks add
    up their counts first, so a frequent phrase burdens no bucket.
    """
    spark = chunks.sparkSession
    if 6 * shards >= NEVER:
        raise ValueError("too many steps for one byte a cell: use fewer shards")
    reached = [np.full(cells, NEVER, np.uint8) for _ in range(max_words - 1)]
    changed = [-1] * (max_words - 1)  # the step from which the last cells of a length count
    folder = scratch(spark, "collocations")
    n_words = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, n_words // BUCKET_WORDS)
    state, done, step, head = None, [], 0, spark.sparkContext.broadcast(NO_HEAD)
    while step < shards or any(c > step - shards for c in changed):
        sent = spark.sparkContext.broadcast(reached)
        new = (chunks.filter(F.col("shard") == step % shards).select("lang", "codes")
               .mapInPandas(_count(step, shards, max_words, buckets, sent, head), _BLOCK))
        both = new if state is None else state.unionByName(new)
        # Two folders in turn: a step writes over the state before the last.
        with few_rows_at_once(spark):
            merged = written(both.repartition("bucket").sortWithinPartitions("bucket")
                             .mapInPandas(_merge(step, shards, max_words, min_count, buckets, cells, head), _BLOCK), f"{folder}/{step % 2}")
        marks = (merged.filter(F.col("kind") == CELLS_SET).mapInPandas(_cells, "k int, cell int").distinct()
                 .groupBy("k", (F.col("cell") / 4096).cast("int")).agg(F.collect_list("cell").alias("cells")))
        for r in marks.collect():  # at most the cells of the tables, whatever the input
            at = np.asarray(r["cells"])
            fresh = at[reached[r["k"] - 1][at] == NEVER]
            if len(fresh):
                reached[r["k"] - 1][fresh] = step + 1
                changed[r["k"] - 1] = step + 1
        sent.destroy()
        if step >= shards - 1:
            done.append(cut(merged.filter(F.col("kind") == DONE).mapInPandas(_phrases(head), "lang string, phrase binary, f long"), free=False))
        state = merged.filter(F.col("kind") == STATE)
        if step == 0:  # what is packed until here refers to no word by number
            head = spark.sparkContext.broadcast(head_words(merged))
        step += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def coded_chunks(documents: DataFrame, text: str = "text", lang: str = "lang", shards: int = SHARDS) -> DataFrame:
    """Written chunks of coded words: shard, lang, n (words) and codes."""
    small_batches(documents)
    return written(documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
               .filter("text is not null")
               .mapInPandas(_coded, "lang string, number int, n long, codes binary")
               .withColumn("shard", F.pmod(F.col("number") + F.spark_partition_id(), F.lit(shards)))
               .drop("number"), scratch(documents.sparkSession, "coded"))


def _with_cuts(often: DataFrame) -> DataFrame:
    """Each candidate with a row for each cut: k (words of its first part), and both parts."""
    words = F.col("a_phrase")
    return (often.withColumnRenamed("phrase", "a_phrase").filter(F.length("a_phrase") > 8)
            .withColumn("k", F.explode(F.sequence(F.lit(1), (F.length("a_phrase") / 8).cast("int") - 1)))
            .withColumn("head", F.substring(words, F.lit(1), F.col("k") * 8))
            .withColumn("tail", F.substring(words, F.col("k") * 8 + 1, F.length(words))))


def _needed_cells(cells: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.unique(np.concatenate(cells_of(mixed(pdf["code"].to_numpy(np.int64).view(np.uint64)), cells)))
            yield pd.DataFrame({"cell": found.astype(np.int32)})
    return run


def _spelled(sent):
    """Code and word of each word that may be needed, once for each task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needed, known = sent.value, np.zeros(0, np.uint64)
        for pdf in batches:
            for chunk in word_codes.chunks(pdf["text"].tolist()):
                codes, _, starts, ends, lower = word_codes.words_of(chunk)
                a, b = cells_of(mixed(codes), len(needed))
                at = np.flatnonzero(needed[a] & needed[b])
                at = at[np.unique(codes[at], return_index=True)[1]]
                at = at[~np.isin(codes[at], known)]
                if len(at):
                    known = np.concatenate([known, codes[at]])
                    yield pd.DataFrame({"code": codes[at].view(np.int64), "word": [
                        lower[x:y].decode("utf-8", "replace") for x, y in zip(starts[at].tolist(), ends[at].tolist())]})
    return run


def spelled(documents: DataFrame, needed: DataFrame, text: str, cells: int = CELLS) -> DataFrame:
    """(code, word) of the codes of ``needed`` (code), from the texts.

    Tasks know what is needed from a table of fixed size; what else it lets through goes with the join. Two words of
    one code, which no choice could tell apart, stop the job.
    """
    spark = documents.sparkSession
    table = np.zeros(cells, bool)
    marks = needed.mapInPandas(_needed_cells(cells), "cell int").distinct().groupBy((F.col("cell") / 4096).cast("int")).agg(F.collect_list("cell").alias("cells"))
    for r in marks.collect():  # at most the cells of the table
        table[r["cells"]] = True
    return (documents.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(_spelled(spark.sparkContext.broadcast(table)), "code long, word string")
            .groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("other")).join(needed, "code", "left_semi")
            .select("code", F.when(F.col("word") == F.col("other"), F.col("word"))
                    .otherwise(F.raise_error(F.lit("two words share a 64-bit code"))).alias("word")))


def _codes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes = (pdf["phrase"].str.len() // 8).to_numpy(np.int64)
        of = np.repeat(np.arange(len(pdf)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.frombuffer(b"".join(pdf["phrase"]), ">i8").astype(np.int64)
        yield pd.DataFrame({"lang": pdf["lang"].to_numpy()[of], "phrase": pdf["phrase"].to_numpy()[of],
                            "place": place, "code": codes})


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words.

    Words are what space and tab part, A-Z in lower case; pieces end at ``.,;:!?`` and line ends, and no phrase
    goes across. ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its lowest-scoring cut, n
    all words of the language; score = floor(1000 a n / (l r)) in decimal arithmetic. A phrase inside a longer one
    with the same count is left out: an occurrence of the longer always holds one of the shorter, so only longer
    phrases with one word more need a look. A null language is ``und``, a null, empty or blank text has no
    words, repeated rows count each; an empty table gives no rows. Other columns are not read.
    """
    shards = options.get("shards", SHARDS)
    chunks = coded_chunks(documents, text, lang, shards)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    often = cut(frequent_phrases(chunks, min_count, max_words, **options))
    part = lambda name, f: often.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # Written before each join on parts: a word that begins very many phrases can then be split.
    cuts = cut(_with_cuts(often).join(part("head", "l"), ["lang", "head"]).select("lang", "a_phrase", "f", "k", "tail", "l"), free=False)
    scored = (cuts.join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
              .withColumn("score", F.expr("(cast(f as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div "
                                          "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    best = scored.groupBy("lang", F.col("a_phrase").alias("phrase")).agg(
        F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("c")).select("lang", "phrase", "c.*")
    longer = often.filter(F.length("phrase") > 16)
    inside = (longer.select("lang", "f", F.explode(F.array(
        F.expr("substring(phrase, 1, length(phrase) - 8)"), F.expr("substring(phrase, 9, length(phrase))"))).alias("phrase")).distinct())
    # The best of each language with all ties of the last, in two levels: what meets in one task is at most top for each of
    # 32 parts of a language, and ties. Only these phrases are spelled out.
    order = [F.col("score").desc(), F.col("f").desc()]
    some = (best.join(inside, ["lang", "phrase", "f"], "left_anti").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
            .withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top))
    kept = cut(some.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("part", "place"))
    places = cut(kept.select("lang", "phrase").mapInPandas(_codes_of, "lang string, phrase binary, place int, code long"), free=False)
    words = cut(spelled(documents, places.select("code").distinct(), text))
    texts = (places.join(words, "code").groupBy("lang", "phrase")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("words")))
    rows = (kept.join(texts, ["lang", "phrase"])
            .select("lang", F.col("words").alias("phrase"), F.col("f").alias("a"), "l", "r", "n", "score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
