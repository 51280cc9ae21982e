"""N-gram Jaccard join with Bayesian pruning of MinHash candidates and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.llm.common import aside, block_pairs, components, cut_unsized, forest, runs, small_batches, steps, unsized

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: BANDS bands of BAND_ROWS MinHash values are candidates' meeting points: at similarity 0.8 a pair shares
#: no band with probability (1 - 0.8 ** 3) ** 20 = 6e-7.
BANDS, BAND_ROWS = 20, 3
HASHES = BANDS * BAND_ROWS
#: MinHash values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 10, 1e-6
#: Texts compared with each other in one group at most (two blocks).
BAND_BLOCK, SET_BLOCK = 1024, 256
#: Shingles of one dense product.
COLUMNS = 4096

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run of its words."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * _MIX[0] + h[k:len(h) - size + 1 + k]
    return np.unique(mixed(out))


def minhash(items: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set, as unsigned 32-bit values."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 2048):
        low = np.minimum(low, (items[k:k + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n MinHash values that keep a pair.

    With a uniform prior the posterior of the similarity after m matches is Beta(m + 1, n - m + 1), and
    P(similarity >= t) is the chance of at most m successes in n + 1 trials of probability t.
    """
    chance = 0.0
    for m in range(n + 1):
        chance += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if chance >= tolerance:
            return m
    return n + 1


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float):
    """Indices of the pairs of signatures (rows) that outlive every comparison step."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        matches += a[:, k, None] == b[None, :, k]
    alive = matches >= least_matches(STEP, threshold, tolerance)
    if same:
        alive = np.triu(alive, 1)
    x, y = np.nonzero(alive)
    m = matches[x, y].astype(np.int32)
    for k in range(STEP, HASHES, STEP):
        if not len(x):
            break
        for c in range(k, min(k + STEP, HASHES)):
            m += a[x, c] == b[y, c]
        keep = m >= least_matches(min(k + STEP, HASHES), threshold, tolerance)
        x, y, m = x[keep], y[keep], m[keep]
    return x, y


def _sides(pdf: pd.DataFrame):
    """The rows of a block pair as (left rows, right rows, whether both are the same block)."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    mine = pdf["mine"].to_numpy()
    left = np.flatnonzero(mine == i)
    return (left, left, True) if i == j else (left, np.flatnonzero(mine == j), False)


def _sketch(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in steps(batches):
            node, count, signature, bands = [], [], [], []
            for t in pdf["text"]:
                items = shingles(t, size)
                count.append(len(items))
                if not len(items):
                    node.append(None)
                    signature.append(None)
                    bands.append(None)
                    continue
                low = minhash(items)
                node.append(node_of(items))
                signature.append(low.tobytes())
                bands.append([xxhash.xxh64_intdigest(low[k:k + BAND_ROWS].tobytes(), seed=k) - (1 << 63)
                              for k in range(0, HASHES, BAND_ROWS)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "text_hash": pdf["text_hash"].to_numpy(),
                                "node": pd.array(node, "Int64"), "n_shingles": count, "signature": signature,
                                "bands": bands})
    return run


def node_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _candidates(threshold: float, tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["band", "i", "j"]):
            signature = np.stack([np.frombuffer(s, np.uint32) for s in pdf["signature"]])
            node = pdf["node"].to_numpy()
            left, right, same = _sides(pdf)
            x, y = likely_pairs(signature[left], signature[right], same, threshold, tolerance)
            tree = forest(len(pdf), left[x], right[y])
            if tree:
                yield pd.DataFrame({"a": [node[p] for p, _ in tree], "b": [node[q] for _, q in tree]})
    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets, by products of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    owner, column = owner[shared], renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[left] @ dense[right].T
    return out


def _verified(threshold: float, tolerance: float):
    """Per text its number of linked rows in a block pair, and tree links of the components found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["component", "i", "j"]):
            pdf = pdf.drop_duplicates("node").reset_index(drop=True)  # repeated rows give the same text again
            signature = np.stack([np.frombuffer(s, np.uint32) for s in pdf["signature"]])
            left, right, same = _sides(pdf)
            x, y = likely_pairs(signature[left], signature[right], same, threshold, tolerance)
            if not len(x):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in pdf["items"]]
            size = np.array([len(s) for s in sets], float)
            common = overlaps(sets, left, right)[x, y]
            x, y = left[x], right[y]
            linked = common >= threshold * (size[x] + size[y] - common) - 1e-9
            x, y = x[linked], y[linked]
            rows = pdf["rows"].to_numpy(np.int64)
            links = np.bincount(x, weights=rows[y], minlength=len(pdf)) + np.bincount(y, weights=rows[x], minlength=len(pdf))
            node = pdf["node"].to_numpy()
            edges = forest(len(pdf), x, y)
            has = np.flatnonzero(links)
            a = [*node[has].tolist(), *(node[p] for p, _ in edges)]
            b = [*[None] * len(has), *(node[q] for _, q in edges)]
            n = [*links[has].astype(np.int64).tolist(), *[0] * len(edges)]
            yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": n})
    return run


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, text_hash, copy_id, class_id, n_links, n_shingles, class_key: one row per row of ``documents``.

    Two rows are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``threshold``. n_links counts the other rows linked directly, class_id is the smallest doc_id that
    links lead to (its own included), copy_id the smallest among rows with the very same set; class_key
    identifies the class even without ids, and is null without words.

    Equal sets are merged first, so copies are counted and never compared; a group of copies with a third
    of all rows is one text. Each text has HASHES MinHash values. Texts that share a band of them are
    compared value by value, STEP at a time; a pair goes when the posterior probability that it reaches
    the threshold is below ``tolerance``. Of each group only a spanning tree of the surviving pairs is
    kept; its components then bring the texts' whole shingle sets together, where surviving pairs are
    verified exactly and counted. Groups larger than a block are compared block by block in tasks of
    their own, and write counts and trees, never pairs: rows stay linear in the documents. Only the
    comparisons inside a group of different near copies grow with its square.

    A null or wordless text has no links and is its own class; fewer than ``size`` words form one shingle.
    Repeated rows are copies of each other. A null doc_id is kept; a class of null ids only has a null id.
    """
    small_batches(documents)
    base = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    sketches = cut_unsized(base.mapInPandas(_sketch(size), f"doc_id {id_type}, text_hash long, node long, n_shingles int, "
                                                   "signature binary, bands array<long>"))
    texts = cut_unsized(sketches.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("copy_id"),
        F.count("*").alias("rows"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))
    # The result refers to these rows as long as it lives, so they do not keep the sketches on disk.
    rows = cut_unsized(sketches.select("doc_id", "text_hash", "node", "n_shingles"))
    del sketches

    meet = texts.select("node", F.explode("bands").alias("band"))
    sizes = (meet.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                      F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"))
             .filter("n > 1")
             # Bands with the same members need only one comparison.
             .groupBy("n", "lo", "hi", "of").agg(F.min("band").alias("band")).select("band", "n"))
    met = meet.join(sizes, "band").join(texts.select("node", "signature"), "node")
    grouped = block_pairs(met, "n", "node", BAND_BLOCK, 1).drop("n")
    edges = (grouped.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
             .mapInPandas(_candidates(threshold, tolerance), "a long, b long"))
    near = components(edges)

    # Written, here and below, so that the joins deal both sides out anew and can split large groups.
    near = cut_unsized(near)
    near = cut_unsized(near.join(cut_unsized(near.groupBy("component").agg(F.count("*").alias("members"))), "component")
               .join(texts.select("node", "first", "rows", "signature"), "node"))
    wanted = near.select("node", "component", "members", "rows", "signature", F.col("first.doc_id").alias("w_id"),
                         F.col("first.text_hash").alias("w_hash"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in steps(batches):
            yield pdf.assign(items=[shingles(t, size).tobytes() for t in pdf["text"]]).drop(columns="text")

    found = (base.join(unsized(wanted), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
             .select("node", "component", "members", "rows", "signature", "text")
             .mapInPandas(sets, "node long, component long, members long, rows long, signature binary, items binary"))
    grouped = block_pairs(found, "members", "node", SET_BLOCK, 2).drop("members")
    linked = cut_unsized(grouped.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
                 .mapInPandas(_verified(threshold, tolerance), "a long, b long, n long"))
    links = linked.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    classes = components(linked.filter("b is not null").select("a", "b"))
    smallest = (classes.join(texts.select("node", "copy_id"), "node").groupBy("component")
                .agg(F.min("copy_id").alias("class_id")))
    of = cut_unsized(texts.select("node", "copy_id", "rows").join(links, "node", "left")
             .join(classes.join(smallest, "component").select("node", "component", "class_id"), "node", "left")
             .select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
                     F.coalesce("component", "node").alias("class_key"),
                     (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    # Texts by the thousand share a node: the join is left to skew handling.
    return (rows.select("doc_id", "text_hash", "node", "n_shingles").join(of, "node", "left")
            .select("doc_id", "text_hash", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", "class_key"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each class of near copies: the one with the smallest id (ties: by a hash
    of the text). Wordless texts are no copies of each other, but repeated rows, of equal id and text, are one.
    """
    classes = jaccard_join(documents, **options)
    first = classes.filter("class_key is not null").groupBy("class_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    kept = (first.select("first.doc_id", "first.text_hash")
            .unionByName(classes.filter("class_key is null").select("doc_id", "text_hash"))
            .select(F.col("doc_id").alias("join_id"), F.col("text_hash").alias("join_hash")))
    base, back = aside(documents, lambda c: c.startswith("join_"))
    hashed = base.withColumn("join_text", F.xxhash64("text"))
    found = hashed.join(unsized(kept), F.col("doc_id").eqNullSafe(F.col("join_id")) & (F.col("join_text") == F.col("join_hash")), "left_semi")
    return back(found.dropDuplicates(["doc_id", "join_text"]))
