"""Embedding near-duplicates through an inverted multi-index: a grid of two codebooks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.llm.common import components, cut, forest, runs
from bursar.operators.staging import staged

THRESHOLD = 0.9
#: Bound of the sample that codebooks are fitted on, and Lloyd rounds.
SAMPLE, ROUNDS = 20_000, 12
#: Vectors per grid cell aimed at; words of a codebook at least and at most.
PER_CELL, LEAST_WORDS, MOST_WORDS = 64, 4, 4096
#: Queries whose true neighbours among all rows are counted to choose the number of visited cells; where fewer than
#: ENOUGH of them have neighbours, neighbours are made for MADE vectors, as far away as linked ones can be.
QUERIES, ENOUGH, MADE = 1000, 100, 1000
TARGET_RECALL = 0.995
#: Vectors of a side that one group compares.
BLOCK = 1024
#: Sums of distances that one step orders.
STEP_SUMS = 4_000_000


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    v = raw.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct random points; a word left without points keeps its place."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:words]].copy()
    for _ in range(ROUNDS):
        near = _distances(points, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        some = count > 0
        sums = np.add.reduceat(points[order], (np.cumsum(count) - count)[some], axis=0)
        centres[some] = sums / count[some, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres ** 2).sum(1)[None] - 2 * points @ centres.T + (points ** 2).sum(1)[:, None]


@dataclass
class Index:
    """The two codebooks; cell a * words + b is the product of word a and word b."""

    first: np.ndarray
    second: np.ndarray

    def cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, in the order of the multi-sequence traversal.

        With both halves' words sorted by distance, the traversal takes cells by the sum of distances. A
        cell of the a-th and b-th words has a * b - 1 cells that come no later, so only those with
        a * b <= count can be among the first ``count``: these are summed and sorted for all vectors at once.
        """
        count = min(count, len(self.first) * len(self.second))
        sides = []
        for d in self.distances(vectors):
            order = np.argsort(d, axis=1, kind="stable")[:, :count]
            sides.append((order, np.take_along_axis(d, order, axis=1)))
        (o1, d1), (o2, d2) = sides
        a, b = np.array([(p, q) for p in range(o1.shape[1]) for q in range(min(o2.shape[1], count // (p + 1)))]).T
        out, step = np.empty((len(vectors), count), np.int64), max(1, STEP_SUMS // len(a))
        for k in range(0, len(vectors), step):
            part = slice(k, k + step)
            # Ties are taken by the words' ranks, which is the order of (a, b).
            best = np.argsort(d1[part][:, a] + d2[part][:, b], axis=1, kind="stable")[:, :count]
            out[part] = (np.take_along_axis(o1[part], a[best], axis=1) * len(self.second)
                         + np.take_along_axis(o2[part], b[best], axis=1))
        return out

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves from the words of their codebooks."""
        half = self.first.shape[1]
        return _distances(vectors[:, :half], self.first), _distances(vectors[:, half:], self.second)

    def places(self, d1: np.ndarray, d2: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells of the whole grid one vector visits until it has been in each of ``cells`` (ties count)."""
        sums = d1[cells // len(self.second)] + d2[cells % len(self.second)]
        return np.searchsorted(np.sort(d2), sums[:, None] - d1[None] + 1e-9, side="right").sum(axis=1)


def one_cell(dim: int) -> Index:
    """All vectors in one cell, where all pairs are compared."""
    return Index(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in column])


def vectors(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, node, raw) with raw float32 bytes, and the dimension.

    node identifies the values; it and raw are null for vectors that are null or zero, hold null or
    non-finite components, or differ in length from most.
    """
    rows = embeddings.select("vec_id", F.col(column).cast("array<float>").alias("v"))
    sizes = rows.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count() \
        .orderBy(F.desc("count"), "d").first()
    dim = sizes.d if sizes else 0
    valid = (F.size("v") == dim) & (F.lit(dim) > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    id_type = embeddings.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [None if v is None else (np.asarray(v, np.float32) + np.float32(0)).tobytes() for v in pdf["v"]]
            node = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "node": pd.array(node, "Int64"), "raw": raw})

    return rows.select("vec_id", F.when(valid, F.col("v")).alias("v")).mapInPandas(
        pack, f"vec_id {id_type}, node long, raw binary"), dim


def fit(distinct: DataFrame, n: int) -> Index:
    """Codebooks from at most ``SAMPLE`` of the distinct vectors, with words in proportion to the root of their number."""
    sample = _matrix(r.raw for r in distinct.orderBy(F.xxhash64(F.lit(29), "node"), "node").limit(SAMPLE).select("raw").collect())
    points = unit(sample)
    words = int(min(MOST_WORDS, max(LEAST_WORDS, round((n / PER_CELL) ** 0.5)), len(points)))
    half = points.shape[1] // 2
    return Index(fit_codebook(points[:, :half], words, 1), fit_codebook(points[:, half:], words, 2))


def made_neighbours(queries: np.ndarray, threshold: float) -> np.ndarray:
    """For each query a vector at exactly the threshold's cosine, in a random direction."""
    side = np.random.default_rng(37).standard_normal(queries.shape)
    side -= (side * queries).sum(axis=1, keepdims=True) * queries
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return threshold * queries + (1 - threshold ** 2) ** 0.5 * side


def visited_cells(distinct: DataFrame, index: Index, n: int, threshold: float = THRESHOLD) -> tuple[int, float]:
    """How many cells a vector must visit for the target recall, and the recall measured at that.

    The first vectors in the order of a hash are compared with all vectors by brute force, block by block;
    each true neighbour is counted under the place of its own cell in the query's order of the whole grid.
    Recall is the mean over the queries that have neighbours, so a large group of near copies weighs as much as
    it has vectors and not as many as it has pairs. Where fewer than ``ENOUGH`` have neighbours (and not all ``n`` vectors
    were asked), as in a large corpus without many near copies, vectors also get a made neighbour just at the threshold.
    True ones are at least as near, so their recall is the target at least, and nothing needs to be compared to learn it.
    """
    spark = distinct.sparkSession

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, nodes, index = sent.value
        queries = unit(_matrix(raw))
        d1, d2 = index.distances(queries)
        for pdf in batches:
            out = [(np.zeros(0, int),) * 3]
            for k in range(0, len(pdf), BLOCK):
                part = pdf.iloc[k:k + BLOCK]
                rows, node = unit(_matrix(part["raw"])), part["node"].to_numpy()
                home = index.cells(rows, 1)[:, 0]
                for at in range(0, len(queries), BLOCK):
                    near = (queries[at:at + BLOCK] @ rows.T >= threshold) & (nodes[at:at + BLOCK, None] != node[None])
                    for q in np.flatnonzero(near.any(axis=1)):
                        cells, count = np.unique(home[near[q]], return_counts=True)
                        out.append((np.full(len(cells), at + q), index.places(d1[at + q], d2[at + q], cells), count))
            yield pd.DataFrame(dict(zip(("q", "place", "n"), map(np.concatenate, zip(*out)))))

    sample = distinct.orderBy(F.xxhash64(F.lit(31), "node"), "node").limit(max(QUERIES, MADE)).select("node", "raw").collect()
    chosen = sample[:QUERIES]
    sent = spark.sparkContext.broadcast(([bytes(r.raw) for r in chosen], np.array([r.node for r in chosen]), index))
    found = distinct.select("node", "raw").mapInPandas(ranks, "q int, place int, n long") \
        .groupBy("q", "place").agg(F.sum("n").alias("n")).toPandas()
    if found["q"].nunique() < ENOUGH and len(chosen) < n:
        queries = unit(_matrix(r.raw for r in sample[:MADE]))
        d1, d2 = index.distances(queries)
        home = index.cells(made_neighbours(queries, threshold), 1)[:, 0]
        made = [int(index.places(d1[q], d2[q], home[q:q + 1])[0]) for q in range(len(queries))]
        found = pd.concat([found, pd.DataFrame({"q": -1 - np.arange(len(made)), "place": made, "n": 1})], ignore_index=True)
    if not len(found):
        return 1, 1.0
    found["share"] = found["n"] / found.groupby("q")["n"].transform("sum") / found["q"].nunique()
    share = found.groupby("place")["share"].sum().sort_index().cumsum()
    enough = int(share.index[np.argmax(share.to_numpy() >= TARGET_RECALL)])
    return enough, min(1.0, float(share[enough]))


def _assign(sent, count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for pdf in batches:
            for k in range(0, len(pdf), BLOCK):
                part = pdf.iloc[k:k + BLOCK]
                yield part.assign(cells=index.cells(unit(_matrix(part["raw"])), count).astype(np.int64).tolist())
    return run


def _compare(threshold: float):
    """Per vector its linked rows found in a cell, and tree links of the components found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["cell", "m", "p"]):
            member = pdf["member"].to_numpy()
            at, of = np.flatnonzero(member), np.flatnonzero(~member)
            if not len(at) or not len(of):
                continue
            unit_rows, node, rows = unit(_matrix(pdf["raw"])), pdf["node"].to_numpy(), pdf["rows"].to_numpy(np.int64)
            x, y = np.nonzero(unit_rows[of] @ unit_rows[at].T >= threshold)
            x, y = of[x], at[y]
            other = node[x] != node[y]
            x, y = x[other], y[other]
            if not len(x):
                continue
            # The prober x visits y's cell and counts y here. y counts x in x's cell, if it visits that one, else here too.
            own = np.array([c[0] for c in pdf["cells"]])
            visited, among = np.array(pdf["cells"].iloc[at].tolist()), np.searchsorted(at, y)
            back = np.zeros(len(x), bool)
            for c in range(visited.shape[1]):
                back |= visited[among, c] == own[x]
            links = np.bincount(x, weights=rows[y], minlength=len(pdf)) + np.bincount(y[~back], weights=rows[x[~back]], minlength=len(pdf))
            # A vector is there twice, as a member and as a prober: trees go by the vector.
            distinct, number = np.unique(node, return_inverse=True)
            tree = forest(len(distinct), number[x], number[y])
            has = np.flatnonzero(links)
            yield pd.DataFrame({"a": [*node[has].tolist(), *(distinct[p] for p, _ in tree)],
                                "b": pd.array([*[None] * len(has), *(distinct[q] for _, q in tree)], "Int64"),
                                "n": [*links[has].astype(np.int64).tolist(), *[0] * len(tree)]})
    return run


def meetings(assigned: DataFrame) -> DataFrame:
    """(cell, m, p, member, node, rows, raw, cells): members and probers of each cell, by pairs of their blocks.

    A member has the list of all cells that it visits; a prober, of which there are as many as visited cells, only its own cell.
    """
    members = assigned.withColumn("cell", F.col("cells")[0])
    probers = assigned.withColumn("cell", F.explode("cells")).withColumn("cells", F.slice("cells", 1, 1))
    visits = assigned.select(F.explode("cells").alias("cell"), F.col("cells")[0].alias("own"))
    # Written, so that the planner knows how small this is: probers are then not dealt out for this join too.
    sizes = staged(visits.groupBy("cell").agg(F.count("*").alias("p"), F.sum((F.col("cell") == F.col("own")).cast("long")).alias("m"))
                   .filter("m > 0 and p > 1")
                   .select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("m_blocks"), F.ceil(F.col("p") / BLOCK).cast("int").alias("p_blocks")))
    spread = lambda df, own, n_own, other, n_other, role: (
        df.join(sizes, "cell").withColumn(own, F.pmod(F.xxhash64("node"), F.col(n_own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        .select("cell", "m", "p", F.lit(role).alias("member"), "node", "rows", "raw", "cells"))
    return spread(members, "m", "m_blocks", "p", "p_blocks", True).unionByName(
        spread(probers, "p", "p_blocks", "m", "m_blocks", False))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, visited_cells, measured_recall: one row per row of ``embeddings``.

    Vectors with a cosine of at least ``threshold`` in double precision are linked. Equal vectors are
    merged first, so copies are counted and never compared. A codebook for each half of the unit vectors,
    fitted on a bounded sample, spans a grid; every vector lies in one cell and visits the nearest cells in
    the order of the multi-sequence traversal. How many follows from a brute-force count over all rows for
    a sample of queries (and from made neighbours, where true ones are rare), so that the share of its neighbours that
    a query finds reaches ``TARGET_RECALL`` on average. Where that takes so many cells that comparing all pairs moves
    fewer rows, as in small tables, the grid is a single cell and all pairs are compared: recall is 1 then. Visitors and members of a cell meet in blocks, where cosines are computed exactly; tasks write counts and spanning
    trees, never pairs. A pair is counted once whichever side finds it.

    Vectors that are null or zero, hold null or non-finite components, or are not as long as most have no
    links; their component is their own id. Repeated rows are copies of each other. A null vec_id is kept.
    """
    spark = embeddings.sparkSession
    packed, _ = vectors(embeddings, column)
    rows = cut(packed)
    distinct = cut(rows.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("rows"), F.first("raw").alias("raw")))
    n = distinct.count()
    if n < 2:
        visits, recall, links, classes = 0, 1.0, None, None
    else:
        index = fit(distinct, n)
        visits, recall = visited_cells(distinct, index, n, threshold)
        # A single cell sends each vector to 2 n / BLOCK pairs of blocks.
        if visits > max(16, 2 * n // BLOCK):
            index, visits, recall = one_cell(index.first.shape[1] + index.second.shape[1]), 1, 1.0
        sent = spark.sparkContext.broadcast(index)
        assigned = cut(distinct.select("node", "rows", "raw").mapInPandas(_assign(sent, visits), "node long, rows long, raw binary, cells array<long>"))
        met = meetings(assigned)
        linked = cut(met.repartition("cell", "m", "p").sortWithinPartitions("cell", "m", "p")
                     .mapInPandas(_compare(threshold), "a long, b long, n long"))
        links = linked.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        classes = components(linked.filter("b is not null").select("a", "b"))
    of = distinct.select("node", "least_id", "rows")
    if links is not None:
        smallest = (classes.join(of, "node").groupBy("component").agg(F.min("least_id").alias("smallest")))
        of = (of.join(links, "node", "left")
              .join(classes.join(smallest, "component").select("node", "smallest"), "node", "left"))
    else:
        of = of.withColumn("links", F.lit(0).cast("long")).withColumn("smallest", F.lit(None).cast("long"))
    # Written, so that the join deals both sides out anew and can split a vector with very many copies.
    of = cut(of.select("node", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                       F.coalesce("smallest", "least_id").alias("smallest")))
    joined = rows.select("vec_id", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
                         F.lit(visits).alias("visited_cells"), F.lit(recall).alias("measured_recall"))
