"""Mixing sources to target weights: Pfair windows, scheduled earliest deadline first."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm.common import aside, small_batches

#: Documents of a block, the unit of the schedule.
BLOCK_ROWS = 32
#: Slots of one period; target weights are rounded to multiples of its inverse. As no input has so many blocks,
#: a phase ends within its first period and stays within a block of the true weights.
PERIOD = 1 << 32
#: The largest sources, each a stream of its own; all further ones share one more stream.
MAX_STREAMS = 255
#: Slices of the hash order, in which a source's documents are numbered independently.
SLICES = 4096


def quantised(weights: np.ndarray, period: int) -> np.ndarray:
    """Whole shares of ``period`` by largest remainder, at least one each."""
    exact = weights / weights.sum() * (period - len(weights))
    share = np.floor(exact).astype(np.int64)
    rest = period - len(weights) - int(share.sum())
    share[np.argsort(-(exact - share), kind="stable")[:rest]] += 1
    return share + 1


def one_period(shares: np.ndarray, period: int, left: np.ndarray) -> np.ndarray:
    """The stream of each slot of a period, up to the slot in which a stream has given all its ``left`` blocks.

    Block j of a stream with ``share`` of ``period`` slots is released at floor(j * period / share)
    and due by ceil((j + 1) * period / share); each slot takes the released block with the earliest
    deadline (ties: the lowest stream). Shares add up to the period, so every block meets its window.
    """
    share, most = [int(q) for q in shares], [int(n) for n in left]
    given = [0] * len(share)
    waiting = [(0, s) for s in range(len(share))]
    ready: list[tuple[int, int]] = []
    out = array("H" if len(share) <= 1 << 16 else "L")
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(given[s] + 1) * period // share[s]), s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        given[s] += 1
        if given[s] == most[s]:
            break
        if given[s] < share[s]:
            heapq.heappush(waiting, (max(t + 1, given[s] * period // share[s]), s))
    return np.array(out, np.int64)


def schedule(blocks: list[int], weights: list[float], period: int = PERIOD) -> dict:
    """The whole schedule in closed form: phases, each a repeated period over the streams left.

    A phase ends with the first stream that runs out; the weights of the others are scaled up for the
    next. There are at most as many phases as streams. Work and memory (4 bytes a block) grow with the blocks.
    """
    left, weight = np.array(blocks, np.int64), np.array(weights, float)
    done = np.zeros(len(left), np.int64)
    phases, start = [], 0
    while (left > 0).any():
        live = np.flatnonzero(left > 0)
        share = quantised(weight[live], period)
        slots = one_period(share, period, left[live])
        order = np.argsort(slots, kind="stable").astype(np.int32 if len(slots) < 1 << 31 else np.int64)
        places = np.split(order, np.cumsum(np.bincount(slots, minlength=len(live)))[:-1])
        # The slot after which each stream is out; the phase ends at the first of them.
        length = len(slots) if (left[live] <= share).any() and len(slots) < period else min(
            (int(left[s]) - 1) // int(q) * period + int(p[(int(left[s]) - 1) % int(q)]) + 1
            for s, q, p in zip(live, share, places))
        for s, q, p in zip(live, share, places):
            took = length // period * int(q) + int(np.searchsorted(p, length % period))
            phases.append({"stream": int(s), "from": int(done[s]), "to": int(done[s]) + took, "start": start,
                           "share": int(q), "places": p})
            done[s] += took
            left[s] -= took
        start += length
    return {"period": period, "phases": phases, "slots": start}


def _timed(sent, sizes: list[int], block_rows: int):
    """A function that puts slot, release, deadline and position on (stream, number) rows; ``sent`` holds the plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _places(sent.value, sizes, block_rows)(batches)

    return run


def _places(plan: dict, sizes: list[int], block_rows: int):
    by: dict[int, list[dict]] = {}
    for p in plan["phases"]:
        by.setdefault(p["stream"], []).append(p)
    period = plan["period"]

    def slots(stream: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = by[stream]
        at = np.searchsorted(np.array([p["to"] for p in mine]), block, side="right")
        slot, release, due = (np.empty(len(block), np.int64) for _ in range(3))
        for k in np.unique(at):
            p, here = mine[k], at == k
            j, q = block[here] - p["from"], p["share"]
            slot[here] = p["start"] + j // q * period + p["places"][j % q]
            release[here] = p["start"] + j * period // q
            due[here] = p["start"] - (-(j + 1) * period // q)
        return slot, release, due

    # Only a stream's last block can be short: at most one per stream.
    short = sorted((int(slots(s, np.array([(n - 1) // block_rows]))[0][0]), -n % block_rows)
                   for s, n in enumerate(sizes) if n)
    short_at = np.array([x[0] for x in short], np.int64)
    missing = np.concatenate([[0], np.cumsum([x[1] for x in short])]).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number = pdf["mix_number"].to_numpy(np.int64)
            block = number // block_rows
            slot, release, due = (np.zeros(len(pdf), np.int64) for _ in range(3))
            for s, rows in pdf.groupby("mix_stream").indices.items():
                slot[rows], release[rows], due[rows] = slots(int(s), block[rows])
            pdf["mix_block"], pdf["mix_slot"], pdf["mix_release"], pdf["mix_deadline"] = block, slot, release, due
            pdf["mix_position"] = (slot * block_rows - missing[np.searchsorted(short_at, slot)]
                                   + number % block_rows)
            yield pdf

    return run


def mixed(documents: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5,
          block_rows: int = BLOCK_ROWS, period: int = PERIOD, max_streams: int = MAX_STREAMS,
          carry: bool = False, seed: int = 42) -> DataFrame:
    """Every row of ``documents`` with its place in the mix.

    Returns doc_id, source and mix_stream, mix_number (its number within the stream), mix_block,
    mix_slot, mix_release, mix_deadline and mix_position (0 to rows - 1: the order of the mix); with
    ``carry`` all input columns go along. Input columns of these names are replaced.

    The target weight of a source is ``weights[source]``, or where none are given its row count to the
    power ``alpha``. Sources beyond the ``max_streams`` largest, and those that ``weights`` leaves out,
    share one stream, which weighs the sum of their weights; inside it they come in turn by their own weights.
    Sources without a given weight share, by their rows, what the weights leave of 1 or, if they leave
    nothing, their share of the rows. A null source is a source of its own. No row is dropped or repeated: when a stream runs
    out, the others go on at their relative weights. Within such a phase a stream's share of the blocks
    is never a whole block away from its weight (rounded to 1/period).

    Documents of a stream come in the order of a hash of the id. They are numbered in slices of that
    order, whose counts give the offsets, so that no task holds a whole source. The driver holds counts of
    ``max_streams`` + 1 streams and the slots of all blocks, 4 bytes each. Repeated rows keep separate places.
    """
    spark = documents.sparkSession
    taken = [c for c in documents.columns if c.startswith("mix_")]
    base = documents.drop(*taken)
    top = base.groupBy("source").agg(F.count("*").alias("n"))
    if weights:
        given = [(s, w) for s, w in weights.items() if w > 0]
        counted = {r.source: r.n for r in top.filter(_one_of([s for s, _ in given])).collect()}
        given = sorted(((s, w, counted.get(s, 0)) for s, w in given), key=lambda x: (-x[1], str(x[0])))[:max_streams]
    else:
        given = [(r.source, float(r.n) ** alpha, r.n)
                 for r in top.orderBy(F.desc("n"), "source").limit(max_streams).collect()]
    total = base.count() if weights or len(given) == max_streams else sum(n for _, _, n in given)
    named = sum(n for *_, n in given)
    sizes = [n for *_, n in given] + [total - named]
    listed = sum(w for _, w, _ in given)
    others = top.join(F.broadcast(_named(spark, [(s, 0.0) for s, *_ in given])),
                      F.col("source").cast("string").eqNullSafe(F.col("mix_name")), "left_anti")
    if weights:
        # Sources beyond the largest weights keep theirs; those without one share what the weights leave.
        own = _named(spark, [(s, float(w)) for s, w in weights.items() if w > 0])
        others = others.join(F.broadcast(own), F.col("source").cast("string").eqNullSafe(F.col("mix_name")), "left")
        more = others.agg(F.coalesce(F.sum("mix_value"), F.lit(0.0)),
                          F.coalesce(F.sum(F.when(F.col("mix_value").isNull(), F.col("n"))), F.lit(0))).first()
        every = listed + more[0]
        without = 1 - every if every < 1 else every * max(more[1], 1) / max(total - more[1], 1)
        rest = more[0] + (without if more[1] or not more[0] else 0)
        others = others.withColumn("mix_weight", F.coalesce("mix_value", F.lit(without / max(more[1], 1)) * F.col("n")))
    else:
        others = others.withColumn("mix_weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
        rest = others.agg(F.coalesce(F.sum("mix_weight"), F.lit(1.0))).first()[0]
    end = others.agg(F.max(F.col("n") / F.col("mix_weight"))).first()[0] if total > named else None
    target = [w for _, w, _ in given] + [rest]
    plan = schedule([-(-n // block_rows) for n in sizes], target, period)

    # Bounded by max_streams; the null source is matched too.
    names = spark.createDataFrame([(s, i) for i, (s, *_) in enumerate(given)],
                                  "mix_name string, mix_of int")
    found = base.join(F.broadcast(names), F.col("source").cast("string").eqNullSafe(F.col("mix_name")), "left") \
        .withColumn("mix_stream", F.coalesce("mix_of", F.lit(len(given)))).drop("mix_name", "mix_of")
    found = found.withColumn("mix_hash", F.xxhash64(F.lit(seed), "doc_id")) \
        .withColumn("mix_slice", F.shiftrightunsigned("mix_hash", 52).cast("int") % SLICES)
    if end:
        found = _in_turn(found, others, len(given), float(end))
    kept = found if carry else found.select("doc_id", "source", "mix_stream", "mix_hash", "mix_slice")
    counts = found.groupBy("mix_stream", "mix_slice").agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy("mix_stream").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_stream", "mix_slice",
                            F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_offset"))
    inside = Window.partitionBy("mix_stream", "mix_slice").orderBy(
        "mix_hash", "doc_id", *(["text"] if carry and "text" in base.columns else []))
    numbered = (kept.withColumn("mix_in", F.row_number().over(inside))
                .join(F.broadcast(offsets), ["mix_stream", "mix_slice"])  # (max_streams + 1) x SLICES at most
                .withColumn("mix_number", (F.col("mix_offset") + F.col("mix_in") - 1).cast("long"))
                .drop("mix_offset", "mix_in", "mix_hash", "mix_slice"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInPandas(
        _timed(spark.sparkContext.broadcast(plan), sizes, block_rows),
        f"{fields}, mix_block long, mix_slot long, mix_release long, mix_deadline long, mix_position long")


def _named(spark, rows: list[tuple[str | None, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "mix_name string, mix_value double")


def _in_turn(found: DataFrame, others: DataFrame, stream: int, end: float) -> DataFrame:
    """The rows of the shared stream get the order of a second level: document i of a source with weight w comes
    at (i + phase) / w, so at any time each source has given its weight's share to within a document, until
    it runs out. The time takes the place of the hash, its slices those of the hash order."""
    shared = found.filter(F.col("mix_stream") == stream)
    inside = Window.partitionBy("source").orderBy("mix_hash", "doc_id")
    phase = F.pmod(F.xxhash64(F.lit(7), "source"), F.lit(1 << 20)) / float(1 << 20)
    timed = (shared.withColumn("mix_i", F.row_number().over(inside) - 1)
             .join(others.select(F.col("source").alias("mix_other"), "mix_weight"), F.col("source").eqNullSafe(F.col("mix_other")))
             .withColumn("mix_time", (F.col("mix_i") + phase) / F.col("mix_weight") / F.lit(end))
             .withColumn("mix_slice", F.least(F.floor(F.col("mix_time") * SLICES), F.lit(SLICES - 1)).cast("int"))
             .withColumn("mix_hash", (F.col("mix_time") * float(1 << 52)).cast("long")))
    return found.filter(F.col("mix_stream") < stream).unionByName(timed.select(*found.columns))


def _one_of(values: list) -> Column:
    known = [v for v in values if v is not None]
    found = F.col("source").isin(known) if known else F.lit(False)
    return found | F.col("source").isNull() if None in values else found


def in_mix_order(documents: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``documents`` in the order of the mix, in range partitions."""
    small_batches(documents)
    base, back = aside(documents, lambda c: c.startswith("mix_"))
    out = mixed(base, carry=True, **options)
    return back(out.repartitionByRange("mix_position").sortWithinPartitions("mix_position"))
