"""M12 with M15 in one time order: restocks between issues, in bulk.

Events of one item are taken in time order: a restock raises the stock, a request is accepted when its
quantity is at most what is left. With rises the stock can reach any height again, so the small domain that
``stock_fold`` uses behind its first refusal does not exist. What holds instead:

* Let W fall by every request, refused ones too, but never below 0, and rise with every restock. The stock is at
  least W and at most W + Q, Q being the largest usable quantity of the item: an accepted request lowers both
  alike, and a refused one means that less than Q was left.
* W over a stretch of events is ``max(c, w - s)``, two numbers, and such functions compose; so W at the start of
  every segment follows from sums and running maxima over one row per segment.
* Hence a segment's effect only matters for the Q + 1 stocks from its W on: a function on a domain that does not grow with
  the stock, the restocks or the rows. These functions are exact pieces, composed as a blockwise prefix
  (``stock_fold``), which gives every segment's true starting stock, from which it is folded.

Items and events are range-partitioned together by (item, item row first, time), so an item's row precedes its events. A
segment decides every run that begins in it at once; the rest is at most one carried run per segment. All
that is handed on, and all joins, are keyed by segment: no step hashes an item's events.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bursar.operators.numbering import numbered
from bursar.operators.staging import staged
from bursar.operators.stock_fold import (ACCEPTED, HEAD, INSUFFICIENT, INVALID, MAX_CENTS, OPEN, REASONS, TOO_LARGE,
                                         UNKNOWN, _bounds, _from_cents, _merged, _segment_starts, fold_segment)
from bursar.session import ensure_checkpoint_dir
from bursar.sources import schemas
from bursar.sources.tables import conform

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Time order of an item's events: by day, restocks of a day first, then by arrival.
RESTOCK, ISSUE = 0, 1
ORDER = ["day", "kind", "event_id", "student_id", "quantity"]
APPLIED = HEAD + 1  # what becomes of a restock

_EVENT = T.StructType([T.StructField("uniform_id", T.LongType()), T.StructField("day", T.DateType()),
                       T.StructField("kind", T.IntegerType()), T.StructField("event_id", T.LongType()),
                       T.StructField("student_id", T.LongType()), T.StructField("quantity", T.IntegerType()),
                       T.StructField("amount_cents", T.LongType())])
_COLUMNS = _EVENT.fieldNames()
_DECIDED = T.StructType([*_EVENT.fields, T.StructField("price_cents", T.LongType()), T.StructField("state", T.IntegerType()),
                         T.StructField("seg", T.IntegerType()), T.StructField("left", T.LongType())])
_MEASURE = "uniform_id long, seg int, fall long, floor long, widest long"
_FUNCTION = "uniform_id long, seg int, f_starts array<long>, f_offsets array<long>"


@dataclass
class LedgerResult:
    issued: DataFrame   # accepted requests as new uniform_issues rows
    rejects: DataFrame  # kind, event_id, uniform_id, reject_reason
    items: DataFrame    # uniform_items with the stock left


def fold_events(rise: np.ndarray, take: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """Accepted flags and the stock left of events in order: rise by restocks, or take where it fits (0: neither)."""
    accepted, left, a = np.zeros(len(take), bool), int(start), 0
    for b in [*np.flatnonzero(rise > 0).tolist(), len(take)]:
        accepted[a:b], left = fold_segment(take[a:b], left)
        if b < len(take):
            left += int(rise[b])
        a = b
    return accepted, left


def measure(rise: np.ndarray, take: np.ndarray) -> tuple[int, int]:
    """(s, c): over the events W goes from w to max(c, w - s)."""
    level = np.concatenate([[0], np.cumsum(rise - take)])
    return int(-level[-1]), int(level[-1] - level.min())


def window_function(rise: np.ndarray, take: np.ndarray, low: int, high: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """The events' effect on the stocks low .. low + widest, as a function of how far a stock is below the top of its window.

    From slack r (stock low + widest - r) the events leave slack r - offsets[i] below high + widest, for
    starts[i] <= r < starts[i + 1]. Slacks are used so that a known stock, the bottom of its window, is the largest.
    """
    starts, offsets = np.zeros(1, np.int64), np.full(1, low, np.int64)  # stock k + offset + moved for k = 0 .. widest
    moved, least, most, end = 0, low, low + widest, widest + 1
    for a, q in zip(rise.tolist(), take.tolist()):
        if a > 0:
            moved += a
        elif q > 0 and q <= least + moved:
            moved -= q
        elif 0 < q <= most + moved:
            split = q - moved - offsets  # from this k on the piece's stock reaches q
            ends = np.append(starts[1:], end)
            whole, part = starts >= split, (starts < split) & (split < ends)
            first = np.concatenate([starts, split[part]])
            below = np.concatenate([np.where(whole, offsets - q, offsets), offsets[part] - q])
            order = np.argsort(first, kind="stable")
            starts, offsets = _merged(first[order], below[order])
            least = int((starts + offsets).min())
            most = int((np.append(starts[1:], end) - 1 + offsets).max())
    slack = widest + 1 - np.append(starts[1:], end)
    return slack[::-1], (offsets + moved - high)[::-1]


def _usable(pdf: pd.DataFrame, price: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states of events that are refused whatever the stock, rises, usable quantities) of one item's events.

    A quantity above ``bound``, the opening stock and all restocks, fits nowhere and is insufficient.
    """
    quantity = pdf["quantity"].fillna(0).to_numpy(np.int64)
    issue = pdf["kind"].to_numpy() == ISSUE
    state = np.where(issue, INSUFFICIENT, APPLIED).astype(np.int32)
    state[quantity < 1] = INVALID
    state[issue & (quantity >= 1) & (quantity * price > MAX_CENTS)] = TOO_LARGE
    rise = np.where(state == APPLIED, quantity, 0)
    take = np.where(state == INSUFFICIENT, quantity, 0)
    if bound is not None:
        take[take > bound] = 0
    return state, rise, take


def _fold_run(pdf: pd.DataFrame, price: int, start: int) -> tuple[np.ndarray, int]:
    state, rise, take = _usable(pdf, price)
    accepted, left = fold_events(rise, take, start)
    state[accepted] = ACCEPTED
    return state, left


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One segment: decides the runs that begin here, leaves the carried run open, hands on the last item's stock."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    pdf = pdf.sort_values(["uniform_id", "is_event", *ORDER], kind="stable", na_position="first").reset_index(drop=True)
    ids = pdf["uniform_id"].fillna(-1).to_numpy(np.int64)
    unidentified = pdf["uniform_id"].isna().to_numpy()
    event = pdf["is_event"].to_numpy() == 1
    opening, price = (pdf[c].fillna(0).to_numpy(np.int64) for c in ("opening", "price_cents"))
    state, cents = np.full(len(pdf), OPEN, np.int32), np.zeros(len(pdf), np.int64)
    bounds, head = _bounds(ids), None
    for a, b in zip(bounds[:-1], bounds[1:]):
        if not event[a]:  # the item's row comes first
            first = a + int(np.argmax(event[a:b])) if event[a:b].any() else b
            state[first:b], left = _fold_run(pdf.iloc[first:b], int(price[a]), int(opening[a]))
            cents[first:b] = price[a]
            if b == len(pdf):
                head = (int(ids[a]), int(price[a]), left)
        elif a > 0 or unidentified[a]:
            state[a:b] = UNKNOWN
    seg = TaskContext.get().partitionId()
    out = pdf.loc[event, _COLUMNS].assign(price_cents=cents[event], state=state[event], seg=seg, left=None)
    if len(out):
        yield out
    if head:
        yield pd.DataFrame({"uniform_id": [head[0]], "day": [None], "kind": [None], "event_id": [None], "student_id": [None],
                            "quantity": [None], "amount_cents": [None], "price_cents": [head[1]], "state": [HEAD],
                            "seg": [seg], "left": [head[2]]}).astype({c: "Int64" for c in ("kind", "event_id", "student_id", "quantity", "amount_cents")})


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(ORDER, kind="stable", na_position="first")


def _first(pdf: pd.DataFrame, column: str) -> int:
    return int(pdf[column].iloc[0])


def _measured(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    _, rise, take = _usable(pdf, _first(pdf, "price_cents"), _first(pdf, "bound"))
    fall, floor = measure(rise, take)
    return pd.DataFrame({"uniform_id": [_first(pdf, "uniform_id")], "seg": [_first(pdf, "seg")], "fall": [fall], "floor": [floor],
                         "widest": [int(take.max(initial=0))]})


def _function(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    _, rise, take = _usable(pdf, _first(pdf, "price_cents"), _first(pdf, "bound"))
    starts, offsets = window_function(rise, take, _first(pdf, "low"), _first(pdf, "next_low"), _first(pdf, "width"))
    return pd.DataFrame({"uniform_id": [_first(pdf, "uniform_id")], "seg": [_first(pdf, "seg")],
                         "f_starts": [starts.tolist()], "f_offsets": [offsets.tolist()]})


def _fold_carried(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    price = _first(pdf, "price_cents")
    state, left = _fold_run(pdf, price, _first(pdf, "stock"))
    return pdf[_COLUMNS].assign(price_cents=price, state=state, seg=pdf["seg"].to_numpy(), left=left)


def stock_ledger(items: DataFrame, requests: DataFrame, restocks: DataFrame, *, segments: int | None = None,
                 rows_per_segment: int = 1_000_000, block: int = 1024) -> LedgerResult:
    """Applies dated restocks and issue requests to the items' stock in one time order, for all items.

    Events of a day: restocks first, then requests, each by arrival; a null day comes first. Rules as in M12 and
    M15: a restock needs a positive quantity, a request one that is left and a total that fits the money type; both need
    a known item. A missing opening stock counts as 0.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    blank = lambda *names: (F.lit(None).cast(_DECIDED[n].dataType).alias(n) for n in names)
    heads = items.select("uniform_id", F.lit(0).alias("is_event"), *blank(*_COLUMNS[1:]),
                         F.coalesce(F.col("quantity_in_stock"), F.lit(0)).cast("long").alias("opening"),
                         (F.col("price") * 100).cast("long").alias("price_cents"))
    none = [F.lit(None).cast("long").alias(c) for c in ("opening", "price_cents")]
    asked = conform(requests, schemas.ISSUE_REQUESTS).select(
        "uniform_id", F.lit(1).alias("is_event"), F.col("date_issued").alias("day"), F.lit(ISSUE).alias("kind"),
        F.col("request_id").alias("event_id"), "student_id", "quantity",
        (F.col("amount_paid") * 100).cast("long").alias("amount_cents"), *none)
    added = conform(restocks, schemas.DATED_RESTOCKS).select(
        "uniform_id", F.lit(1).alias("is_event"), F.col("date_added").alias("day"), F.lit(RESTOCK).alias("kind"),
        F.col("seq").alias("event_id"), *blank("student_id"), F.col("add_quantity").alias("quantity"), *blank("amount_cents"), *none)
    events = asked.unionByName(added)
    if not segments:
        least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        segments = max(least, -(-events.count() // max(1, rows_per_segment)), 1)
    key = [F.col(k).asc_nulls_first() for k in ("uniform_id", "is_event", *ORDER)]
    out = (heads.unionByName(events).repartitionByRange(segments, *key)
           .mapInPandas(_fold_partition, _DECIDED).checkpoint(eager=True))

    # One row per segment with a carried run: the item's price, the stock handed on, and what no quantity can exceed.
    opened = out.filter(F.col("state") == OPEN)
    rises = (out.filter((F.col("kind") == RESTOCK) & (F.col("quantity") > 0)).groupBy("uniform_id")
             .agg(F.sum("quantity").alias("rises")))
    handed = out.filter(F.col("state") == HEAD).select("uniform_id", F.col("price_cents").alias("price"), F.col("left").alias("opening"))
    runs = staged(opened.select("uniform_id", "seg").distinct().join(handed, "uniform_id", "left").join(rises, "uniform_id", "left")
                  .withColumn("bound", F.col("opening") + F.coalesce("rises", F.lit(0)))
                  .select("uniform_id", "seg", "price", "opening", "bound"))
    carried = (opened.drop("price_cents", "state", "left").join(runs.drop("uniform_id"), "seg")
               .withColumnRenamed("price", "price_cents"))
    unknown = carried.filter(F.col("opening").isNull())
    known = carried.filter(F.col("opening").isNotNull()).drop("opening")

    # W at the start of each segment, and how wide an item's windows are; rows here are segments, not events.
    measured = staged(known.groupBy("seg").applyInPandas(_measured, _MEASURE))
    of_item = Window.partitionBy("uniform_id").orderBy("seg")
    before = of_item.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    lows = (measured.join(runs.select("seg", "opening"), "seg")
            .withColumn("fallen", F.coalesce(F.sum("fall").over(before), zero))
            .withColumn("low", F.greatest(F.first("opening").over(of_item),
                                          F.max(F.col("floor") + F.col("fallen") + F.col("fall")).over(before)) - F.col("fallen"))
            .withColumn("next_low", F.greatest(F.col("floor"), F.col("low") - F.col("fall")))
            .withColumn("width", F.max("widest").over(Window.partitionBy("uniform_id")))
            .select("uniform_id", "seg", "low", "next_low", "width"))
    lows = staged(lows)
    functions = (known.join(lows.drop("uniform_id"), "seg").groupBy("seg").applyInPandas(_function, _FUNCTION))
    # The first carried segment starts from a known stock: the bottom of its window, the largest slack.
    live = lows.select("uniform_id", "seg", F.col("width").alias("boundary_end"))
    slacks = _segment_starts(functions, live, block, segments)
    stocks = staged(lows.join(slacks, ["uniform_id", "seg"])
                    .select("seg", (F.col("low") + F.col("width") - F.col("seg_start")).alias("stock")))
    folded = known.join(stocks, "seg").groupBy("seg").applyInPandas(_fold_carried, _DECIDED)

    columns = [*_COLUMNS, "price_cents", "state"]
    decided = (out.filter(~F.col("state").isin(OPEN, HEAD)).select(*columns)
               .unionByName(unknown.select(*_COLUMNS, "price_cents", F.lit(UNKNOWN).alias("state")))
               .unionByName(folded.select(*columns))).checkpoint(eager=True)
    accepted = decided.filter(F.col("state") == ACCEPTED)
    issued = accepted.select(F.col("event_id").alias("issue_key"), "student_id", "uniform_id", "quantity",
                             _from_cents(F.col("price_cents") * F.col("quantity")).alias("total_price"),
                             _from_cents(F.col("amount_cents")).alias("amount_paid"), F.col("day").alias("date_issued"))
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), F.col("state"))
    reason = F.when((F.col("kind") == RESTOCK) & (F.col("state") == UNKNOWN),
                    F.when(F.coalesce(F.col("quantity"), F.lit(0)) > 0, "unknown_uniform").otherwise("invalid_quantity")).otherwise(reason)
    rejects = (decided.filter(~F.col("state").isin(ACCEPTED, APPLIED))
               .select(F.when(F.col("kind") == RESTOCK, "restock").otherwise("issue").alias("kind"), "event_id", "uniform_id",
                       reason.alias("reject_reason")))
    change = (decided.filter(F.col("state").isin(ACCEPTED, APPLIED)).groupBy("uniform_id")
              .agg(F.sum(F.when(F.col("kind") == RESTOCK, F.col("quantity")).otherwise(-F.col("quantity"))).alias("_change")))
    left = (items.join(change, "uniform_id", "left")
            .withColumn("quantity_in_stock", (F.col("quantity_in_stock") + F.coalesce("_change", F.lit(0))).cast("int"))
            .select(*items.columns))
    return LedgerResult(conform(issued, schemas.UNIFORM_ISSUES), rejects, left)


def with_keys(issued: DataFrame, issues: DataFrame) -> DataFrame:
    """``issued`` with keys that follow the largest of ``issues``, in the order of the requests."""
    top = issues.agg(F.coalesce(F.max("issue_key"), F.lit(0)).cast("long")).scalar()
    return numbered(issued, ["issue_key"], "_pos").withColumn("issue_key", top + F.col("_pos")).drop("_pos")
