"""Issue uniforms against stock, in bulk.

Rule (the uniform issue page): for one item, requests are taken in time order; a request is accepted when
its quantity is at least 1 and at most what is *left*; an accepted request reduces the stock, a
rejected one uses nothing, so a later, smaller request may still fit. This is a fold, not a running
sum (a running-sum cut-off rejects every request after the first one that does not fit).

A fold is sequential per item, and one item may carry a large share of all requests, so the
requests of an item are never gathered into one task. Instead, on one path at every size:

1. Items and requests are range-partitioned together by (item, item row first, order key) into bounded
   segments, so an item's row with its opening stock and price precedes its requests and is not joined
   to them. Each segment folds, where it lies, every item run whose item row it holds; what is left
   undecided is at most one run per segment, at its start: that of an item that began in an earlier
   segment. The result is checkpointed, so it is stable (and survives executor loss).
2. The segment that holds the item's row hands on the stock left at its end (one row per segment). For
   the carried runs only the quantity total per segment is needed to find those that fit entirely:
   while every request so far was accepted, the stock left is the start minus a running sum
   (computed as a blockwise prefix, so no window holds more than ``block`` segments).
3. The first carried run that does not fit entirely ("boundary") starts from a known stock and is folded
   sequentially (one bounded segment per task).
4. After the boundary the stock left is below the quantity of the first rejected request, so every
   later run's effect is a function on the small integer domain [0, left]. Each later run
   computes that function exactly, as pieces (one segment per task). The functions of one item are
   composed as a blockwise prefix (at most ``block`` functions per Python group, level by level),
   which gives every run's starting stock; then each run is folded from its start.

Per-task work is bounded by a segment's size (range bounds come from a sample, so sizes are
approximate, and rows with one identical order key are not split) or by ``block`` segment functions.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bursar.operators.numbering import numbered
from bursar.operators.staging import staged
from bursar.sources import schemas
from bursar.sources.schemas import MONEY
from bursar.sources.tables import conform
from bursar.session import ensure_checkpoint_dir

# The grouped-pandas functions below travel with the task (pickled by value), so Python workers
# need only numpy and pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ["date_issued", "request_id", "student_id", "quantity"]

# Money crosses into Python as exact integer cents (DECIMAL(12,2) x 100), never as Decimal objects.
# What becomes of a request. A row that is OPEN belongs to a run carried over from an earlier segment;
# a HEAD row is no request: it hands on an item's price and stock left at the end of its first segment.
OPEN, ACCEPTED, INSUFFICIENT, UNKNOWN, INVALID, TOO_LARGE, HEAD = range(7)
REASONS = {INSUFFICIENT: "insufficient_stock", UNKNOWN: "unknown_item", INVALID: "invalid_quantity",
           TOO_LARGE: "total_too_large"}
MAX_CENTS = 10 ** 12 - 1  # the largest amount of a line, DECIMAL(12,2)

_CARRIED = ["uniform_id", *ORDER, "amount_cents"]
_REQUEST = [T.StructField("uniform_id", T.LongType()), T.StructField("date_issued", T.DateType()),
            T.StructField("request_id", T.LongType()), T.StructField("student_id", T.LongType()),
            T.StructField("quantity", T.IntegerType()), T.StructField("amount_cents", T.LongType())]
_DECIDED = T.StructType([*_REQUEST, T.StructField("price_cents", T.LongType()), T.StructField("state", T.IntegerType()),
                         T.StructField("seg", T.IntegerType()), T.StructField("end_left", T.LongType())])
_TRANSITION_OUT = T.StructType([T.StructField("uniform_id", T.LongType()),
                                T.StructField("seg", T.IntegerType()),
                                T.StructField("f_starts", T.ArrayType(T.LongType())),
                                T.StructField("f_offsets", T.ArrayType(T.LongType()))])
_LEVEL = T.StructType([T.StructField("uniform_id", T.LongType()), T.StructField("idx", T.LongType()),
                       T.StructField("f_starts", T.ArrayType(T.LongType())),
                       T.StructField("f_offsets", T.ArrayType(T.LongType())),
                       T.StructField("domain", T.LongType()), T.StructField("boundary_end", T.LongType())])
_IDX_START = T.StructType([T.StructField("uniform_id", T.LongType()), T.StructField("idx", T.LongType()),
                           T.StructField("start", T.LongType())])


@dataclass
class IssueResult:
    issued: DataFrame      # accepted requests as new uniform_issues rows
    rejects: DataFrame     # request_id, uniform_id, reject_reason
    items: DataFrame       # uniform_items with the stock left
    table: DataFrame | None = None  # the issues table with the new rows, if it was given


def fold_segment(quantities: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """Sequential fold of one segment from a known stock: accepted flags and the stock left.

    The leading run that fits entirely is found with a cumulative sum; after it, only requests no
    larger than the stock left can ever be accepted (the stock only falls), so the loop visits just
    those candidates and re-filters them as the stock drops.
    """
    q = np.asarray(quantities, dtype=np.int64)
    accepted = np.zeros(len(q), dtype=bool)
    left = int(start)
    if len(q) == 0 or left < 1:
        return accepted, left
    valid = q >= 1  # a quantity below 1 is refused and uses nothing
    used = np.where(valid, q, 0)
    fits = int(np.searchsorted(np.cumsum(used), left, side="right"))
    if fits:
        accepted[:fits] = valid[:fits]
        left -= int(used[:fits].sum())
    cand = fits + np.flatnonzero(valid[fits:] & (q[fits:] <= left))
    while len(cand) and left >= 1:
        done = 0
        for i in cand[:256]:
            done += 1
            qi = int(q[i])
            if qi <= left:
                accepted[i] = True
                left -= qi
        rest = cand[done:]
        cand = rest[q[rest] <= left]
    return accepted, left


def transition(quantities: np.ndarray, domain: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment's effect on every starting stock 0..domain-1, exactly, as pieces.

    From stock L the segment leaves L - c(L), and c is constant on intervals. Returned as
    (starts, offsets): for starts[i] <= L < starts[i+1] (or ``domain``) the stock left is
    L - offsets[i]. Adjacent pieces with equal offsets are merged, so there are at most ``domain``
    pieces and usually far fewer. Requests of quantity >= domain can never fit and are skipped.
    """
    starts = np.zeros(1, dtype=np.int64)
    offsets = np.zeros(1, dtype=np.int64)
    qs = np.asarray(quantities, dtype=np.int64)
    for q in qs[(qs >= 1) & (qs < domain)]:
        q = int(q)
        ends = np.append(starts[1:], domain)
        split = q + offsets              # from this L on, the piece's stock reaches q
        whole = starts >= split          # the request fits everywhere in the piece
        part = (starts < split) & (split < ends)
        if not (whole.any() or part.any()):
            continue
        nb = np.concatenate([starts, split[part]])
        nc = np.concatenate([np.where(whole, offsets + q, offsets), offsets[part] + q])
        order = np.argsort(nb, kind="stable")
        starts, offsets = _merged(nb[order], nc[order])
    return starts, offsets


def _merged(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.concatenate([[True], offsets[1:] != offsets[:-1]])
    return starts[keep], offsets[keep]


def apply_at(f: tuple[np.ndarray, np.ndarray], stock: int) -> int:
    """Stock left after a segment function ``f`` from a given starting stock."""
    starts, offsets = f
    i = int(np.searchsorted(starts, stock, side="right")) - 1
    return int(stock - offsets[i])


def compose(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray],
            domain: int) -> tuple[np.ndarray, np.ndarray]:
    """``f`` then ``g`` as one function (same domain). Piece i of ``f`` maps [s_i, e_i) onto
    [s_i - o_i, e_i - o_i) with slope 1; the pieces of ``g`` met in that range split it."""
    fs, fo = f
    gs, go = g
    fe = np.append(fs[1:], domain)
    lo, hi = fs - fo, fe - fo
    j0 = np.searchsorted(gs, lo, side="right") - 1
    j1 = np.searchsorted(gs, hi - 1, side="right") - 1
    count = j1 - j0 + 1
    piece = np.repeat(np.arange(len(fs)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    j = j0[piece] + within
    starts = np.where(within == 0, fs[piece], gs[j] + fo[piece])
    return _merged(starts.astype(np.int64), (fo[piece] + go[j]).astype(np.int64))


def _fold_run(q: np.ndarray, price: int, start: int) -> tuple[np.ndarray, int]:
    """States of one item's requests in order, from a known stock and price, and the stock left."""
    state = np.full(len(q), INSUFFICIENT, dtype=np.int32)
    state[q < 1] = INVALID
    state[(q >= 1) & (q * price > MAX_CENTS)] = TOO_LARGE
    usable = np.where(state == INSUFFICIENT, q, 0)
    accepted, left = fold_segment(usable, start)
    state[accepted] = ACCEPTED
    return state, left


def _quantities(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["quantity"].fillna(0).to_numpy(dtype=np.int64)


def _bounds(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One segment: decide every run that begins here, leave the carried run open, hand on the last head."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    pdf = pdf.sort_values(["uniform_id", "is_request", *ORDER], kind="stable", na_position="first").reset_index(drop=True)
    ids = pdf["uniform_id"].fillna(-1).to_numpy(dtype=np.int64)
    unidentified = pdf["uniform_id"].isna().to_numpy()
    request = pdf["is_request"].to_numpy() == 1
    q = _quantities(pdf)
    opening, price = (pdf[c].fillna(0).to_numpy(dtype=np.int64) for c in ("opening", "price_cents"))
    state = np.full(len(pdf), OPEN, dtype=np.int32)
    cents = np.zeros(len(pdf), dtype=np.int64)
    head = None
    bounds = _bounds(ids)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if not request[a]:  # the item's row comes first
            first = a + int(np.argmax(request[a:b])) if request[a:b].any() else b
            state[first:b], left = _fold_run(q[first:b], int(price[a]), int(opening[a]))
            cents[first:b] = price[a]
            if b == len(pdf):
                head = (int(ids[a]), int(price[a]), left)
        elif a > 0 or unidentified[a]:
            state[a:b] = UNKNOWN
    seg = TaskContext.get().partitionId()
    out = pdf.loc[request, _CARRIED].assign(price_cents=cents[request], state=state[request], seg=seg, end_left=None)
    if len(out):
        yield out
    if head:
        yield pd.DataFrame({"uniform_id": [head[0]], "date_issued": [None], "request_id": [None], "student_id": [None],
                            "quantity": [None], "amount_cents": [None], "price_cents": [head[1]], "state": [HEAD],
                            "seg": [seg], "end_left": [head[2]]}).astype({"request_id": "Int64", "student_id": "Int64",
                                                                         "quantity": "Int32", "amount_cents": "Int64"})


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(ORDER, kind="stable", na_position="first")


def _fold_carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """The carried run of one segment, from its starting stock."""
    pdf = _ordered(pdf)
    price = int(pdf["price_cents"].iloc[0])
    state, left = _fold_run(_quantities(pdf), price, int(pdf["seg_start"].iloc[0]))
    return pdf[_CARRIED].assign(price_cents=price, state=state, seg=pdf["seg"].to_numpy(), end_left=left)


def _transition_carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """The carried run of one segment as a function over [0, domain), as pieces."""
    pdf = _ordered(pdf)
    q = _quantities(pdf)
    q = np.where(q * int(pdf["price_cents"].iloc[0]) > MAX_CENTS, 0, q)
    starts, offsets = transition(q, int(pdf["domain"].iloc[0]))
    return pd.DataFrame({"uniform_id": [pdf["uniform_id"].iloc[0]], "seg": [pdf["seg"].iloc[0]],
                         "f_starts": [starts.tolist()], "f_offsets": [offsets.tolist()]})


def _rows(pdf: pd.DataFrame):
    pdf = pdf.sort_values("idx")
    fs = [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))
          for a, b in zip(pdf["f_starts"], pdf["f_offsets"])]
    return pdf, fs


def _compose_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of at most B consecutive segment functions of an item, composed in order."""
    pdf, fs = _rows(pdf)
    domain = int(pdf["domain"].iloc[0])
    acc = fs[0]
    for f in fs[1:]:
        acc = compose(acc, f, domain)
    return pd.DataFrame({"uniform_id": [int(pdf["uniform_id"].iloc[0])], "idx": [int(pdf["blk"].iloc[0])],
                         "f_starts": [acc[0].tolist()], "f_offsets": [acc[1].tolist()],
                         "domain": [domain], "boundary_end": [int(pdf["boundary_end"].iloc[0])]})


def _chain_starts(pdf: pd.DataFrame, first: int) -> pd.DataFrame:
    pdf, fs = _rows(pdf)
    left, out = first, []
    for f in fs:
        out.append(left)
        left = apply_at(f, left)
    return pd.DataFrame({"uniform_id": pdf["uniform_id"].astype("int64").to_numpy(),
                         "idx": pdf["idx"].astype("int64").to_numpy(), "start": out})


def _top_starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Top level of an item (at most B functions): starting stock of each, from the boundary's end."""
    return _chain_starts(pdf, int(pdf["boundary_end"].iloc[0]))


def _block_starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: starting stock of each of its functions, from the block's known start."""
    return _chain_starts(pdf, int(pdf["blk_start"].iloc[0]))


def _segment_starts(funcs: DataFrame, live: DataFrame, block: int, widest: int) -> DataFrame:
    """Starting stock of every later segment: a blockwise prefix composition, so no Python group
    ever holds more than ``block`` segment functions, however many segments a hot item spans.

    An item's later segments have consecutive ids (the range partitioning orders by item first), so
    a segment's index within its item is ``seg - first_seg``. Functions are composed in blocks of
    ``block`` consecutive indices, level after level, until every item has at most ``block``
    blocks; the top level is evaluated from the boundary's stock, then block starts are pushed back
    down level by level. ``widest`` bounds the segments of any one item.
    """
    first = live.groupBy("uniform_id").agg(F.min("seg").alias("first_seg"))
    level = (funcs.join(live, ["uniform_id", "seg"]).join(first, "uniform_id")
                  .select("uniform_id", (F.col("seg") - F.col("first_seg")).cast("bigint").alias("idx"),
                          "f_starts", "f_offsets", (F.col("boundary_end") + 1).alias("domain"),
                          "boundary_end"))
    # ``widest`` bounds the segments of any item; each level above divides it by ``block``.
    lower_levels = []
    while widest > block:
        lower_levels.append(level)
        level = (level.withColumn("blk", F.floor(F.col("idx") / block).cast("bigint"))
                      .groupBy("uniform_id", "blk").applyInPandas(_compose_block, _LEVEL))
        widest = -(-widest // block)
    starts = level.groupBy("uniform_id").applyInPandas(_top_starts, _IDX_START)
    for lower in reversed(lower_levels):
        known = starts.select("uniform_id", F.col("idx").alias("blk"), F.col("start").alias("blk_start"))
        starts = (lower.withColumn("blk", F.floor(F.col("idx") / block).cast("bigint"))
                       .join(known, ["uniform_id", "blk"])
                       .groupBy("uniform_id", "blk").applyInPandas(_block_starts, _IDX_START))
    return starts.join(first, "uniform_id").select(
        "uniform_id", (F.col("idx") + F.col("first_seg")).cast("int").alias("seg"),
        F.col("start").alias("seg_start"))


def _prefix_sums(df: DataFrame, value: str, out: str, block: int, widest: int,
                 depth: int = 0) -> DataFrame:
    """Per item, the sum of ``value`` over all earlier ``idx`` (0 for the first), as column ``out``.

    A blockwise prefix: running sums inside blocks of ``block`` consecutive indices, block totals
    summed the same way one level up, so no window partition holds more than ``block`` rows.
    ``widest`` bounds the rows of any one item.
    """
    if widest <= block:
        w = Window.partitionBy("uniform_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    blk, inside, total, offset = (f"_{name}{depth}" for name in ("blk", "in", "total", "off"))
    blocked = df.withColumn(blk, F.floor(F.col("idx") / block).cast("bigint"))
    inner = Window.partitionBy("uniform_id", blk).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn(inside, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    upper = (blocked.groupBy("uniform_id", blk).agg(F.sum(value).alias(total))
                    .select("uniform_id", F.col(blk).alias("idx"), total))
    offsets = _prefix_sums(upper, total, offset, block, -(-widest // block), depth + 1).select(
        "uniform_id", F.col("idx").alias(blk), offset)
    return (within.join(offsets, ["uniform_id", blk])
                  .withColumn(out, F.col(offset) + F.col(inside))
                  .drop(blk, inside, offset))


def _from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast(MONEY)


def _segment_count(requests: DataFrame, rows_per_segment: int) -> int:
    spark = requests.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = requests.count()
    return max(base, math.ceil(n / max(1, rows_per_segment)), 1)


def issue_uniforms(items: DataFrame, requests: DataFrame, issues: DataFrame | None = None, *,
                   segments: int | None = None, rows_per_segment: int = 1_000_000, block: int = 1024) -> IssueResult:
    """Apply issue requests to item stock with the reference's check-then-act rule, for all items.

    With ``issues`` (the table so far) new rows get keys that follow its largest, in the order of the
    requests, and ``IssueResult.table`` is its new version; without it, the request's id is the key.
    A line whose total does not fit the money type is refused and uses no stock.
    """
    ensure_checkpoint_dir(items.sparkSession)
    req = conform(requests, schemas.ISSUE_REQUESTS)
    # A missing stock compares as 0 (PHP: quantity > null holds for any quantity >= 1).
    heads = items.select(
        "uniform_id", F.lit(0).alias("is_request"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("date_issued", "date"), ("request_id", "bigint"), ("student_id", "bigint"), ("quantity", "int"),
            ("amount_cents", "bigint"))),
        F.coalesce(F.col("quantity_in_stock"), F.lit(0)).cast("bigint").alias("opening"),
        (F.col("price") * 100).cast("bigint").alias("price_cents"))
    asked = req.select("uniform_id", F.lit(1).alias("is_request"), *ORDER,
                       (F.col("amount_paid") * 100).cast("bigint").alias("amount_cents"),
                       F.lit(None).cast("bigint").alias("opening"), F.lit(None).cast("bigint").alias("price_cents"))
    # Sized from all requests.
    n_seg = segments or _segment_count(req, rows_per_segment)
    key = ["uniform_id", "is_request", *ORDER]
    out = (heads.unionByName(asked).repartitionByRange(n_seg, *[F.col(k).asc_nulls_first() for k in key])
                .mapInPandas(_fold_partition, _DECIDED).checkpoint(eager=True))

    # The carried runs, with the price and the stock that the item's first segment hands on.
    # Handed on to segments (one carried run each) and joined on these, so no join hashes a hot item's requests.
    opened = out.filter(F.col("state") == OPEN)
    handed = out.filter(F.col("state") == HEAD).select("uniform_id", "price_cents", F.col("end_left").alias("opening"))
    of_segment = staged(opened.select("uniform_id", "seg").distinct().join(handed, "uniform_id", "left").drop("uniform_id"))
    joined = opened.drop("price_cents", "state", "end_left").join(of_segment, "seg", "left")
    unknown = joined.filter(F.col("opening").isNull())
    carried = joined.filter(F.col("opening").isNotNull())
    usable = F.when((F.col("quantity") >= 1) & (F.col("quantity") * F.col("price_cents") <= MAX_CENTS), F.col("quantity"))
    totals = carried.groupBy("uniform_id", "seg").agg(F.coalesce(F.sum(usable), F.lit(0)).alias("q_seg"),
                                                      F.first("opening").alias("opening")).checkpoint(eager=True)
    first = totals.groupBy("uniform_id").agg(F.min("seg").alias("first_seg"))
    indexed = (totals.join(first, "uniform_id")
                     .withColumn("idx", (F.col("seg") - F.col("first_seg")).cast("bigint")))
    cum = _prefix_sums(indexed, "q_seg", "cum_before", block, n_seg)
    cum = cum.withColumn("fits", F.col("cum_before") + F.col("q_seg") <= F.col("opening"))
    bad = cum.groupBy("uniform_id").agg(F.min(F.when(~F.col("fits"), F.col("seg"))).alias("first_bad"))
    summ = (cum.join(bad, "uniform_id")
               .withColumn("kind", F.when(F.col("first_bad").isNull() | (F.col("seg") < F.col("first_bad")),
                                          F.lit("full"))
                                    .when(F.col("seg") == F.col("first_bad"), F.lit("boundary"))
                                    .otherwise(F.lit("after")))
               .withColumn("seg_start", (F.col("opening") - F.col("cum_before")).cast("bigint"))
               .select("uniform_id", "seg", "kind", "seg_start")).checkpoint(eager=True)
    runs = carried.drop("opening").join(summ, ["uniform_id", "seg"])

    # Runs that fit whole, and the boundary runs, start from a known stock.
    known = (runs.filter(F.col("kind") != "after").groupBy("seg").applyInPandas(_fold_carried, _DECIDED)
                 .checkpoint(eager=True))
    boundary = summ.filter(F.col("kind") == "boundary").select("uniform_id", "seg")
    bnd_end = (known.join(boundary, ["uniform_id", "seg"]).groupBy("uniform_id")
                    .agg(F.first("end_left").alias("boundary_end")))

    # Later runs: exact piecewise functions over [0, boundary_end], composed blockwise.
    live = (summ.filter(F.col("kind") == "after").select("uniform_id", "seg")
                .join(bnd_end, "uniform_id").checkpoint(eager=True))
    after = runs.filter(F.col("kind") == "after").drop("kind", "seg_start")
    funcs = (after.join(live.withColumn("domain", F.col("boundary_end") + 1), ["uniform_id", "seg"])
                  .groupBy("seg").applyInPandas(_transition_carried, _TRANSITION_OUT))
    starts = _segment_starts(funcs, live, block, n_seg)
    later = after.join(starts, ["uniform_id", "seg"]).groupBy("seg").applyInPandas(_fold_carried, _DECIDED)

    columns = [*_CARRIED, "price_cents", "state"]
    decided = (out.filter(~F.col("state").isin(OPEN, HEAD)).select(*columns)
               .unionByName(unknown.select(*_CARRIED, "price_cents", F.lit(UNKNOWN).alias("state")))
               .unionByName(known.select(*columns)).unionByName(later.select(*columns)))
    accepted = (decided.filter(F.col("state") == ACCEPTED)
                       .select(F.col("request_id").alias("issue_key"), "student_id", "uniform_id", "quantity",
                               _from_cents(F.col("price_cents") * F.col("quantity")).alias("total_price"),
                               _from_cents(F.col("amount_cents")).alias("amount_paid"), "date_issued"))
    issued, table = accepted, None
    if issues is not None:
        top = issues.agg(F.coalesce(F.max("issue_key"), F.lit(0)).cast("bigint")).scalar()
        issued = (numbered(accepted, ["issue_key", "date_issued", "student_id", "uniform_id", "quantity"], "_pos").withColumn("issue_key", top + F.col("_pos")).drop("_pos"))
        table = issues.unionByName(conform(issued, schemas.UNIFORM_ISSUES))
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), F.col("state"))
    rejects = decided.filter(F.col("state") != ACCEPTED).select("request_id", "uniform_id", reason.alias("reject_reason"))
    used = accepted.groupBy("uniform_id").agg(F.sum("quantity").alias("_used"))
    new_items = (items.join(used, "uniform_id", "left")
                      .withColumn("quantity_in_stock",
                                  (F.col("quantity_in_stock") - F.coalesce(F.col("_used"), F.lit(0))).cast("int"))
                      .select(*items.columns))
    return IssueResult(conform(issued, schemas.UNIFORM_ISSUES), rejects, new_items, table)
