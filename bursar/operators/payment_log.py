"""M4, M5 and M6 as one log: payments recorded, edited and deleted in the order of their arrival.

A payment of the log can be edited and deleted later in the same log. A payment exists from its recording (the
table's: from the start) to its first deletion after that, and keys are never used again, so one key's history
is three positions in the log: born, last valid edit before the end, end. All three are minima and maxima, which combine
before any shuffle: no payment's commands are gathered, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import php_trim, receipt_number
from bursar.operators.changes import PAYMENT_EDIT_COLUMNS, POSITION, Applied, _bad_amount, _present, _reason, _replace, _split
from bursar.operators.numbering import numbered
from bursar.operators.staging import staged
from bursar.sources import schemas
from bursar.sources.tables import conform

RECORD, EDIT, DELETE = "record", "edit", "delete"


def apply_payment_log(payments: DataFrame, log: DataFrame, today: str | None = None) -> Applied:
    """The table after the log, and rejects (seq, action, payment_id, reject_reason).

    ``record`` and ``edit`` need an amount above 0. Recorded payments get the keys that follow the table's
    largest, in the order of the log; refused ones use none. An edit or delete of a payment that does not exist at
    that moment (not yet, no more, or never) is reported as unknown and changes nothing. Commands with the same ``seq`` have
    positions of their own.
    """
    c = numbered(conform(log, schemas.PAYMENT_LOG), ["seq"], POSITION).withColumn("received_by", php_trim("received_by"))
    action = F.col("action")
    valid, bad = _split(c, _reason((~F.coalesce(action.isin(RECORD, EDIT, DELETE), F.lit(False)), "unknown_action"),
                                   ((action != DELETE) & _bad_amount("amount_paid"), "invalid_amount")))
    top = payments.agg(F.coalesce(F.max("payment_id"), F.lit(0)).cast("bigint")).scalar()
    day = F.to_date(F.lit(today)) if today else F.current_date()
    recorded = staged(numbered(valid.filter(action == RECORD).drop("payment_id"), [POSITION], "_rank")
                      .withColumn("payment_id", top + F.col("_rank"))
                      .withColumn("date_paid", F.coalesce(F.col("date_paid"), day))
                      .withColumn("receipt_number", receipt_number("date_paid", "payment_id")))

    keyed = valid.filter(action != RECORD)
    there = _present(payments, keyed, ["payment_id"]).select("payment_id", F.lit(0).cast("bigint").alias("_born"))
    born = there.unionByName(recorded.select("payment_id", F.col(POSITION).alias("_born")))
    at = F.col(POSITION)
    # Written, so that a payment with very many commands can be split in the joins that follow.
    seen = staged(keyed.join(born, "payment_id", "left").withColumn("_born", F.when(F.col("_born") < at, F.col("_born"))))
    ends = staged(seen.filter((action == DELETE) & F.col("_born").isNotNull()).groupBy("payment_id").agg(F.min(POSITION).alias("_end")))
    lives = seen.join(ends, "payment_id", "left")
    alive = F.col("_born").isNotNull() & (F.col("_end").isNull() | (at <= F.col("_end")))
    edits = (lives.filter((action == EDIT) & alive).groupBy("payment_id")
             .agg(F.max(F.struct(POSITION, *PAYMENT_EDIT_COLUMNS)).alias("_c")).select("payment_id", "_c.*"))
    table = (_replace(payments.unionByName(conform(recorded, schemas.FEE_PAYMENTS)), edits, "payment_id", PAYMENT_EDIT_COLUMNS)
             .join(ends, "payment_id", "left_anti"))
    refused = bad.select("seq", "action", "payment_id", "reject_reason")
    unknown = lives.filter(~alive).select("seq", "action", "payment_id", F.lit("unknown_payment").alias("reject_reason"))
    return Applied(table, refused.unionByName(unknown))
