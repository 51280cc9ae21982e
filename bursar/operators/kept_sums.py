"""A5/A6 and the core balance from stored sums that change sets keep up to date.

Sums per student and term are stored once. A change set moves them by signed deltas: what was taken out of
the table counts negative, what came in positive. The deltas need the old rows of the touched keys only, which the
keys' lookup reads; payments are not summed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.operators.balances import BALANCE_COLUMNS, roster, term_and_boarding, with_balance
from bursar.operators.staging import staged
from bursar.sources.schemas import TOTAL_MONEY

KEYS = ["student_id", "term_id"]


def stored_sums(rows: DataFrame, amount: str) -> DataFrame:
    """student_id, term_id, total, n: the sums to store, of all rows."""
    return rows.groupBy(*KEYS).agg(F.sum(amount).cast(TOTAL_MONEY).alias("total"), F.count(F.lit(1)).alias("n"))


def row_changes(before: DataFrame, after: DataFrame, touched: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows out, rows in): the rows of the ``touched`` keys (one column) in both versions of a table.

    The keys are written first, so that their size is known: up to the broadcast threshold they meet the versions where
    these lie.
    """
    keys = staged(touched.select(key).distinct())
    return before.join(keys, key, "left_semi"), after.join(keys, key, "left_semi")


def deltas(out: DataFrame, into: DataFrame, amount: str) -> DataFrame:
    """student_id, term_id, total, n: how rows that went and rows that came move the sums."""
    moves = (out.select(*KEYS, (-F.col(amount)).alias("amount"), F.lit(-1).alias("one"))
             .unionByName(into.select(*KEYS, F.col(amount).alias("amount"), F.lit(1).alias("one"))))
    return moves.groupBy(*KEYS).agg(F.sum("amount").cast(TOTAL_MONEY).alias("total"), F.sum("one").alias("n"))


def merged_sums(stored: DataFrame, moved: DataFrame) -> DataFrame:
    """The stored sums after a change set; a group without rows left goes."""
    both = stored.unionByName(moved).groupBy(*KEYS).agg(F.sum("total").cast(TOTAL_MONEY).alias("total"), F.sum("n").alias("n"))
    return both.filter("n <> 0")


def balances_from_sums(students: DataFrame, classes: DataFrame, payment_sums: DataFrame, discount_sums: DataFrame,
                       terms: DataFrame, boarding_fee: DataFrame) -> DataFrame:
    """The core balances (``balances.term_balances``) from stored sums: payments and discounts are not read."""
    term_id, board = term_and_boarding(terms, boarding_fee)
    people = roster(students, classes, True).filter(term_id.isNotNull())
    of_term = lambda sums, name: sums.filter(F.col("term_id") == term_id).select("student_id", F.col("total").alias(name))
    out = (people.join(of_term(discount_sums, "discount"), "student_id", "left")
                 .join(of_term(payment_sums, "total_paid"), "student_id", "left").withColumn("term_id", term_id))
    return with_balance(out, board).select(*BALANCE_COLUMNS)
