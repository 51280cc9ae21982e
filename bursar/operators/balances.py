"""Term balances: the one formula every fee page turns on.

    gross   = is_boarder ? boarding_fee : classes.term_fee      (boarding replaces the class fee)
    due     = gross - SUM(discounts of the student in the term)  (0 if none)
    balance = due   - SUM(payments of the student in the term)   (0 if none)

The reference runs two queries per student. Here payments and discounts are each aggregated once per
(student[, term]) with map-side partial aggregation (so a student or term holding a large share of
the rows is combined before the shuffle), then left-joined to the roster on student_id. They are
aggregated *separately*: joining both raw tables to students would multiply rows.

The current term and the boarding fee are one-row values (the reference reads each with LIMIT 1
before its main query). They are resolved once, in one small job of two scalar subqueries, and enter
the main plan as literals: the term predicate then reaches the parquet scans of payments and
discounts as a plain literal (row-group skipping, partition pruning on a term-partitioned table), no
cross join is needed, and the small tables are read once per query instead of once per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bursar.functions.formats import ACTIVE, money, payment_state
from bursar.sources.schemas import MONEY


def current_term(terms: DataFrame) -> DataFrame:
    """The current term row (at most one). Several flagged rows: lowest term_id wins."""
    return terms.filter(F.col("is_current") == 1).orderBy("term_id").limit(1)


def current_term_query(terms: DataFrame) -> Column:
    """Current term id as a scalar subquery (null when no term is current)."""
    return terms.filter(F.col("is_current") == 1).agg(F.min("term_id")).scalar()


def boarding_query(boarding_fee: DataFrame) -> Column:
    """The boarding fee as a scalar subquery; 0 when the table is empty (min as tie rule)."""
    return boarding_fee.agg(F.coalesce(F.min("amount"), F.lit(0)).cast(MONEY)).scalar()


def resolve(spark: SparkSession, *scalars: Column) -> list:
    """Evaluate one-row scalar subqueries together, in one small job."""
    return list(spark.range(1).select(*[c.alias(f"v{i}") for i, c in enumerate(scalars)]).first())


def current_term_id(terms: DataFrame) -> Column:
    """Current term id as a literal (null literal when no term is current)."""
    (value,) = resolve(terms.sparkSession, current_term_query(terms))
    return F.lit(value).cast("int")


def boarding_amount(boarding_fee: DataFrame) -> Column:
    """The boarding fee as a literal (0 when the table is empty)."""
    (value,) = resolve(boarding_fee.sparkSession, boarding_query(boarding_fee))
    return F.lit(value).cast(MONEY)


def term_and_boarding(terms: DataFrame, boarding_fee: DataFrame) -> tuple[Column, Column]:
    """Both one-row values in one job, as literals."""
    term_id, board = resolve(terms.sparkSession, current_term_query(terms), boarding_query(boarding_fee))
    return F.lit(term_id).cast("int"), F.lit(board).cast(MONEY)


def is_truthy(col: str) -> Column:
    """PHP truthiness of a 0/1 flag column (null counts as false)."""
    return F.coalesce(F.col(col), F.lit(0)) != 0


def gross_fee(boarding: Column) -> Column:
    """Boarders pay the boarding fee instead of (not on top of) the class fee."""
    return F.when(is_truthy("is_boarder"), boarding).otherwise(F.col("term_fee"))


def sums_by_student(df: DataFrame, amount: str, alias: str, term_id: Column) -> DataFrame:
    """Per-student total of one term (pre-aggregated before any join)."""
    return (df.filter(F.col("term_id") == term_id)
              .groupBy("student_id")
              .agg(F.sum(amount).alias(alias)))


def sums_by_student_term(df: DataFrame, amount: str, alias: str) -> DataFrame:
    """Per (student, term) totals, for pages that use the payment's own term (receipts)."""
    return df.groupBy("student_id", "term_id").agg(F.sum(amount).alias(alias))


def roster(students: DataFrame, classes: DataFrame, active_only: bool) -> DataFrame:
    """J1 (+F3): students with their class; a student whose class row is missing drops out."""
    s = students
    if active_only:
        s = s.filter(F.col("status") == ACTIVE)
    c = classes.select("class_id", "class_name", "section", "term_fee")
    return s.join(c, "class_id")


def with_balance(df: DataFrame, boarding: Column) -> DataFrame:
    """P1-P4, P8 on a frame carrying term_fee, is_boarder, discount and total_paid (nullable sums)."""
    gross = money(gross_fee(boarding))
    discount = money(F.coalesce(F.col("discount"), F.lit(0)))
    paid = money(F.coalesce(F.col("total_paid"), F.lit(0)))
    return (df.withColumns({"gross_fee": gross, "discount": discount, "total_paid": paid})
              .withColumn("total_due", money(F.col("gross_fee") - F.col("discount")))
              .withColumn("balance", money(F.col("total_due") - F.col("total_paid")))
              .withColumn("payment_state", payment_state("balance"))
              .withColumn("has_discount", F.col("discount") > 0))


BALANCE_COLUMNS = ["student_id", "admission_number", "full_name", "class_id", "class_name", "section",
                   "is_boarder", "term_id", "gross_fee", "discount", "has_discount", "total_due",
                   "total_paid", "balance", "payment_state"]


def term_balances(students: DataFrame, classes: DataFrame, payments: DataFrame,
                  discounts: DataFrame, terms: DataFrame, boarding_fee: DataFrame,
                  *, active_only: bool = True) -> DataFrame:
    """Core: balance of every (active) student for the current term.

    No current term gives no rows (the reports and class fee-status pages show nothing then).
    """
    term_id, board = term_and_boarding(terms, boarding_fee)
    people = roster(students, classes, active_only).filter(term_id.isNotNull())
    disc = sums_by_student(discounts, "discount_amount", "discount", term_id)
    paid = sums_by_student(payments, "amount_paid", "total_paid", term_id)
    out = (people.join(disc, "student_id", "left")
                 .join(paid, "student_id", "left")
                 .withColumn("term_id", term_id))
    return with_balance(out, board).select(*BALANCE_COLUMNS)
