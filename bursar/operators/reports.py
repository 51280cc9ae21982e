"""Fee reports: outstanding lists, class status, dashboard, receipts, statements and histories.

All are whole-population DataFrames; per-student pages of the reference are a filter on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import (
    ACTIVE, LOW_STOCK_LIMIT, NO_CURRENT_TERM_LABEL, NOT_AVAILABLE, PHP_TRIM_CHARS, class_label, falsy_default,
    first_name, money, money_text, php_int, short_term_label, sum_or_zero, term_label, text_key, total_money, yes_no,
)
from bursar.operators.balances import (
    boarding_amount, current_term_id, roster, sums_by_student, sums_by_student_term,
    term_and_boarding, term_balances, with_balance,
)
from bursar.sources.schemas import RESULT_MONEY


def outstanding_balances(students, classes, payments, discounts, terms, boarding_fee) -> DataFrame:
    """Reports page: active students still owing this term (balance > 0, strictly), by class, name."""
    core = term_balances(students, classes, payments, discounts, terms, boarding_fee)
    return (core.filter(F.col("balance") > 0)
                .orderBy("class_id", text_key("full_name"), "full_name", "student_id"))


def outstanding_summary(students, classes, payments, discounts, terms, boarding_fee) -> DataFrame:
    """Total still owed and head-count; overpayments do not offset debts. Always one row."""
    owing = outstanding_balances(students, classes, payments, discounts, terms, boarding_fee)
    return owing.agg(sum_or_zero("balance").alias("total_outstanding"),
                     F.count(F.lit(1)).alias("owing_count"))


def fee_collection_summary(payments: DataFrame, terms: DataFrame) -> DataFrame:
    """A7/A8 in one scan: collected in the current term (0 without one) and all-time. One row."""
    term_id = current_term_id(terms)
    in_term = F.when(F.col("term_id") == term_id, F.col("amount_paid"))
    return payments.agg(sum_or_zero(in_term).alias("collected_term"),
                        sum_or_zero("amount_paid").alias("collected_all"))


def uniform_sales_summary(issues: DataFrame) -> DataFrame:
    """Items sold, value, collected and still owed, over all issues. One row."""
    totals = issues.agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_items_sold"),
                        sum_or_zero("total_price").alias("total_value"),
                        sum_or_zero("amount_paid").alias("total_collected"))
    return totals.withColumn("balance_owed", total_money(F.col("total_value") - F.col("total_collected")))


def uniform_item_sales(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Quantity and revenue per item, never-issued items as 0; by revenue desc.

    Issues are aggregated per item *before* the join (the reference joins then groups), so the join
    sees one row per item whatever the issue volume; grouped by id, equal names stay separate.
    """
    per_item = issues.groupBy("uniform_id").agg(F.sum("quantity").alias("qty"),
                                                F.sum("total_price").alias("rev"))
    return (items.select("uniform_id", "item_name")
                 .join(per_item, "uniform_id", "left")
                 .select("uniform_id", "item_name",
                         F.coalesce("qty", F.lit(0)).cast("bigint").alias("qty_sold"),
                         total_money(F.coalesce("rev", F.lit(0))).alias("revenue"))
                 .orderBy(F.desc("revenue"), "uniform_id"))


#: The largest page of recent payments.
MAX_PAGE = 1000

STATUS_COLUMNS = ["class_id", "student_id", "admission_number", "full_name", "is_boarder",
                  "gross_fee", "discount", "has_discount", "total_due", "total_paid", "balance"]


def _class_status(students, classes, payments, discounts, terms, boarding_fee,
                  class_id: int | None) -> DataFrame:
    core = term_balances(students, classes, payments, discounts, terms, boarding_fee)
    if class_id is not None:
        # class 0 means "none selected" (PHP truthiness) -> nothing.
        core = core.filter(F.col("class_id") == F.lit(class_id)) if class_id else core.limit(0)
    return core


def class_fee_status_owing(students, classes, payments, discounts, terms, boarding_fee,
                           class_id: int | None = None) -> DataFrame:
    """Class fee-status page, owing list: per class, highest balance first, then name."""
    core = _class_status(students, classes, payments, discounts, terms, boarding_fee, class_id)
    return (core.filter(F.col("balance") > 0).select(*STATUS_COLUMNS)
                .orderBy("class_id", F.desc("balance"), text_key("full_name"), "full_name", "student_id"))


def class_fee_status_paid_up(students, classes, payments, discounts, terms, boarding_fee,
                             class_id: int | None = None) -> DataFrame:
    """Paid-up list (balance <= 0, overpaid included); shown balance is the literal 0."""
    core = _class_status(students, classes, payments, discounts, terms, boarding_fee, class_id)
    return (core.filter(F.col("balance") <= 0).select(*STATUS_COLUMNS)
                .withColumn("shown_balance", money(F.greatest(F.col("balance"), F.lit(0))))
                .orderBy("class_id", text_key("full_name"), "full_name", "student_id"))


def class_fee_status_counts(students, classes, payments, discounts, terms, boarding_fee) -> DataFrame:
    """Paid-up and owing head-counts per class, one pass; classes without students give 0, 0."""
    core = term_balances(students, classes, payments, discounts, terms, boarding_fee)
    counts = core.groupBy("class_id").agg(
        F.count_if(F.col("balance") <= 0).alias("paid_up_count"),
        F.count_if(F.col("balance") > 0).alias("owing_count"))
    return (classes.select("class_id", "class_name", "section")
                   .join(counts, "class_id", "left")
                   .select("class_id", "class_name", "section",
                           F.coalesce("paid_up_count", F.lit(0)).cast("bigint").alias("paid_up_count"),
                           F.coalesce("owing_count", F.lit(0)).cast("bigint").alias("owing_count"))
                   .orderBy("class_id"))


def dashboard_stats(students: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """The dashboard's five counts; one scan per table instead of five queries.

    Each table collapses to one row; the one-row results are combined through scalar subqueries.
    """
    active = F.col("status") == ACTIVE
    s = students.agg(F.count_if(active).alias("total_students"),
                     F.count_if(active & (F.col("is_boarder") == 1)).alias("total_boarders"),
                     F.count_if(active & (F.col("is_boarder") == 0)).alias("total_day"))
    n_classes = classes.agg(F.count(F.lit(1))).scalar()
    low = items.agg(F.count_if(F.col("quantity_in_stock") <= LOW_STOCK_LIMIT)).scalar()
    return s.select(F.col("total_students").cast("bigint"), F.col("total_boarders").cast("bigint"),
                    F.col("total_day").cast("bigint"),
                    n_classes.cast("bigint").alias("total_classes"),
                    low.cast("bigint").alias("low_stock_items"))


#: How many keys below the newest a page of one row looks at first, and how much further each time that is not enough.
RECENT_KEYS, FURTHER = 16, 16


def newest_joined(payments, students, classes, n: int, bounds: tuple[int, int] | None = None) -> DataFrame:
    """The n payments with the largest keys that have a student and a class row, newest first.

    Read from the newest keys down: the range of keys, a literal that reaches the scan, grows until it holds n such payments
    or the whole table. Of a table written in the order of its keys only the newest row groups are read. ``bounds`` are the
    smallest and largest key (``sources.tables.key_bounds`` has them from the files' footers); without them the key
    column alone is scanned for them.
    """
    low, high = bounds or payments.agg(F.min("payment_id"), F.max("payment_id")).first()
    people = (students.select("student_id", "full_name", "is_boarder", "class_id")
              .join(classes.select("class_id", "class_name", "term_fee"), "class_id"))
    slim = payments.select("payment_id", "student_id", "amount_paid", "date_paid", "receipt_number")
    width = RECENT_KEYS * n
    while True:
        some = slim if high is None else slim.filter(F.col("payment_id") > F.lit(high - width))
        joined = some.join(people, "student_id").orderBy(F.desc("payment_id")).limit(n)
        rows = joined.collect()  # n is a page size
        if len(rows) == n or high is None or high - width < low:
            return payments.sparkSession.createDataFrame(rows, joined.schema)
        width *= FURTHER


def recent_payments(payments, students, classes, discounts, terms, boarding_fee, n: int = 5,
                    bounds: tuple[int, int] | None = None) -> DataFrame:
    """Dashboard: the n latest payments (by payment_id) of any student/term, with that student's
    *current-term* balance, arranged by class order (ties keep newest first).

    Payments without a student or class row drop out. ``n`` is a page size, at most ``MAX_PAGE``. The n rows are
    fetched (``newest_joined``), and their student ids narrow the payment and discount scans as literals, so only these
    rows are summed.
    """
    if not 0 < n <= MAX_PAGE:
        raise ValueError(f"n must be between 1 and {MAX_PAGE}")
    term_id, board = term_and_boarding(terms, boarding_fee)
    top = newest_joined(payments, students, classes, n, bounds)
    ids = [r.student_id for r in top.select("student_id").distinct().collect()]
    mine = F.col("student_id").isin(ids)
    disc = sums_by_student(discounts.filter(mine), "discount_amount", "discount", term_id)
    paid = sums_by_student(payments.filter(mine), "amount_paid", "total_paid", term_id)
    out = with_balance(top.join(F.broadcast(disc), "student_id", "left")  # n rows at most on either side
                          .join(F.broadcast(paid), "student_id", "left"), board)
    return (out.select("payment_id", "student_id", "full_name", "class_id", "class_name", "is_boarder",
                       money("amount_paid").alias("amount_paid"), "date_paid", "receipt_number",
                       "balance")
               .orderBy("class_id", F.desc("payment_id")))


def receipts(payments, students, classes, terms, discounts, boarding_fee,
             payment_id: int | None = None) -> DataFrame:
    """Receipt page for every payment (or one ``payment_id``): discount and paid totals are for the
    *payment's* term (all of that term's payments, later ones included); fee and boarding status are
    as of now.

    Payment and discount totals per (student, term) are joined first, on the keys they are grouped by,
    and then meet the payments once. For one receipt both tables are narrowed to that payment's student
    and term as literals, so the filter reaches the scans and nothing else is summed.
    """
    board = boarding_amount(boarding_fee)
    main, pay_src, disc_src = payments, payments, discounts
    if payment_id is not None:
        main = payments.filter(F.col("payment_id") == F.lit(payment_id))
        of = main.select("student_id", "term_id").first()  # payment_id is the table's key
        mine = ((F.col("student_id") == F.lit(of.student_id)) & (F.col("term_id") == F.lit(of.term_id))) \
            if of else F.lit(False)
        pay_src, disc_src = payments.filter(mine), discounts.filter(mine)
    key = ["student_id", "term_id"]
    sums = (sums_by_student_term(pay_src, "amount_paid", "total_paid")
            .join(sums_by_student_term(disc_src, "discount_amount", "discount"), key, "left"))
    rows = (main.join(students.select("student_id", "full_name", "admission_number", "is_boarder",
                                      "class_id"), "student_id")
                .join(classes.select("class_id", "class_name", "section", "term_fee"), "class_id")
                .join(terms.select("term_id", "term_number", "academic_year"), "term_id")
                .withColumnRenamed("amount_paid", "this_payment")
                .join(sums, key, "left"))
    out = with_balance(rows, board)
    return out.select("payment_id", "receipt_number", "student_id", "admission_number", "full_name",
                      "class_name", "section", "term_id",
                      term_label("term_number", "academic_year").alias("term_label"),
                      money("this_payment").alias("amount_paid"), "payment_method", "received_by",
                      "date_paid", "gross_fee", "discount", "total_due", "total_paid", "balance",
                      "payment_state")


def student_statement(students, classes, payments, discounts, terms, boarding_fee,
                      admission_number: str | None = None) -> DataFrame:
    """Fee payment page totals for every student of any status with a class row (or the one with
    ``admission_number``, trimmed as the page does).

    Needs a current term: without one every total stays 0 (the page's initial values).
    """
    term_id, board = term_and_boarding(terms, boarding_fee)
    people = roster(students, classes, active_only=False)
    if admission_number is not None:
        key = text_key(F.lit(admission_number.strip(PHP_TRIM_CHARS)))
        people = people.filter(text_key("admission_number") == key)
        of = [r.student_id for r in people.select("student_id").limit(MAX_PAGE + 1).collect()]
        if len(of) > MAX_PAGE:  # the admission number is the table's unique key
            raise ValueError(f"over {MAX_PAGE} students have the admission number {admission_number!r}")
        payments, discounts = (t.filter(F.col("student_id").isin(of)) for t in (payments, discounts))
    disc = sums_by_student(discounts, "discount_amount", "discount", term_id)
    paid = sums_by_student(payments, "amount_paid", "total_paid", term_id)
    rows = people.join(disc, "student_id", "left").join(paid, "student_id", "left")
    out = with_balance(rows, board)
    no_term = term_id.isNull()
    zero = F.lit(0).cast(RESULT_MONEY)
    for c in ("gross_fee", "discount", "total_due", "total_paid", "balance"):
        out = out.withColumn(c, F.when(no_term, zero).otherwise(F.col(c)))
    return out.select("student_id", "admission_number", "full_name", "status", "class_id", "class_name",
                      "section", class_label("class_name", "section").alias("class_label"), "is_boarder",
                      "gross_fee", "discount", (F.col("discount") > 0).alias("has_discount"),
                      "total_due", "total_paid", "balance",
                      F.when(F.col("balance") > 0, F.lit("owing")).otherwise(F.lit("paid")).alias("payment_state"))


def statement_display(statement: DataFrame, students: DataFrame) -> DataFrame:
    """The statement as the page prints it (X5-X8, X11): first name, Yes/No, whole amounts with thousands
    separators, the guardian or 'N/A', and the number part of the admission number."""
    shown = statement.join(students.select("student_id", "guardian_name"), "student_id")
    return shown.select("student_id", first_name("full_name").alias("first_name"), yes_no("is_boarder").alias("boarder"),
                        money_text("total_due").alias("total_due_text"), money_text("balance").alias("balance_text"),
                        falsy_default("guardian_name", NOT_AVAILABLE).alias("guardian"),
                        php_int(F.regexp_extract("admission_number", "([^-]*)$", 1)).alias("admission_serial"))


def report_term_label(terms: DataFrame) -> DataFrame:
    """X2 on the reports page: the current term's label, else 'No current term set'. One row."""
    first = terms.filter(F.col("is_current") == 1).agg(
        F.min_by(F.struct("term_number", "academic_year"), F.col("term_id")).alias("t"))
    return first.select(term_label("t.term_number", "t.academic_year", NO_CURRENT_TERM_LABEL).alias("term_label"))


def _for_student(df: DataFrame, student_id: int | None) -> DataFrame:
    return df if student_id is None else df.filter(F.col("student_id") == F.lit(student_id))


def discount_history(discounts: DataFrame, terms: DataFrame, student_id: int | None = None) -> DataFrame:
    """Fee payment page: current-term discounts, one student's newest first, or everyone's unsorted."""
    term_id = current_term_id(terms)
    out = (_for_student(discounts, student_id).filter(F.col("term_id") == term_id)
                     .select("discount_id", "student_id", "term_id",
                             money("discount_amount").alias("discount_amount"), "reason",
                             "approved_by", "date_given"))
    return out if student_id is None else out.orderBy(F.desc("discount_id"))


def payment_history(payments: DataFrame, terms: DataFrame, student_id: int | None = None) -> DataFrame:
    """Payments of every term with the term's short label: one student's newest first, or
    everyone's unsorted (the reference sorts one student's page)."""
    out = (_for_student(payments, student_id).join(terms.select("term_id", "term_number", "academic_year"), "term_id")
                    .select("payment_id", "student_id", "term_id",
                            short_term_label("term_number", "academic_year").alias("term_short"),
                            money("amount_paid").alias("amount_paid"), "payment_method",
                            "received_by", "receipt_number", "date_paid"))
    return out if student_id is None else out.orderBy(F.desc("payment_id"))
