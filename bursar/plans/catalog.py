"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame, over the fixture tables.

Each entry reads the whole generated tables of ``sf_dir`` (through the fixture views) and runs one
library operator on them; ``bursar.plans.oracle.ORACLE`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bursar.operators import lists, reports, students as stu, uniforms
from bursar.operators.balances import term_balances
from bursar.plans.oracle import (
    DIRECTORY_CLASS, DIRECTORY_SEARCH, ONE_ADMISSION, ONE_CLASS, ONE_PAYMENT, ONE_STUDENT, OUTCOMES, SEARCH_TERM,
)
from bursar.sources.fixtures import Fixture

Query = Callable[[SparkSession, str], DataFrame]


def _bal_args(fx: Fixture):
    return (fx["students"], fx["classes"], fx["fee_payments"], fx["fee_discounts"],
            fx["academic_terms"], fx["boarding_fee"])


def _q(fn: Callable[[Fixture], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Fixture(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


READ_QUERIES: dict[str, Query] = {
    "student_balances": _q(lambda fx: term_balances(*_bal_args(fx))),
    "outstanding_balances": _q(lambda fx: reports.outstanding_balances(*_bal_args(fx))),
    "outstanding_summary": _q(lambda fx: reports.outstanding_summary(*_bal_args(fx))),
    "class_fee_status_owing": _q(lambda fx: reports.class_fee_status_owing(*_bal_args(fx))),
    "class_fee_status_paid_up": _q(lambda fx: reports.class_fee_status_paid_up(*_bal_args(fx))),
    "class_fee_status_counts": _q(lambda fx: reports.class_fee_status_counts(*_bal_args(fx))),
    "fee_collection_summary": _q(lambda fx: reports.fee_collection_summary(
        fx["fee_payments"], fx["academic_terms"])),
    "uniform_sales_summary": _q(lambda fx: reports.uniform_sales_summary(fx["uniform_issues"])),
    "uniform_item_sales": _q(lambda fx: reports.uniform_item_sales(
        fx["uniform_items"], fx["uniform_issues"])),
    "dashboard_stats": _q(lambda fx: reports.dashboard_stats(
        fx["students"], fx["classes"], fx["uniform_items"])),
    "class_counts": _q(lambda fx: stu.class_counts(fx["students"], fx["classes"])),
    "class_counts_total": _q(lambda fx: stu.class_counts_total(fx["students"], fx["classes"])),
    "recent_payments": _q(lambda fx: reports.recent_payments(
        fx["fee_payments"], fx["students"], fx["classes"], fx["fee_discounts"],
        fx["academic_terms"], fx["boarding_fee"])),
    "receipts": _q(lambda fx: reports.receipts(
        fx["fee_payments"], fx["students"], fx["classes"], fx["academic_terms"],
        fx["fee_discounts"], fx["boarding_fee"])),
    "student_statement": _q(lambda fx: reports.student_statement(*_bal_args(fx))),
    "discount_history": _q(lambda fx: reports.discount_history(
        fx["fee_discounts"], fx["academic_terms"])),
    "payment_history": _q(lambda fx: reports.payment_history(fx["fee_payments"], fx["academic_terms"])),
    "uniform_issue_history": _q(lambda fx: uniforms.uniform_issue_history(
        fx["uniform_issues"], fx["uniform_items"])),
    "uniform_stock": _q(lambda fx: uniforms.uniform_stock(fx["uniform_items"])),
    "low_stock_items": _q(lambda fx: uniforms.low_stock_items(fx["uniform_items"])),
    "uniform_eligibility": _q(lambda fx: uniforms.uniform_eligibility(
        fx["students"], fx["classes"], fx["uniform_items"])),
    "uniform_eligibility_counts": _q(lambda fx: uniforms.uniform_eligibility_counts(
        fx["students"], fx["classes"], fx["uniform_items"])),
    "term_list": _q(lambda fx: lists.term_list(fx["academic_terms"])),
    "fee_default_list": _q(lambda fx: lists.fee_default_list(fx["fee_defaults"])),
    "staff_roster": _q(lambda fx: lists.staff_roster(fx["users"])),
    "class_list": _q(lambda fx: lists.class_list(fx["classes"])),
    "student_search": _q(lambda fx: stu.student_search(fx["students"], fx["classes"], SEARCH_TERM)),
    "student_search_outcome": _q(lambda fx: stu.student_search_outcome(
        fx["students"], fx["classes"], SEARCH_TERM)),
    "student_directory": _q(lambda fx: stu.student_directory(
        fx["students"], fx["classes"], DIRECTORY_SEARCH, DIRECTORY_CLASS)),
}


def all_queries() -> dict[str, Query]:
    from bursar.plans.changes_catalog import CHANGE_QUERIES
    from bursar.plans.log_catalog import LOG_QUERIES
    return {**READ_QUERIES, **CHANGE_QUERIES, **LOG_QUERIES}


def all_oracles() -> dict[str, str]:
    from bursar.plans.changes_catalog import CHANGE_ORACLE
    from bursar.plans.log_catalog import LOG_ORACLE
    from bursar.plans.oracle import ORACLE
    return {**ORACLE, **CHANGE_ORACLE, **LOG_ORACLE}


def _audits():
    from bursar.operators import audits
    return {
        "audit_orphan_discounts": _q(lambda fx: audits.orphan_discounts(
            fx["fee_discounts"], fx["students"], fx["academic_terms"])),
        "audit_duplicate_admissions": _q(lambda fx: audits.duplicate_admissions(fx["students"])),
        "audit_duplicate_terms": _q(lambda fx: audits.duplicate_terms(fx["academic_terms"])),
        "audit_current_term": _q(lambda fx: audits.current_term_check(fx["academic_terms"])),
        "current_term_label": _q(lambda fx: audits.current_term_label(fx["academic_terms"])),
    }


READ_QUERIES.update(_audits())


def _pages():
    """The forms of the pages that show one student, one class or one payment."""
    statuses = {f"class_fee_status_{kind}_class": _q(lambda fx, f=f: f(*_bal_args(fx), class_id=ONE_CLASS))
                for kind, f in (("owing", reports.class_fee_status_owing), ("paid_up", reports.class_fee_status_paid_up))}
    outcomes = {f"student_search_outcome_{name}": _q(lambda fx, n=number, t=term: stu.student_search_outcome(
        fx["students"], fx["classes"], t, n)) for name, (number, term) in OUTCOMES.items()}
    return statuses | outcomes | {
        "student_lookup": _q(lambda fx: stu.student_lookup(fx["students"], fx["classes"], ONE_ADMISSION)),
        "student_statement_one": _q(lambda fx: reports.student_statement(*_bal_args(fx), admission_number=ONE_ADMISSION)),
        "receipt_one": _q(lambda fx: reports.receipts(
            fx["fee_payments"], fx["students"], fx["classes"], fx["academic_terms"], fx["fee_discounts"],
            fx["boarding_fee"], payment_id=ONE_PAYMENT)),
        "payment_history_one": _q(lambda fx: reports.payment_history(
            fx["fee_payments"], fx["academic_terms"], ONE_STUDENT)),
        "discount_history_one": _q(lambda fx: reports.discount_history(
            fx["fee_discounts"], fx["academic_terms"], ONE_STUDENT)),
        "uniform_issue_history_one": _q(lambda fx: uniforms.uniform_issue_history(
            fx["uniform_issues"], fx["uniform_items"], ONE_STUDENT)),
        "eligible_items_for_class": _q(lambda fx: uniforms.eligible_items_for(
            fx["students"].filter(f"class_id = {ONE_CLASS}"), fx["classes"], fx["uniform_items"])),
        "statement_display": _q(lambda fx: reports.statement_display(
            reports.student_statement(*_bal_args(fx)), fx["students"])),
        "report_term_label": _q(lambda fx: reports.report_term_label(fx["academic_terms"])),
    }


READ_QUERIES.update(_pages())
