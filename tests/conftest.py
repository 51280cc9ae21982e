from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bursar.session import get_session  # noqa: E402
from bursar.sources import schemas  # noqa: E402
from tests.days import day  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4, app_name="bursar-tests")
    yield s


D = Decimal


@pytest.fixture
def make(spark):
    """make(table_name_or_schema, rows): a DataFrame with the declared schema (rows as dicts)."""
    def _make(schema, rows):
        st = schemas.TABLES[schema] if isinstance(schema, str) else schema
        tuples = [tuple(r.get(f.name) for f in st.fields) for r in rows]
        return spark.createDataFrame(tuples, st)
    return _make


@pytest.fixture
def school(make):
    """A tiny school: 3 classes (one empty), 6 students, 2 terms (t2 current)."""
    classes = make("classes", [
        {"class_id": 1, "class_name": "Baby Class", "section": "Nursery", "term_fee": D("80000")},
        {"class_id": 2, "class_name": "P.1", "section": "Lower Primary", "term_fee": D("90000")},
        {"class_id": 3, "class_name": "P.7", "section": "Upper Primary", "term_fee": D("90000")},
    ])
    students = make("students", [
        {"student_id": 1, "admission_number": "UB-001", "full_name": "Amina Nakato", "gender": "Female",
         "class_id": 1, "is_boarder": 0, "status": "Active"},
        {"student_id": 2, "admission_number": "UB-002", "full_name": "brian Okello", "gender": "Male",
         "class_id": 1, "is_boarder": 1, "status": "Active"},
        {"student_id": 3, "admission_number": "UB-003", "full_name": "Carol 100%_done", "gender": "Female",
         "class_id": 2, "is_boarder": 0, "status": "Active"},
        {"student_id": 4, "admission_number": "UB-004", "full_name": "Dan Graduate", "gender": "Male",
         "class_id": 2, "is_boarder": 0, "status": "Graduated"},
        {"student_id": 5, "admission_number": "UB-005", "full_name": "Eve Orphan", "gender": "Female",
         "class_id": 99, "is_boarder": 0, "status": "Active"},
        {"student_id": 6, "admission_number": "0", "full_name": "Zed Zero", "gender": "Male",
         "class_id": 2, "is_boarder": 0, "status": "Active"},
    ])
    terms = make("academic_terms", [
        {"term_id": 1, "academic_year": 2024, "term_number": 1, "is_current": 0},
        {"term_id": 2, "academic_year": 2024, "term_number": 2, "is_current": 1},
    ])
    payments = make("fee_payments", [
        # student 1: pays 80,000 exactly (two payments) -> balance 0
        {"payment_id": 1, "student_id": 1, "term_id": 2, "amount_paid": D("50000"), "date_paid": day("2024-05-02")},
        {"payment_id": 2, "student_id": 1, "term_id": 2, "amount_paid": D("30000"), "date_paid": day("2024-05-03")},
        # student 2 (boarder, 350,000): pays 100,000 -> owes 250,000 - discount
        {"payment_id": 3, "student_id": 2, "term_id": 2, "amount_paid": D("100000"), "date_paid": day("2024-05-04")},
        # student 3 overpays
        {"payment_id": 4, "student_id": 3, "term_id": 2, "amount_paid": D("95000"), "date_paid": day("2024-05-05")},
        # an old-term payment must not count for the current term
        {"payment_id": 5, "student_id": 6, "term_id": 1, "amount_paid": D("90000"), "date_paid": day("2024-02-01")},
        # the graduate pays
        {"payment_id": 6, "student_id": 4, "term_id": 2, "amount_paid": D("1000"), "date_paid": day("2024-05-06")},
    ])
    discounts = make("fee_discounts", [
        {"discount_id": 1, "student_id": 2, "term_id": 2, "discount_amount": D("50000"), "approved_by": "Head"},
        {"discount_id": 2, "student_id": 2, "term_id": 2, "discount_amount": D("10000"), "approved_by": "Head"},
        {"discount_id": 3, "student_id": 6, "term_id": 1, "discount_amount": D("5000"), "approved_by": "Head"},
    ])
    boarding = make("boarding_fee", [{"amount": D("350000")}])
    items = make("uniform_items", [
        {"uniform_id": 1, "item_name": "Sweater", "applicable_section": "All", "applicable_gender": "All",
         "price": D("25000"), "quantity_in_stock": 3},
        {"uniform_id": 2, "item_name": "Dress", "applicable_section": "Nursery", "applicable_gender": "Female",
         "price": D("30000"), "quantity_in_stock": 0},
        {"uniform_id": 3, "item_name": "Shorts", "applicable_section": "All", "applicable_gender": "Male",
         "price": D("15000"), "quantity_in_stock": 10},
        {"uniform_id": 4, "item_name": "Sweater", "applicable_section": "Upper Primary", "applicable_gender": "All",
         "price": D("26000"), "quantity_in_stock": 6},
    ])
    issues = make("uniform_issues", [
        {"issue_key": 1, "student_id": 1, "uniform_id": 1, "quantity": 2, "total_price": D("50000"),
         "amount_paid": D("40000"), "date_issued": day("2024-05-01")},
        {"issue_key": 2, "student_id": 2, "uniform_id": 3, "quantity": 1, "total_price": D("15000"),
         "amount_paid": D("20000"), "date_issued": day("2024-05-02")},
    ])
    return dict(classes=classes, students=students, terms=terms, payments=payments, discounts=discounts,
                boarding=boarding, items=items, issues=issues)
