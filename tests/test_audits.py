from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from bursar.operators import audits


def test_audits_find_violations(school, make):
    d = school["discounts"].unionByName(make("fee_discounts", [
        {"discount_id": 9, "student_id": 42, "term_id": 2, "discount_amount": D("1"), "approved_by": "H"},
        {"discount_id": 10, "student_id": 1, "term_id": 7, "discount_amount": D("1"), "approved_by": "H"}]))
    rows = {r["discount_id"]: r["violation"] for r in
            audits.orphan_discounts(d, school["students"], school["terms"]).collect()}
    assert rows == {9: "unknown_student", 10: "unknown_term"}

    s = school["students"].unionByName(school["students"].filter("student_id = 1")
                                       .withColumn("student_id", F.lit(77).cast("long")))
    dup = audits.duplicate_admissions(s).collect()
    assert [(r["admission_key"], r["occurrences"]) for r in dup] == [("ub-001", 2)]

    t = school["terms"].withColumn("is_current", F.lit(1))
    chk = audits.current_term_check(t).collect()[0]
    assert (chk["current_terms"], chk["term_used"], chk["ok"]) == (2, 1, False)
    assert audits.duplicate_terms(t.unionByName(t)).count() == 2
    assert audits.current_term_label(t).collect()[0]["term_label"] == "Term 1, 2024"
    none = audits.current_term_label(t.withColumn("is_current", F.lit(0))).collect()[0]
    assert none["term_label"] == "No term set"

    b = audits.boarding_fee_check(school["boarding"].limit(0)).collect()[0]
    assert (b["rows"], b["amount_used"], b["ok"]) == (0, D("0.00"), False)
