from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from bursar.operators import reports
from bursar.operators.balances import term_balances


def _bal(s, **over):
    args = dict(students=s["students"], classes=s["classes"], payments=s["payments"],
                discounts=s["discounts"], terms=s["terms"], boarding_fee=s["boarding"])
    args.update(over)
    return term_balances(**args)


def _by_id(df):
    return {r["student_id"]: r for r in df.collect()}


def test_core_balances(school):
    rows = _by_id(_bal(school))
    # active students with a class row only: 4 (graduate) and 5 (unknown class) are out
    assert set(rows) == {1, 2, 3, 6}
    assert rows[1]["balance"] == D("0.00") and rows[1]["payment_state"] == "paid"
    # boarder: boarding replaces the class fee; two discounts summed, not multiplied with payments
    assert rows[2]["gross_fee"] == D("350000.00")
    assert rows[2]["discount"] == D("60000.00")
    assert rows[2]["total_due"] == D("290000.00")
    assert rows[2]["balance"] == D("190000.00")
    # overpaid counts as paid
    assert rows[3]["balance"] == D("-5000.00") and rows[3]["payment_state"] == "paid"
    # other-term payment and discount ignored
    assert rows[6]["total_paid"] == D("0.00") and rows[6]["discount"] == D("0.00")
    assert rows[6]["balance"] == D("90000.00")


def test_no_current_term_gives_no_rows(school):
    terms = school["terms"].withColumn("is_current", F.lit(0))
    assert _bal(school, terms=terms).count() == 0
    summary = reports.outstanding_summary(school["students"], school["classes"], school["payments"],
                                          school["discounts"], terms, school["boarding"]).collect()
    assert summary[0]["total_outstanding"] == D("0.00") and summary[0]["owing_count"] == 0


def test_two_current_terms_lowest_id_wins(school):
    terms = school["terms"].withColumn("is_current", F.lit(1))
    rows = _by_id(_bal(school, terms=terms))
    assert {r["term_id"] for r in rows.values()} == {1}
    assert rows[6]["total_paid"] == D("90000.00")


def test_missing_boarding_row_counts_as_zero(school):
    empty = school["boarding"].limit(0)
    rows = _by_id(_bal(school, boarding_fee=empty))
    assert rows[2]["gross_fee"] == D("0.00")
    assert rows[2]["balance"] == D("-160000.00")


def test_outstanding_is_strictly_positive_and_summary_adds_up(school):
    args = (school["students"], school["classes"], school["payments"], school["discounts"],
            school["terms"], school["boarding"])
    owing = reports.outstanding_balances(*args).collect()
    assert [r["student_id"] for r in owing] == [2, 6]  # by class, then name
    total = reports.outstanding_summary(*args).collect()[0]
    assert total["total_outstanding"] == sum(r["balance"] for r in owing)
    assert total["owing_count"] == len(owing)


def test_class_status_split_is_complete(school):
    args = (school["students"], school["classes"], school["payments"], school["discounts"],
            school["terms"], school["boarding"])
    owing = reports.class_fee_status_owing(*args).count()
    paid = reports.class_fee_status_paid_up(*args)
    assert owing + paid.count() == _bal(school).count()
    assert all(r["shown_balance"] == D("0.00") for r in paid.collect())
    counts = {r["class_id"]: (r["paid_up_count"], r["owing_count"])
              for r in reports.class_fee_status_counts(*args).collect()}
    assert counts == {1: (1, 1), 2: (1, 1), 3: (0, 0)}
    # class 0 means "none selected"
    assert reports.class_fee_status_owing(*args, class_id=0).count() == 0
    assert reports.class_fee_status_owing(*args, class_id=2).count() == 1


def test_statement_without_term_is_all_zero(school):
    terms = school["terms"].withColumn("is_current", F.lit(0))
    rows = reports.student_statement(school["students"], school["classes"], school["payments"],
                                     school["discounts"], terms, school["boarding"]).collect()
    assert len(rows) == 5  # any status, class row required
    assert all(r["balance"] == D("0.00") and r["gross_fee"] == D("0.00") for r in rows)


def test_receipts_use_the_payments_term(school):
    rows = {r["payment_id"]: r for r in reports.receipts(
        school["payments"], school["students"], school["classes"], school["terms"],
        school["discounts"], school["boarding"]).collect()}
    # payment 5 is for term 1: its 5,000 discount applies, the term-2 data does not
    assert rows[5]["discount"] == D("5000.00") and rows[5]["total_paid"] == D("90000.00")
    assert rows[5]["balance"] == D("-5000.00")
    assert rows[5]["term_label"] == "Term 1, 2024"
    # balance includes every payment of that term (1 and 2 both count on receipt 1)
    assert rows[1]["total_paid"] == D("80000.00")


def test_recent_payments_top_and_order(school):
    rows = reports.recent_payments(school["payments"], school["students"], school["classes"],
                                   school["discounts"], school["terms"], school["boarding"], n=3).collect()
    # top 3 by payment_id among payments whose student has a class: 6, 5, 4 -> sorted by class
    assert [r["payment_id"] for r in rows] == [6, 5, 4]
    assert rows[1]["balance"] == D("90000.00")  # student 6: current-term balance, old payment ignored


def test_recent_payments_skips_orphans_beyond_first_window(school, make):
    orphans = make("fee_payments", [
        {"payment_id": 100 + i, "student_id": 500 + i, "term_id": 2, "amount_paid": D("1")}
        for i in range(100)])  # newest 100 payments belong to no known student
    pays = school["payments"].unionByName(orphans)
    rows = reports.recent_payments(pays, school["students"], school["classes"], school["discounts"],
                                   school["terms"], school["boarding"], n=2).collect()
    assert [r["payment_id"] for r in rows] == [6, 5]


def test_single_entity_pages_equal_filtered_population(school):
    args = (school["payments"], school["students"], school["classes"], school["terms"],
            school["discounts"], school["boarding"])
    everyone = {r["payment_id"]: r for r in reports.receipts(*args).collect()}
    for pid in (1, 3, 5):
        one = reports.receipts(*args, payment_id=pid).collect()
        assert len(one) == 1 and one[0] == everyone[pid]
    assert reports.receipts(*args, payment_id=999).count() == 0

    sargs = (school["students"], school["classes"], school["payments"], school["discounts"],
             school["terms"], school["boarding"])
    all_st = {r["admission_number"]: r for r in reports.student_statement(*sargs).collect()}
    one = reports.student_statement(*sargs, admission_number=" UB-002\t").collect()
    assert len(one) == 1 and one[0] == all_st["UB-002"]

    hist = reports.payment_history(school["payments"], school["terms"], student_id=1).collect()
    assert [r["payment_id"] for r in hist] == [2, 1] and hist[0]["term_short"] == "T2 2024"
    disc = reports.discount_history(school["discounts"], school["terms"], student_id=2).collect()
    assert [r["discount_id"] for r in disc] == [2, 1]


def test_dashboard_without_current_term_shows_gross_as_balance(school):
    terms = school["terms"].withColumn("is_current", F.lit(0))
    rows = reports.recent_payments(school["payments"], school["students"], school["classes"],
                                   school["discounts"], terms, school["boarding"], n=5).collect()
    by_student = {r["student_id"]: r["balance"] for r in rows}
    assert by_student[2] == D("350000.00")  # boarder: nothing paid or discounted "this term"
    assert by_student[1] == D("80000.00")


def test_has_discount_flag(school):
    rows = _by_id(_bal(school))
    assert rows[2]["has_discount"] is True and rows[1]["has_discount"] is False
