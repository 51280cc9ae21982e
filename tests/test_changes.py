from __future__ import annotations

from decimal import Decimal as D

from bursar.operators import changes as ch
from bursar.sources import schemas

from tests.days import day


def test_registrations_rules(make, school):
    cmds = make(schemas.REGISTRATION_COMMANDS, [
        {"seq": 10, "admission_number": " UB-010\t", "full_name": " New One ", "class_id": 1},
        {"seq": 11, "admission_number": "UB-010", "full_name": "Second", "class_id": 1},  # dup in batch
        {"seq": 12, "admission_number": "UB-001", "full_name": "Exists", "class_id": 1},   # exists
        {"seq": 13, "admission_number": "0", "full_name": "Zero", "class_id": 1},          # '0' is empty
        {"seq": 14, "admission_number": "UB-011", "full_name": "No class", "class_id": 0},  # class 0 empty
        {"seq": 9, "admission_number": "UB-012", "full_name": "Early", "class_id": 2, "is_boarder": 1},
    ])
    res = ch.apply_registrations(school["students"], cmds)
    new = {r["admission_number"]: r for r in res.table.filter("student_id > 6").collect()}
    assert set(new) == {"UB-010", "UB-012"}
    assert new["UB-010"]["full_name"] == "New One" and new["UB-010"]["status"] == "Active"
    assert new["UB-010"]["student_id"] == 6 + (10 - 9 + 1)
    assert new["UB-012"]["student_id"] == 7 and new["UB-012"]["is_boarder"] == 1
    rej = {r["seq"]: r["reject_reason"] for r in res.rejects.collect()}
    assert rej == {11: "admission_exists", 12: "admission_exists", 13: "missing_fields",
                   14: "missing_fields"}
    # every command is accounted for exactly once
    assert len(new) + len(rej) == cmds.count()


def test_updates_last_wins_and_unknown_is_noop(make, school):
    cmds = make(schemas.STUDENT_UPDATE_COMMANDS, [
        {"seq": 1, "student_id": 1, "full_name": "First Edit", "class_id": 1, "status": "Active"},
        {"seq": 2, "student_id": 1, "full_name": " Last Edit ", "class_id": 2, "status": "Withdrawn",
         "guardian_name": ""},
        {"seq": 3, "student_id": 77, "full_name": "Ghost"},
    ])
    res = ch.apply_student_updates(school["students"], cmds)
    rows = {r["student_id"]: r for r in res.table.collect()}
    assert len(rows) == 6
    assert rows[1]["full_name"] == "Last Edit" and rows[1]["class_id"] == 2
    assert rows[1]["status"] == "Withdrawn" and rows[1]["guardian_name"] == ""  # blank replaces
    assert rows[1]["admission_number"] == "UB-001"
    assert rows[2]["full_name"] == "brian Okello"
    assert [(r["seq"], r["reject_reason"]) for r in res.rejects.collect()] == [(3, "unknown_student")]


def test_empty_batch_is_identity(make, school):
    none = make(schemas.PAYMENT_EDIT_COMMANDS, [])
    res = ch.apply_payment_edits(school["payments"], none)
    assert sorted(res.table.collect()) == sorted(school["payments"].collect())
    assert res.rejects.count() == 0


def test_cascade_delete(make, school):
    cmds = make(schemas.KEY_COMMANDS_STUDENT, [{"seq": 1, "student_id": 1}, {"seq": 2, "student_id": 2}])
    out = ch.apply_student_deletes(school["students"], school["payments"], school["discounts"],
                                   school["issues"], cmds)
    assert out.students.count() == 4
    assert {r["student_id"] for r in out.payments.collect()} == {3, 4, 6}
    assert {r["student_id"] for r in out.discounts.collect()} == {6}
    assert out.issues.count() == 0


def test_payments_and_discounts(make, school):
    pcmds = make(schemas.PAYMENT_COMMANDS, [
        {"seq": 1, "student_id": 1, "term_id": 2, "amount_paid": D("1000"), "date_paid": day("2024-06-01")},
        {"seq": 2, "student_id": 1, "term_id": 2, "amount_paid": D("0")},
        {"seq": 3, "student_id": 1, "term_id": 2, "amount_paid": None},
    ])
    res = ch.apply_payments(school["payments"], pcmds, today="2024-06-30")
    new = res.table.filter("payment_id > 6").collect()
    assert len(new) == 1 and new[0]["payment_id"] == 7
    assert new[0]["receipt_number"] == "RCT-20240601-1007"
    assert {r["seq"] for r in res.rejects.collect()} == {2, 3}

    dcmds = make(schemas.DISCOUNT_COMMANDS, [
        {"seq": 1, "student_id": 1, "term_id": 2, "discount_amount": D("500"), "approved_by": " Head "},
        {"seq": 2, "student_id": 1, "term_id": 2, "discount_amount": D("-1"), "approved_by": ""},
        {"seq": 3, "student_id": 1, "term_id": 2, "discount_amount": D("5"), "approved_by": "\t"},
        {"seq": 4, "student_id": 99, "term_id": 2, "discount_amount": D("5"), "approved_by": "Head"},
        {"seq": 5, "student_id": 1, "term_id": 9, "discount_amount": D("5"), "approved_by": "Head"},
    ])
    res = ch.apply_discounts(school["discounts"], school["students"], school["terms"], dcmds,
                             today="2024-06-30")
    new = res.table.filter("discount_id > 3").collect()
    assert len(new) == 1 and new[0]["approved_by"] == "Head" and str(new[0]["date_given"]) == "2024-06-30"
    assert {r["seq"]: r["reject_reason"] for r in res.rejects.collect()} == {
        2: "invalid_amount", 3: "missing_approver", 4: "unknown_student", 5: "unknown_term"}


def test_terms_and_current(make, school):
    cmds = make(schemas.TERM_COMMANDS, [
        {"seq": 1, "academic_year": 2024, "term_number": 3},
        {"seq": 2, "academic_year": 2024, "term_number": 3},
        {"seq": 3, "academic_year": 2024, "term_number": 1},
    ])
    res = ch.apply_new_terms(school["terms"], cmds)
    rows = {r["term_id"]: r for r in res.table.collect()}
    assert rows[3]["term_number"] == 3 and rows[3]["is_current"] == 0
    assert {r["seq"] for r in res.rejects.collect()} == {2, 3}
    cur = ch.set_current_term(school["terms"], 1).collect()
    assert {r["term_id"]: r["is_current"] for r in cur} == {1: 1, 2: 0}
    none = ch.set_current_term(school["terms"], 42).collect()
    assert all(r["is_current"] == 0 for r in none)


def test_fee_defaults(make, spark):
    fd = make("fee_defaults", [{"fee_key": "boarding", "label": "Boarding", "amount": 400000}])
    seeded = {r["fee_key"]: r["amount"] for r in ch.seed_fee_defaults(fd).collect()}
    assert seeded == {"boarding": 400000, "upper_primary": 90000, "lower_primary": 90000, "nursery": 80000}
    cmds = make(schemas.FEE_DEFAULT_COMMANDS, [
        {"seq": 1, "fee_key": "boarding", "amount": 1}, {"seq": 2, "fee_key": "boarding", "amount": 2},
        {"seq": 3, "fee_key": "boarding", "amount": -1}, {"seq": 4, "fee_key": "", "amount": 5},
        {"seq": 5, "fee_key": "transport", "amount": 5}])
    res = ch.apply_fee_default_updates(fd, cmds)
    assert res.table.collect()[0]["amount"] == 2
    assert {r["seq"]: r["reject_reason"] for r in res.rejects.collect()} == {
        3: "invalid_fee", 4: "invalid_fee", 5: "unknown_fee"}


def test_items_and_restock(make, school):
    items = school["items"]
    rcmds = make(schemas.RESTOCK_COMMANDS, [
        {"seq": 1, "uniform_id": 1, "add_quantity": 5}, {"seq": 2, "uniform_id": 1, "add_quantity": 2},
        {"seq": 3, "uniform_id": 1, "add_quantity": 0}, {"seq": 4, "uniform_id": 50, "add_quantity": 1}])
    res = ch.apply_restock(items, rcmds)
    stock = {r["uniform_id"]: r["quantity_in_stock"] for r in res.table.collect()}
    assert stock == {1: 10, 2: 0, 3: 10, 4: 6}
    assert {r["seq"]: r["reject_reason"] for r in res.rejects.collect()} == {
        3: "invalid_quantity", 4: "unknown_uniform"}
    acmds = make(schemas.ITEM_COMMANDS, [
        {"seq": 1, "item_name": " Tie ", "applicable_section": "All", "applicable_gender": "All",
         "price": D("0"), "initial_stock": -2},
        {"seq": 2, "item_name": "0", "price": D("10")}, {"seq": 3, "item_name": "Hat", "price": None}])
    res = ch.apply_new_items(items, acmds)
    new = res.table.filter("uniform_id > 4").collect()
    assert [(r["item_name"], r["quantity_in_stock"]) for r in new] == [("Tie", -2)]
    assert res.rejects.count() == 2
    ucmds = make(schemas.ITEM_COMMANDS, [
        {"seq": 1, "uniform_id": 2, "item_name": "Gown", "applicable_section": "All",
         "applicable_gender": "Female", "price": D("31000")},
        {"seq": 2, "uniform_id": 2, "item_name": "", "price": D("1")}])
    res = ch.apply_item_updates(items, ucmds)
    row = res.table.filter("uniform_id = 2").collect()[0]
    assert row["item_name"] == "Gown" and row["quantity_in_stock"] == 0
    assert res.rejects.count() == 1


def test_admission_numbers_compare_case_insensitively(make, school):
    from bursar.operators import audits, students as stu
    cmds = make(schemas.REGISTRATION_COMMANDS, [
        {"seq": 1, "admission_number": "ub-001", "full_name": "Clash", "class_id": 1},
        {"seq": 2, "admission_number": "UB-200", "full_name": "New", "class_id": 1},
        {"seq": 3, "admission_number": "ub-200", "full_name": "Again", "class_id": 1}])
    res = ch.apply_registrations(school["students"], cmds)
    assert [r["admission_number"] for r in res.added.collect()] == ["UB-200"]
    assert {r["seq"]: r["reject_reason"] for r in res.rejects.collect()} == {
        1: "admission_exists", 3: "admission_exists"}
    assert [r["student_id"] for r in stu.student_lookup(school["students"], school["classes"], "ub-002").collect()] == [2]
    dup = audits.duplicate_admissions(school["students"].unionByName(
        school["students"].filter("student_id = 3").selectExpr(
            "77L AS student_id", "lower(admission_number) AS admission_number", "full_name", "gender",
            "date_of_birth", "class_id", "is_boarder", "guardian_name", "guardian_phone", "status"))).collect()
    assert [(r["admission_key"], r["occurrences"]) for r in dup] == [("ub-003", 2)]
