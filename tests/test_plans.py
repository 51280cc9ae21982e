"""Physical-plan checks: the shapes that matter at scale."""

from __future__ import annotations

import pytest

from bursar.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q():
    return all_queries()


def test_eligibility_is_an_equi_join(spark, q):
    for name in ("uniform_eligibility", "uniform_eligibility_counts"):
        plan = _plan(q[name](spark, SF))
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_recent_payments_narrows_both_scans_to_the_page(spark, q):
    plan = _plan(q["recent_payments"](spark, SF))
    assert plan.count("PushedFilters") >= 2 and "NestedLoopJoin" not in plan


def test_no_cross_products_anywhere(spark, q):
    for name, fn in q.items():
        plan = _plan(fn(spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_discount_fk_checks_are_hash_joins(spark, school, make):
    from decimal import Decimal

    from bursar.operators.changes import apply_discounts
    from bursar.sources import schemas
    cmds = make(schemas.DISCOUNT_COMMANDS, [
        {"seq": 1, "student_id": 1, "term_id": 2, "discount_amount": Decimal("5"), "approved_by": "H"},
        {"seq": 2, "student_id": 2, "term_id": 1, "discount_amount": Decimal("5"), "approved_by": "H"}])
    res = apply_discounts(school["discounts"], school["students"], school["terms"], cmds)
    for df in (res.table, res.rejects):
        plan = _plan(df)
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_current_term_is_pushed_to_the_payment_scan(spark, tmp_path):
    from bursar.operators.balances import current_term_id, sums_by_student
    pay = spark.createDataFrame([(1, 1, 2, 10.0)], "payment_id long, student_id long, term_id int, amount_paid double")
    path = str(tmp_path / "pay")
    pay.write.parquet(path)
    terms = spark.createDataFrame([(2, 2024, 2, 1)], "term_id int, academic_year int, term_number int, is_current int")
    df = sums_by_student(spark.read.parquet(path), "amount_paid", "paid", current_term_id(terms))
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(term_id), EqualTo(term_id,2)]" in plan
    assert df.collect()[0]["paid"] == 10.0


def test_sums_are_combined_before_the_shuffle(spark, q):
    plan = _plan(q["student_balances"](spark, SF))
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "partial_sum" in l]
    assert len(partial) >= 2  # payments and discounts
    for i in partial:  # each partial aggregate sits below (after, in the text) a shuffle exchange
        assert any("Exchange hashpartitioning(student_id" in l for l in lines[:i])



@pytest.mark.parametrize("on_files", [True, False])
def test_rejects_do_not_shuffle_the_base(spark, school, make, tmp_path, on_files):
    """The base's keys meet the commands' keys where they lie, whether or not the frames have size statistics."""
    from bursar.operators.changes import apply_payment_deletes
    from bursar.sources import schemas, tables
    cmds = make(schemas.KEY_COMMANDS_PAYMENT, [{"seq": k, "payment_id": k * 3} for k in range(4)])
    payments = school["payments"]
    if on_files:
        payments = tables.fee_payments(spark, tables.write_version(payments, str(tmp_path / "payments")))
    result = apply_payment_deletes(payments, cmds)
    plan = _plan(result.rejects)
    inner = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert inner and all("BroadcastHashJoin" in line for line in inner), plan
    assert {r.payment_id for r in result.rejects.collect()} == {0, 9}


def test_term_partitioned_payments_are_pruned(spark, school, tmp_path):
    from bursar.operators.balances import term_balances
    from bursar.sources import tables
    path = tables.write_version(school["payments"], str(tmp_path / "payments"), partition_by=["term_id"])
    payments = tables.fee_payments(spark, path)
    df = term_balances(school["students"], school["classes"], payments, school["discounts"],
                       school["terms"], school["boarding"])
    rows = {r["student_id"]: r["total_paid"] for r in df.collect()}
    assert rows[1] == 80000 and rows[6] == 0
    plan = _plan(df)
    scan = [line for line in plan.splitlines() if "payments" in line and "FileScan" in line]
    assert scan and all("PartitionFilters: [isnotnull(term_id" in line and "(term_id" in line and "= 2)" in line
                        for line in scan), scan
