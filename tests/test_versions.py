"""Stored sums, backups that are checked, differences of versions, declared tables and positions."""

from __future__ import annotations

import shutil
import uuid
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from bursar.operators import kept_sums as ks
from bursar.operators import versions
from bursar.operators.balances import term_balances
from bursar.operators.changes import apply_payment_deletes, apply_payment_edits, apply_payments
from bursar.operators.numbering import positions
from bursar.sources import declared, schemas, tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_follow_every_kind_of_change(spark, make, school):
    payments = school["payments"]
    stored = ks.stored_sums(payments, "amount_paid")
    edits = make(schemas.PAYMENT_EDIT_COMMANDS, [{"seq": 1, "payment_id": 1, "amount_paid": D("1.00")}])
    new = make(schemas.PAYMENT_COMMANDS, [{"seq": 1, "student_id": 6, "term_id": 2, "amount_paid": D("7.50")}])
    gone = make(schemas.KEY_COMMANDS_PAYMENT, [{"seq": 1, "payment_id": 5}, {"seq": 2, "payment_id": 99}])
    edited = apply_payment_edits(payments, edits).table
    grown = apply_payments(edited, new, today="2024-06-01")
    after = apply_payment_deletes(grown.table, gone).table
    touched = (edits.select("payment_id").unionByName(gone.select("payment_id")).unionByName(grown.added.select("payment_id")))
    kept = ks.merged_sums(stored, ks.deltas(*ks.row_changes(payments, after, touched, "payment_id"), "amount_paid"))
    want = ks.stored_sums(after, "amount_paid")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    discounts = ks.stored_sums(school["discounts"], "discount_amount")
    args = (school["terms"], school["boarding"])
    got = ks.balances_from_sums(school["students"], school["classes"], kept, discounts, *args).collect()
    assert sorted(got) == sorted(term_balances(school["students"], school["classes"], after, school["discounts"], *args).collect())


def test_backup_finds_damage_and_restores(spark, school, tmp_path):
    named = {"fee_payments": school["payments"], "academic_terms": school["terms"]}
    versions.backup(named, str(tmp_path / "backup"), "2024-06-01")
    assert versions.damaged(spark, str(tmp_path / "backup"), "2024-06-01") == []
    versions.restore(spark, str(tmp_path / "backup"), "2024-06-01", str(tmp_path / "root"), "v1")
    back = tables.fee_payments(spark, tables.current_path(spark, str(tmp_path / "root"), "fee_payments"))
    assert sorted(back.collect(), key=str) == sorted(school["payments"].collect(), key=str)
    # One amount differs, one table is gone.
    copy = tmp_path / "backup/2024-06-01/fee_payments"
    changed = school["payments"].withColumn("amount_paid", F.when(F.col("payment_id") == 3, F.lit("100000.01").cast("decimal(12,2)"))
                                            .otherwise(F.col("amount_paid")))
    changed.write.mode("overwrite").parquet(str(copy))
    shutil.rmtree(tmp_path / "backup/2024-06-01/academic_terms")
    assert versions.damaged(spark, str(tmp_path / "backup"), "2024-06-01") == ["academic_terms", "fee_payments"]
    with pytest.raises(ValueError, match="damaged"):
        versions.restore(spark, str(tmp_path / "backup"), "2024-06-01", str(tmp_path / "root"), "v2")


def test_fingerprint_counts_repeats_and_ignores_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "k int, v string")
    assert versions.fingerprint(df) == versions.fingerprint(spark.createDataFrame(rows[::-1], "k int, v string").repartition(3))
    assert versions.fingerprint(df) != versions.fingerprint(df.distinct())
    assert versions.fingerprint(df) != versions.fingerprint(spark.createDataFrame([(1, "a"), (2, ""), (2, None), (3, "")], "k int, v string"))
    assert versions.fingerprint(df.limit(0))[0] == 0


def test_differences_find_the_one_changed_row(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 3)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "e", 4), (5, "f", 5)], "k int, v string, n int")
    got = {(r.k, r.change, r.columns) for r in versions.differences(old, new, "k").collect()}
    assert got == {(2, "changed", "n"), (3, "removed", ""), (4, "changed", "v,n"), (5, "added", "")}
    assert versions.differences(old, old, "k").count() == 0


def test_declared_tables_join_without_a_shuffle(spark, school, tmp_path):
    """J8 over buckets: neither students nor payments or discounts are exchanged."""
    database = f"t{uuid.uuid4().hex[:10]}"
    for name, key in (("students", "students"), ("fee_payments", "payments"), ("fee_discounts", "discounts")):
        declared.declare(spark, name, database, buckets=4, path=str(tmp_path / name))
        assert declared.declare(spark, name, database, buckets=4) == f"{database}.{name}"  # it is there already
        declared.append(school[key].limit(2), name, database)
        declared.append(school[key].exceptAll(school[key].limit(2)), name, database)
        assert declared.table(spark, name, database).count() == school[key].count()
    of = lambda name: declared.table(spark, name, database)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = of("fee_payments").groupBy("student_id").agg(F.sum("amount_paid").alias("paid"))
        less = of("fee_discounts").groupBy("student_id").agg(F.sum("discount_amount").alias("less"))
        joined = of("students").join(sums, "student_id", "left").join(less, "student_id", "left")
        assert "Exchange" not in _plan(joined)
        assert {r.student_id: r.paid for r in joined.collect()}[1] == 80000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = term_balances(of("students"), school["classes"], of("fee_payments"), of("fee_discounts"), school["terms"], school["boarding"])
    want = term_balances(school["students"], school["classes"], school["payments"], school["discounts"], school["terms"], school["boarding"])
    assert sorted(got.collect()) == sorted(want.collect())
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_positions_are_those_of_the_sort(spark):
    df = spark.range(500).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97))).repartition(7).orderBy(F.desc("v"), "id")
    rows = [r.id for r in df.collect()]
    assert [r.id for r in sorted(positions(df).collect(), key=lambda r: r.position)] == rows
