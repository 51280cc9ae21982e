"""Names and numbers compared as the database does: neither letter case nor accents count; recent payments by key ranges."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from bursar.functions.formats import text_key
from bursar.operators import reports, students as stu
from bursar.operators.changes import apply_registrations
from bursar.operators.student_search_many import search_outcomes
from bursar.sources import schemas, tables


def test_text_key(spark):
    words = {"Zoë": "zoe", "ÉCOLE": "ecole", "école": "ecole", "Ñandú": "nandu", "ß": "ß", "Ångström": "angstrom", "日本": "日本", "x-1%": "x-1%",
             "ĄĆŁ": "acł", "Ệ": "e", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in words], "w string")
    assert [r[0] for r in df.select(text_key("w")).collect()] == list(words.values())


def test_lookup_uniqueness_search_and_order_agree(spark, make, school):
    names = ["Zoë", "zoe", "ÉMILE", "emma", "Emil", "Ömer", "oscar"]
    students = make("students", [{"student_id": i, "admission_number": f"É-{i}", "full_name": n, "class_id": 1, "is_boarder": 0, "status": "Active"}
                                 for i, n in enumerate(names)])
    classes = school["classes"]
    assert [r.full_name for r in stu.student_directory(students, classes).collect()] == ["Emil", "ÉMILE", "emma", "Ömer", "oscar", "Zoë", "zoe"]
    assert [r.student_id for r in stu.student_lookup(students, classes, " e-3 ").collect()] == [3]
    assert {r.full_name for r in stu.student_search(students, classes, "émi").collect()} == {"Emil", "ÉMILE"}
    assert {r.full_name for r in stu.student_search(students, classes, "Z_Ë").collect()} == {"Zoë", "zoe"}
    terms = spark.createDataFrame([(1, None, "émi"), (2, "e-3", None), (3, None, "Z_Ë"), (4, None, "é-5")], schemas.SEARCH_TERMS)
    got = {r.term_key: (r.match_count, r.outcome) for r in search_outcomes(students, classes, terms).collect()}
    assert got == {1: (2, "many"), 2: (1, "found"), 3: (2, "many"), 4: (1, "one")}
    commands = make(schemas.REGISTRATION_COMMANDS, [{"seq": 1, "admission_number": "E-2", "full_name": "A", "class_id": 1},
                                                    {"seq": 2, "admission_number": "ñ-1", "full_name": "B", "class_id": 1},
                                                    {"seq": 3, "admission_number": "N-1", "full_name": "C", "class_id": 1}])
    result = apply_registrations(students, commands)
    assert [r.admission_number for r in result.added.collect()] == ["ñ-1"]
    assert sorted((r.seq, r.reject_reason) for r in result.rejects.collect()) == [(1, "admission_exists"), (3, "admission_exists")]


def _scan_rows(df):
    """Rows that the scan of an executed frame handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_recent_payments_read_the_newest_keys(spark, make, school, tmp_path):
    rows = spark.range(1, 200_001).selectExpr("id as payment_id", "id % 8 as student_id", "2 as term_id", "cast(1 as decimal(12,2)) as amount_paid",
                                              "'' as payment_method", "'' as received_by", "'' as receipt_number", "date'2024-01-01' as date_paid")
    path = str(tmp_path / "payments")
    rows.repartitionByRange(20, "payment_id").sortWithinPartitions("payment_id").write.option("parquet.block.size", 65536).parquet(path)
    assert tables.key_bounds(spark, path, "payment_id") == (1, 200_000)
    payments = tables.fee_payments(spark, path)
    bounds = tables.key_bounds(spark, path, "payment_id")
    got = reports.newest_joined(payments, school["students"], school["classes"], 5, bounds).collect()
    want = [i for i in range(200_000, 199_900, -1) if i % 8 in (1, 2, 3, 4, 6)][:5]
    assert [r.payment_id for r in got] == want
    near = payments.filter(f"payment_id > {200_000 - reports.RECENT_KEYS * 5}")
    assert "PushedFilters: [IsNotNull(payment_id), GreaterThan(payment_id,199920)]" in near._jdf.queryExecution().executedPlan().toString()
    assert _scan_rows(near) <= 20_000  # one of twenty files, whatever the table holds below


@pytest.mark.parametrize("n", [1, 3, 6])
def test_newest_joined_goes_down_to_the_oldest(spark, make, school, n):
    """The newest thousands have no student; a page larger than what there is gives all there is."""
    payments = make("fee_payments", [{"payment_id": p, "student_id": 1, "term_id": 2, "amount_paid": D("1")} for p in (-4, 7, 30)]
                    + [{"payment_id": p, "student_id": 777, "term_id": 2, "amount_paid": D("1")} for p in range(5000, 5400)])
    got = [r.payment_id for r in reports.newest_joined(payments, school["students"], school["classes"], n).collect()]
    assert got == [30, 7, -4][:n]
    assert reports.newest_joined(payments.limit(0), school["students"], school["classes"], n).count() == 0
