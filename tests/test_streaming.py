"""Streaming forms: stateful issue decisions and foreachBatch change jobs, from parquet file streams."""

from __future__ import annotations

from decimal import Decimal as D

from bursar.operators import changes as ch
from bursar.sources import schemas, tables
from bursar.streaming.commands import apply_stream, version_path
from bursar.streaming.issues import issue_stream

from tests.days import day


def _write_batches(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        tuples = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        spark.createDataFrame(tuples, schema).coalesce(1).write.parquet(f"{folder}/part{i}")


def test_issue_stream_carries_stock_and_sees_restocks(spark, make, tmp_path):
    root, src = str(tmp_path / "school"), str(tmp_path / "requests")
    tables.publish({"uniform_items": make("uniform_items", [
        {"uniform_id": 1, "item_name": "Sweater", "price": D("10"), "quantity_in_stock": 5},
        {"uniform_id": 2, "item_name": "Tie", "price": D("3"), "quantity_in_stock": 1}]),
        "uniform_issues": make("uniform_issues", [])}, root, "v0")
    r = lambda rid, u, q, d: {"request_id": rid, "student_id": rid, "uniform_id": u, "quantity": q,
                              "date_issued": day(d)}
    current = lambda n: tables.current(spark, root, n)

    def arrive(part, rows):
        tuples = [tuple(x.get(f.name) for f in schemas.ISSUE_REQUESTS.fields) for x in rows]
        spark.createDataFrame(tuples, schemas.ISSUE_REQUESTS).coalesce(1).write.parquet(f"{src}/{part}")
        stream = (spark.readStream.schema(schemas.ISSUE_REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"))
        issue_stream(stream, root, str(tmp_path / "ckpt")).awaitTermination(180)

    arrive("a", [r(1, 1, 3, "2024-01-01"), r(2, 1, 4, "2024-01-02"), r(3, 2, 1, "2024-01-01"), r(7, 9, 1, "2024-01-05")])
    assert {x.uniform_id: x.quantity_in_stock for x in current("uniform_items").collect()} == {1: 2, 2: 0}
    restocked = ch.apply_restock(current("uniform_items"), make(schemas.RESTOCK_COMMANDS, [
        {"seq": 1, "uniform_id": 2, "add_quantity": 5}]))
    tables.publish({"uniform_items": restocked.table}, root, "restock-1")
    arrive("b", [r(4, 1, 2, "2024-01-03"), r(5, 1, 1, "2024-01-04"), r(6, 2, 4, "2024-01-05"), r(8, 1, 0, "2024-01-02")])
    assert {x.uniform_id: x.quantity_in_stock for x in current("uniform_items").collect()} == {1: 0, 2: 1}
    issues = current("uniform_issues").collect()
    # Each batch wrote its own new rows only.
    assert [spark.read.parquet(str(p)).count() for p in sorted(tmp_path.rglob("uniform_issues+"))] == [2, 2]
    assert sorted(x.student_id for x in issues) == [1, 3, 4, 6] and len({x.issue_key for x in issues}) == 4
    rejects = {x.request_id: x.reject_reason for x in spark.read.parquet(f"{root}_rejects").collect()}
    assert rejects == {2: "insufficient_stock", 5: "insufficient_stock", 7: "unknown_item", 8: "invalid_quantity"}


def test_payment_commands_as_a_stream(spark, make, school, tmp_path):
    base = str(tmp_path / "payments0")
    school["payments"].write.parquet(base)
    src = str(tmp_path / "cmds")
    c = lambda seq, amt: {"seq": seq, "student_id": 1, "term_id": 2, "amount_paid": amt,
                          "date_paid": day("2024-06-01")}
    _write_batches(spark, src, schemas.PAYMENT_COMMANDS, [[c(1, D("10")), c(2, D("0"))], [c(3, D("20"))]])
    stream = (spark.readStream.schema(schemas.PAYMENT_COMMANDS).option("maxFilesPerTrigger", 1)
                   .parquet(f"{src}/*"))
    root = str(tmp_path / "payments")
    q = apply_stream(stream, ch.apply_payments, initial_path=base, root=root,
                     table_schema=schemas.FEE_PAYMENTS, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    final = spark.read.parquet(version_path(root, 1))
    assert final.count() == 8
    assert sorted(r["payment_id"] for r in final.filter("payment_id > 6").collect()) == [7, 8]
    rejects = spark.read.parquet(f"{root}_rejects")
    assert [(r["seq"], r["batch_id"]) for r in rejects.collect()] == [(2, 0)]


def test_registrations_stream_appends_only_new_rows(spark, make, school, tmp_path):
    from bursar.streaming.commands import appended_table
    base = str(tmp_path / "students0")
    school["students"].write.parquet(base)
    src = str(tmp_path / "cmds")
    c = lambda seq, adm: {"seq": seq, "admission_number": adm, "full_name": f"N{seq}", "class_id": 1}
    _write_batches(spark, src, schemas.REGISTRATION_COMMANDS,
                   [[c(1, "UB-100"), c(2, "UB-001")], [c(3, "UB-100"), c(4, "UB-101")]])
    stream = (spark.readStream.schema(schemas.REGISTRATION_COMMANDS).option("maxFilesPerTrigger", 1)
                   .parquet(f"{src}/*"))
    root = str(tmp_path / "students")
    q = apply_stream(stream, ch.apply_registrations, initial_path=base, root=root,
                     table_schema=schemas.STUDENTS, checkpoint=str(tmp_path / "ckpt"), append=True)
    q.awaitTermination(120)
    table = appended_table(spark, base, root, schemas.STUDENTS)
    new = sorted((r["admission_number"], r["student_id"]) for r in table.filter("student_id > 6").collect())
    assert new == [("UB-100", 7), ("UB-101", 9)]  # the repeat of UB-100 in batch 1 is refused
    rejects = sorted((r["seq"], r["reject_reason"]) for r in spark.read.parquet(f"{root}_rejects").collect())
    assert rejects == [(2, "admission_exists"), (3, "admission_exists")]
