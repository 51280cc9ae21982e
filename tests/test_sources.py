from __future__ import annotations

from decimal import Decimal as D

from bursar.sources import schemas, tables


def test_scans_conform_storage_types(spark, tmp_path):
    path = str(tmp_path / "classes")
    spark.createDataFrame([(1, "P.1", "Lower Primary", 90000.0, "extra")],
                          "class_id long, class_name string, section string, term_fee double, junk string"
                          ).write.parquet(path)
    df = tables.classes(spark, path)
    assert [(f.name, f.dataType) for f in df.schema.fields] == \
        [(f.name, f.dataType) for f in schemas.CLASSES.fields]
    assert df.collect()[0]["term_fee"] == D("90000.00")
    students = str(tmp_path / "students")
    spark.createDataFrame([(1, "UB-1")], "student_id long, admission_number string").write.parquet(students)
    row = tables.students(spark, students).collect()[0]
    assert row["status"] is None and row["full_name"] is None  # absent nullable columns come back null


def test_ensure_write_and_snapshot(spark, tmp_path, school):
    fd = tables.ensure_table(spark, "fee_defaults", str(tmp_path / "fd"))
    assert fd.count() == 0 and fd.columns == ["fee_key", "label", "amount"]
    again = tables.ensure_table(spark, "fee_defaults", str(tmp_path / "fd"))
    assert again.count() == 0
    paths = tables.write_versions({"students": school["students"], "payments": school["payments"]},
                                  str(tmp_path / "db"), "v1")
    assert spark.read.parquet(paths["students"]).count() == 6
    snap = tables.snapshot({"classes": school["classes"]}, str(tmp_path / "backup"), "2024-06-30")
    assert spark.read.parquet(snap["classes"]).count() == 3
    roster = str(tmp_path / "users")
    spark.createDataFrame([(1, "ann", "h4sh", "Ann", "Admin")],
                          "user_id long, username string, password_hash string, full_name string, role string"
                          ).write.parquet(roster)
    assert "password_hash" not in tables.staff_roster(spark, roster).columns


def test_change_set_is_published_as_a_whole(spark, tmp_path, school):
    import pytest
    from pyspark.sql import functions as F

    root = str(tmp_path / "school")
    names = ("students", "payments", "discounts")
    tables.publish({n: school[n] for n in names}, root, "v1")
    failing = {n: school[n].limit(1) for n in names}
    failing["discounts"] = school["discounts"].withColumn("student_id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        tables.publish(failing, root, "v2")
    read = lambda n: spark.read.parquet(tables.current_path(spark, root, n)).count()
    assert [read(n) for n in names] == [school[n].count() for n in names]
    tables.publish({n: school[n].limit(1) for n in names}, root, "v2")  # the retry overwrites the unfinished folders
    assert [read(n) for n in names] == [1, 1, 1]
    with pytest.raises(ValueError, match="published"):
        tables.publish({n: school[n] for n in names}, root, "v2")
