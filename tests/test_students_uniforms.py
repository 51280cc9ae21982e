from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from bursar.functions import formats
from bursar.operators import reports, students as stu, uniforms


def test_class_counts_keep_empty_class(school):
    rows = {r["class_id"]: r["student_count"] for r in stu.class_counts(school["students"],
                                                                         school["classes"]).collect()}
    assert rows == {1: 2, 2: 2, 3: 0}
    total = stu.class_counts_total(school["students"], school["classes"]).collect()[0]["total_students"]
    assert total == 4  # the active student with an unknown class is not counted


def test_dashboard_counts(school):
    r = reports.dashboard_stats(school["students"], school["classes"], school["items"]).collect()[0]
    assert (r["total_students"], r["total_boarders"], r["total_day"]) == (5, 1, 4)
    assert r["total_classes"] == 3 and r["low_stock_items"] == 2


def test_search_wildcards_case_and_trim(school):
    s, c = school["students"], school["classes"]
    # '%' typed by the user stays a wildcard; matching ignores case; tabs are trimmed
    assert {r["student_id"] for r in stu.student_search(s, c, "\tBRIAN ").collect()} == {2}
    assert {r["student_id"] for r in stu.student_search(s, c, "100%done").collect()} == {3}
    assert {r["student_id"] for r in stu.student_search(s, c, "k_l").collect()} == {2}
    # an exact admission number also matches; '0' is a real search term (exact key or name part)
    assert {r["student_id"] for r in stu.student_search(s, c, "UB-001").collect()} == {1}
    assert {r["student_id"] for r in stu.student_search(s, c, "0").collect()} == {3, 6}
    out = stu.student_search_outcome(s, c, "a").collect()[0]
    assert out["outcome"] == "many" and out["match_count"] == 4
    assert stu.student_search_outcome(s, c, "Eve").collect()[0]["outcome"] == "none"  # no class row
    assert stu.student_search_outcome(s, c, "   ").collect()[0]["outcome"] == "none"


def test_directory_filters(school):
    s, c = school["students"], school["classes"]
    assert stu.student_directory(s, c).count() == 5
    assert [r["student_id"] for r in stu.student_directory(s, c, "", 2).collect()] == [3, 4, 6]
    assert [r["student_id"] for r in stu.student_directory(s, c, "ub-00", 1).collect()] == [1, 2]


def test_eligibility_segments_and_counts(school):
    s, c, i = school["students"], school["classes"], school["items"]
    counts = {r["student_id"]: r["eligible_items"]
              for r in uniforms.uniform_eligibility_counts(s, c, i).collect()}
    # Nursery girl: sweater(All/All) + dress(Nursery/Female) = 2; Nursery boy: sweater + shorts = 2
    # Lower Primary girl: sweater = 1; Lower Primary boys: sweater + shorts = 2
    assert counts == {1: 2, 2: 2, 3: 1, 4: 2, 6: 2}
    pairs = uniforms.eligible_items_for(s.filter("student_id = 1"), c, i)
    assert [r["uniform_id"] for r in pairs.collect()] == [2, 1]  # ordered by item name
    seg = uniforms.uniform_eligibility(s, c, i)
    by_seg = seg.groupBy("section", "gender").count().collect()
    assert {(r["section"], r["gender"]): r["count"] for r in by_seg} == {
        ("Nursery", "Female"): 2, ("Nursery", "Male"): 2,
        ("Lower Primary", "Female"): 1, ("Lower Primary", "Male"): 2}


def test_eligible_pairs_are_not_shuffled(spark, make, monkeypatch):
    monkeypatch.setattr(uniforms, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(uniforms, "BLOCK_STUDENTS", 2)
    sections, genders = ["Nursery", "All", None], ["Male", "Female", "All", None]
    classes = make("classes", [{"class_id": k, "class_name": f"C{k}", "section": s, "term_fee": D(1)} for k, s in enumerate(sections)])
    students = make("students", [{"student_id": k // 2, "admission_number": f"A{k}", "class_id": k % 4, "gender": genders[k % 5 % 4],
                                  "status": "Active"} for k in range(24)])  # ids come twice, a class has no row
    items = make("uniform_items", [{"uniform_id": k % 19, "item_name": f"i{k * 7 % 10}" if k % 6 else None, "applicable_section": sections[k % 3],
                                    "applicable_gender": genders[k // 3 % 4], "price": D(k), "quantity_in_stock": k} for k in range(40)])
    pairs = uniforms.eligible_items_for(students, classes, items)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(items") < plan.index("Exchange")  # pairs come into being after the last exchange
    fits = lambda own, wanted: wanted is not None and wanted in (own, "All")
    section = {c.class_id: c.section for c in classes.collect()}
    want = sorted((s.student_id, i.quantity_in_stock) for s in students.collect() if s.class_id in section for i in items.collect()
                  if fits(section[s.class_id], i.applicable_section) and fits(s.gender, i.applicable_gender))
    got = pairs.collect()
    assert sorted((r.student_id, r.quantity_in_stock) for r in got) == want
    one = uniforms.eligible_items_for(students.filter("admission_number = 'A1'"), classes, items).collect()
    names = [(r.item_name is not None, r.item_name or "", r.uniform_id) for r in one]
    assert len(names) > 4 and names == sorted(names)


def test_eligible_pairs_cost_little_each(spark, make):
    # All pairs of two lists that meet are held as copies at once: few, and only the student changes from one to the next.
    assert uniforms.BLOCK_ITEMS * uniforms.BLOCK_STUDENTS <= 1 << 14
    classes = make("classes", [{"class_id": 1, "class_name": "C", "section": "Nursery", "term_fee": D(1)}])
    students = make("students", [{"student_id": k, "admission_number": f"A{k}", "class_id": 1, "gender": "Male", "status": "Active"}
                                 for k in range(uniforms.BLOCK_STUDENTS + 5)])
    items = make("uniform_items", [{"uniform_id": k, "item_name": f"i{k * 7 % 50:02d}", "applicable_section": "All", "applicable_gender": "Male",
                                    "price": D("1.50"), "quantity_in_stock": k} for k in range(50)])
    pairs = uniforms.eligible_items_for(students, classes, items)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    expansion = plan[:plan.index("Exchange")]
    assert expansion.index("Generate explode(students") < expansion.index("Generate explode(items") and "cast(" not in expansion
    names = {}
    for r in pairs.collect():
        names.setdefault(r.student_id, []).append(r.item_name)
        assert r.price == D("1.50")
    assert len(names) == students.count() and all(n == sorted(n) and len(n) == 50 for n in names.values())


def test_item_sales_and_totals(school):
    rows = uniforms.uniform_stock(school["items"]).collect()
    assert [r["uniform_id"] for r in rows] == [2, 3, 1, 4]  # by name, equal names by id
    sales = reports.uniform_item_sales(school["items"], school["issues"]).collect()
    assert [(r["uniform_id"], r["qty_sold"]) for r in sales] == [(1, 2), (3, 1), (2, 0), (4, 0)]
    tot = reports.uniform_sales_summary(school["issues"]).collect()[0]
    assert tot["total_items_sold"] == 3 and tot["balance_owed"] == D("5000.00")
    hist = uniforms.uniform_issue_history(school["issues"], school["items"]).collect()
    assert [r["line_balance"] for r in hist] == [D("10000.00"), D("-5000.00")]


def test_scalar_formats(spark):
    df = spark.createDataFrame([("\t Ann Lee \x0b", 2.5, "0", 3, 2024)], "s string, x double, e string, t int, y int")
    r = df.select(formats.php_trim("s").alias("t"), formats.money_text("x").alias("m"),
                  formats.is_php_empty("e").alias("e"), formats.first_name(formats.php_trim("s")).alias("f"),
                  formats.term_label("t", "y").alias("l"), formats.short_term_label("t", "y").alias("sl"),
                  formats.falsy_default("e", "n/a").alias("fd")).collect()[0]
    assert r["t"] == "Ann Lee" and r["m"] == "3" and r["e"] is True and r["f"] == "Ann"
    assert r["l"] == "Term 3, 2024" and r["sl"] == "T3 2024" and r["fd"] == "n/a"
    none = spark.range(1).select(formats.term_label(F.lit(None).cast("int"), F.lit(None).cast("int"))).collect()
    assert none[0][0] == formats.NO_TERM_LABEL


def test_issue_history_for_one_student(school):
    rows = uniforms.uniform_issue_history(school["issues"], school["items"], student_id=2).collect()
    assert [(r["issue_key"], r["item_name"]) for r in rows] == [(2, "Shorts")]


def test_exact_admission_wins_over_search(school):
    s, c = school["students"], school["classes"]
    r = stu.student_search_outcome(s, c, "a", admission_number=" UB-003 ").collect()[0]
    assert (r["outcome"], r["match_count"], r["search_term"]) == ("found", 1, "UB-003")
    r = stu.student_search_outcome(s, c, "a", admission_number="UB-999").collect()[0]
    assert r["outcome"] == "not_found"
    r = stu.student_search_outcome(s, c, "Okello", admission_number="  ").collect()[0]
    assert r["outcome"] == "one"
    assert [x["student_id"] for x in stu.student_lookup(s, c, "\tUB-002").collect()] == [2]


def test_flag_and_int_helpers(spark):
    df = spark.createDataFrame([(1, "12"), (0, "12abc"), (None, None)], "f int, s string")
    rows = df.select(formats.yes_no("f").alias("y"), formats.php_int("s").alias("i")).collect()
    assert [(r["y"], r["i"]) for r in rows] == [("Yes", 12), ("No", None), ("No", None)]
