"""Uniform eligibility, issue history and stock lists.

Eligibility (the uniform issue page): an item fits a student when
    (applicable_section = section OR applicable_section = 'All')
AND (applicable_gender  = gender  OR applicable_gender  = 'All').
Written as that OR, Spark plans a BroadcastNestedLoopJoin. Here each side is expanded to the (at most
four) concrete keys it matches and joined on equality, which is a hash join. The per-student pair list
grows as students x items (112 M pairs at sf0.1), so population-wide we ship the list per distinct
(section, gender) segment and a count per student; pairs are expanded only for a chosen student set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import ALL, LOW_STOCK_LIMIT, money, text_key
from bursar.operators.numbering import numbered
from bursar.operators.students import student_details

_ITEM_COLUMNS = ["uniform_id", "item_name", "applicable_section", "applicable_gender", "price",
                 "quantity_in_stock"]

#: Items and students of one list where pairs are expanded. Spark holds all pairs of two lists that meet as copies before the
#: first goes on, so they are few enough to stay in young memory.
BLOCK_ITEMS, BLOCK_STUDENTS = 16, 1024


def _match_keys(df: DataFrame) -> DataFrame:
    """Add (match_section, match_gender): every (value-or-'All') key pair a segment accepts."""
    sec = F.array_distinct(F.array(F.col("section"), F.lit(ALL)))
    gen = F.array_distinct(F.array(F.col("gender"), F.lit(ALL)))
    return (df.withColumn("match_section", F.explode(sec))
              .withColumn("match_gender", F.explode(gen)))


def _segments(students: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (section, gender) pairs present among students with a class row."""
    return student_details(students, classes).select("section", "gender").distinct()


def _items_by_key(items: DataFrame) -> DataFrame:
    return items.select(*_ITEM_COLUMNS).withColumnsRenamed(
        {"applicable_section": "match_section", "applicable_gender": "match_gender"})


def uniform_eligibility(students: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """Items each (section, gender) segment may be issued, ordered by item name."""
    keyed = _match_keys(_segments(students, classes))
    pairs = _items_by_key(items).join(keyed, ["match_section", "match_gender"])
    return (pairs.select("section", "gender", "uniform_id", "item_name",
                         F.col("match_section").alias("applicable_section"),
                         F.col("match_gender").alias("applicable_gender"),
                         money("price").alias("price"), "quantity_in_stock")
                 .orderBy("section", "gender", text_key("item_name"), "item_name", "uniform_id"))


def uniform_eligibility_counts(students: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """Number of items each student may be issued.

    Items are counted per (applicable_section, applicable_gender) first (map-side). Each class row gets
    the counts of its section by gender, as a map, and the count for any gender without items of its own;
    students pick theirs up in the class join they need anyway. So students are scanned once and never
    hashed on the few (section, gender) values, nor multiplied by items.
    """
    counts = (items.groupBy("applicable_section", "applicable_gender").count()
                   .filter("applicable_section is not null and applicable_gender is not null"))
    sections = _sections(classes)
    of_section = (sections.join(counts, "applicable_section")
                  .groupBy("section", "applicable_gender").agg(F.sum("count").alias("n"))
                  .groupBy("section").agg(F.map_from_entries(F.collect_list(
                      F.struct("applicable_gender", "n"))).alias("by_gender")))
    keyed = classes.select("class_id", F.col("section").alias("class_section")).join(
        of_section, F.col("class_section").eqNullSafe(F.col("section")), "left").select("class_id", "class_section", "by_gender")
    people = students.join(keyed, "class_id")
    at = lambda gender: F.coalesce(F.try_element_at("by_gender", gender), F.lit(0))
    own = F.when(F.col("gender") == ALL, F.lit(0)).otherwise(at(F.col("gender")))
    # A class's null section or a student's null gender still matches what applies to all.
    return people.select("student_id", "admission_number", "full_name", "class_id",
                         F.col("class_section").alias("section"), "gender",
                         (F.coalesce(own, F.lit(0)) + at(F.lit(ALL))).cast("bigint").alias("eligible_items"))


def _sections(classes: DataFrame) -> DataFrame:
    """(section, applicable_section): each section with itself and with 'All'."""
    return (classes.select("section").distinct()
                   .withColumn("applicable_section", F.explode(F.array_distinct(F.array("section", F.lit(ALL))))))


def eligible_items_for(selected_students: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """The student x item pairs for a chosen set of students (e.g. the page's one student), each student's in the
    order of item names.

    The pairs, students x items, are many more than either side, so they are neither shuffled nor sorted: items are
    numbered in their order and packed in lists of ``BLOCK_ITEMS`` a segment, students in lists of ``BLOCK_STUDENTS``.
    Lists meet, are put in order as they are, and pairs only come into being after the last exchange: item by item, whose
    columns are then read and its price cast once for a list of students.
    """
    spark = items.sparkSession
    people = numbered(student_details(selected_students, classes).select("section", "gender", "student_id"),
                      ["section", "gender", "student_id"], "place")
    groups = people.groupBy("section", "gender", F.expr("place div %d" % BLOCK_STUDENTS).alias("students_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "student_id"))), lambda x: x["student_id"]).alias("students"))
    named = numbered(_items_by_key(items).withColumn("price", money("price")).withColumn("name_key", text_key("item_name")),
                     ["name_key", "item_name", "uniform_id"], "place")
    segments = people.select("section", "gender").distinct()
    item = F.struct("place", "uniform_id", "item_name", "match_section", "match_gender", "price", "quantity_in_stock")
    lists = (named.join(_match_keys(segments), ["match_section", "match_gender"])
                  .groupBy("section", "gender", F.expr("place div %d" % BLOCK_ITEMS).alias("items_block"))
                  .agg(F.array_sort(F.collect_list(item)).alias("items")))
    # Null sections and genders are segments of their own.
    met = (groups.alias("g").join(lists.alias("l"), F.col("g.section").eqNullSafe(F.col("l.section"))
                                  & F.col("g.gender").eqNullSafe(F.col("l.gender")))
           .select("students_block", "items_block", "students", "items")
           .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "students_block", "items_block")
           .sortWithinPartitions("students_block", "items_block"))
    each = met.select("students", F.explode("items").alias("i")).select("students", *(
        F.col(f"i.{c}") for c in ("uniform_id", "item_name", "match_section", "match_gender", "price", "quantity_in_stock")))
    return each.select(F.explode("students").alias("student_id"), "uniform_id", "item_name", F.col("match_section").alias("applicable_section"),
                       F.col("match_gender").alias("applicable_gender"), "price", "quantity_in_stock")


def uniform_issue_history(issues: DataFrame, items: DataFrame, student_id: int | None = None) -> DataFrame:
    """Past issues with item name and what is still owed on each line (may be negative);
    one student's, newest first (the page), or everyone's unsorted."""
    if student_id is not None:
        issues = issues.filter(F.col("student_id") == F.lit(student_id))
    out = (issues.join(items.select("uniform_id", "item_name"), "uniform_id")
                  .select("issue_key", "student_id", "uniform_id", "item_name", "quantity",
                          money("total_price").alias("total_price"),
                          money("amount_paid").alias("amount_paid"),
                          money(F.col("total_price") - F.col("amount_paid")).alias("line_balance"),
                          "date_issued"))
    return out if student_id is None else out.orderBy(F.desc("date_issued"), "issue_key", "uniform_id")


def uniform_stock(items: DataFrame) -> DataFrame:
    """Uniform list page: every item by name, flagged out of stock (= 0) and low (<= 5)."""
    return (items.select("uniform_id", "item_name", "applicable_section", "applicable_gender",
                         money("price").alias("price"), "quantity_in_stock",
                         (F.col("quantity_in_stock") == 0).alias("out_of_stock"),
                         (F.col("quantity_in_stock") <= LOW_STOCK_LIMIT).alias("low_stock"))
                 .orderBy(text_key("item_name"), "item_name", "uniform_id"))


def low_stock_items(items: DataFrame) -> DataFrame:
    """items with 5 or fewer left (the dashboard's count, listed)."""
    return (items.filter(F.col("quantity_in_stock") <= LOW_STOCK_LIMIT)
                 .select("uniform_id", "item_name", "quantity_in_stock")
                 .orderBy("quantity_in_stock", "uniform_id"))
