"""Integrity audits: the rules the reference's database states or assumes, checked over
whole tables. Each audit returns the offending rows (empty when the rule holds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import NO_TERM_LABEL, term_label, text_key


def orphan_discounts(discounts: DataFrame, students: DataFrame, terms: DataFrame) -> DataFrame:
    """Discounts whose student or term row is missing (the table's two foreign keys)."""
    s = students.select("student_id").distinct().withColumn("_s", F.lit(True))
    t = terms.select("term_id").distinct().withColumn("_t", F.lit(True))
    d = discounts.join(s, "student_id", "left").join(t, "term_id", "left")
    reason = (F.when(F.col("_s").isNull(), F.lit("unknown_student"))
               .when(F.col("_t").isNull(), F.lit("unknown_term")))
    return (d.withColumn("violation", reason).filter(F.col("violation").isNotNull())
             .select("discount_id", "student_id", "term_id", "violation"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a unique key that occur more than once, with their count (aggregated map-side)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
              .filter(F.col("occurrences") > 1))


def duplicate_admissions(students: DataFrame) -> DataFrame:
    """Unique admission_number, compared as the unique index does (case-insensitively)."""
    return duplicate_keys(students.select(text_key("admission_number").alias("admission_key")),
                          ["admission_key"])


def duplicate_terms(terms: DataFrame) -> DataFrame:
    """Unique (academic_year, term_number) (checked by the term page before insert)."""
    return duplicate_keys(terms, ["academic_year", "term_number"])


def current_term_check(terms: DataFrame) -> DataFrame:
    """At most one current term; one row: how many are flagged and which one the reports use."""
    cur = terms.filter(F.col("is_current") == 1)
    return cur.agg(F.count(F.lit(1)).alias("current_terms"),
                   F.min("term_id").alias("term_used"),
                   (F.count(F.lit(1)) <= 1).alias("ok"))


def boarding_fee_check(boarding_fee: DataFrame) -> DataFrame:
    """One boarding-fee row; one row: how many rows, which amount the pages use (min as tie rule)."""
    return boarding_fee.agg(F.count(F.lit(1)).alias("rows"),
                            F.coalesce(F.min("amount"), F.lit(0)).cast("decimal(18,2)").alias("amount_used"),
                            (F.count(F.lit(1)) == 1).alias("ok"))


def current_term_label(terms: DataFrame) -> DataFrame:
    """X2 on the dashboard: 'Term n, yyyy' of the current term, else 'No term set'. One row."""
    cur = terms.filter(F.col("is_current") == 1)
    first = cur.agg(F.min_by(F.struct("term_number", "academic_year"), F.col("term_id")).alias("t"))
    return first.select(term_label("t.term_number", "t.academic_year", NO_TERM_LABEL).alias("term_label"))
