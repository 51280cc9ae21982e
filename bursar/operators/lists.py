"""Plain ordered lists: classes, terms, fee defaults, staff roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import short_term_label, term_label, text_key


def class_list(classes: DataFrame) -> DataFrame:
    """Classes in school order (class_id)."""
    return classes.select("class_id", "class_name", "section").orderBy("class_id")


def term_list(terms: DataFrame) -> DataFrame:
    """Terms newest first, with labels."""
    return (terms.select("term_id", "academic_year", "term_number", "is_current",
                         term_label("term_number", "academic_year").alias("term_label"),
                         short_term_label("term_number", "academic_year").alias("term_short"))
                 .orderBy(F.desc("academic_year"), F.desc("term_number"), "term_id"))


def fee_default_list(fee_defaults: DataFrame) -> DataFrame:
    """Fee defaults by label."""
    return fee_defaults.select("fee_key", "label", "amount").orderBy(text_key("label"), "fee_key")


def staff_roster(users: DataFrame) -> DataFrame:
    """Staff by role then username; no password hash is ever selected."""
    return users.select("user_id", "username", "full_name", "role").orderBy("role", "username")
