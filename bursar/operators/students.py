"""Student head-counts, lookup, search and directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import ACTIVE, PHP_TRIM_CHARS, php_trim, text_key

_DETAIL_CLASS_COLUMNS = ["class_name", "section", "term_fee"]


def class_counts(students: DataFrame, classes: DataFrame) -> DataFrame:
    """Active students per class; an empty class gives 0.

    The status test sits in the reference's ON clause, so it filters students *before* the outer
    join. Students are counted per class first (partial aggregation, so a crowded class is combined
    map-side), then the class list is left-joined to the counts.
    """
    per_class = (students.filter(F.col("status") == ACTIVE)
                         .groupBy("class_id").agg(F.count("student_id").alias("n")))
    return (classes.select("class_id", "class_name", "section")
                   .join(per_class, "class_id", "left")
                   .select("class_id", "class_name", "section",
                           F.coalesce("n", F.lit(0)).cast("bigint").alias("student_count"))
                   .orderBy("class_id"))


def class_counts_total(students: DataFrame, classes: DataFrame) -> DataFrame:
    """A4: school total of class_counts (active students whose class row exists). One row."""
    return (class_counts(students, classes)
            .agg(F.coalesce(F.sum("student_count"), F.lit(0)).cast("bigint").alias("total_students")))


def student_details(students: DataFrame, classes: DataFrame) -> DataFrame:
    """``s.*`` plus the class columns; students without a class row drop out."""
    return students.join(classes.select("class_id", *_DETAIL_CLASS_COLUMNS), "class_id")


def student_lookup(students: DataFrame, classes: DataFrame, admission_number: str) -> DataFrame:
    """exact admission-number lookup; the input is trimmed first (PHP trim); case-insensitive as
    under MySQL's default collation."""
    key = text_key(php_trim(F.lit(admission_number)))
    return student_details(students, classes).filter(text_key("admission_number") == key)


_PHP_WS = PHP_TRIM_CHARS


def _pattern(term: str) -> str:
    """The term as a LIKE pattern: a backslash before a wildcard or another backslash escapes it, and before
    any other character it is dropped, as MySQL reads patterns; at the end it stands for itself."""
    out, k = [], 0
    while k < len(term):
        if term[k] == "\\":
            following = term[k + 1:k + 2]
            out.append("\\" + following if following in ("%", "_", "\\") and following else following or "\\\\")
            k += 2
        else:
            out.append(term[k])
            k += 1
    return "".join(out)


def _contains(col: str, term: str):
    # '%' and '_' typed by the user stay wildcards (the reference does not escape them);
    # matching minds neither case nor accents, as under MySQL's default collation.
    pattern = F.lit(f"%{_pattern(term.strip(_PHP_WS))}%")
    return F.like(text_key(col), text_key(pattern))


def student_search(students: DataFrame, classes: DataFrame, term: str) -> DataFrame:
    """exact admission number OR name contains the term (any status)."""
    t = term.strip(_PHP_WS)
    if t == "":
        return student_details(students, classes).limit(0)
    hit = (text_key("admission_number") == text_key(F.lit(t))) | _contains("full_name", t)
    return (student_details(students, classes).filter(hit)
            .orderBy("class_id", text_key("full_name"), "student_id"))


def student_search_outcome(students: DataFrame, classes: DataFrame, term: str,
                           admission_number: str | None = None) -> DataFrame:
    """how a lookup resolves. An exact admission number, when given (non-empty after trim), wins
    over the search term: 'found' or 'not_found'. Otherwise the search: 'none', 'one' (open the
    record) or 'many' (pick from a list). One row."""
    n = F.count(F.lit(1))
    adm = (admission_number or "").strip(_PHP_WS)
    if adm:
        hits = student_lookup(students, classes, adm)
        return hits.agg(F.lit(adm).alias("search_term"), n.cast("bigint").alias("match_count"),
                        F.when(n == 0, F.lit("not_found")).otherwise(F.lit("found")).alias("outcome"))
    hits = student_search(students, classes, term)
    return hits.agg(F.lit(term.strip(_PHP_WS)).alias("search_term"),
                    n.cast("bigint").alias("match_count"),
                    F.when(n == 0, F.lit("none")).when(n == 1, F.lit("one"))
                     .otherwise(F.lit("many")).alias("outcome"))


def student_directory(students: DataFrame, classes: DataFrame, search: str = "",
                      class_id: int | None = None) -> DataFrame:
    """Name OR admission number contains the term, optionally one class; empty term or
    class means no predicate. Ordered by class, then name."""
    df = student_details(students, classes)
    if search.strip(_PHP_WS) != "":
        df = df.filter(_contains("full_name", search) | _contains("admission_number", search))
    if class_id is not None:
        df = df.filter(F.col("class_id") == F.lit(class_id))
    return df.orderBy("class_id", text_key("full_name"), "full_name", "student_id")
