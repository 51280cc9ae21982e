"""F4 and F6 for a whole table of search terms: how each of them resolves.

Names are compared through an inverted index of their runs of one to three letters. A term's pattern is looked up
under the rarest run among its literal parts, and only the names found there are matched. A pattern of wildcards alone only
asks for a length, which a count of names by length answers. So no term meets every name, and each answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bursar.functions.formats import php_trim, text_key
from bursar.operators.staging import staged
from bursar.operators.students import student_details
from bursar.sources import schemas
from bursar.sources.tables import conform

LETTERS = 3


def _runs(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text."""
    n = F.char_length(text) - (size - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(text, k, F.lit(size))))


def _literals(pattern: Column) -> Column:
    """The parts of a LIKE pattern between its wildcards, escapes resolved: an array of texts.

    An escaped character stands for itself. Escaped wildcards and backslashes are replaced by control characters before
    the pattern is cut at the wildcards, and put back after.
    """
    kept = pattern
    for mark, escaped in (("\x01", "\\\\"), ("\x02", "\\%"), ("\x03", "\\_")):
        kept = F.replace(kept, F.lit(escaped), F.lit(mark))
    parts = F.split(F.replace(kept, F.lit("\\"), F.lit("")), "[%_]")
    return F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\x01"), F.lit("\\")), F.lit("\x02"), F.lit("%")),
                                                  F.lit("\x03"), F.lit("_")))


def _like_pattern(term: Column) -> Column:
    """The term with every backslash that escapes neither a wildcard nor a backslash made harmless, as MySQL reads it: it
    is dropped, and at the end it stands for itself."""
    pairs = F.regexp_replace(term, r"(\\[%_\\])|\\([^%_\\])", "$1$2")  # pair by pair from the left
    return F.when(F.length(F.regexp_extract(pairs, r"(\\+)$", 1)) % 2 == 1, F.concat(pairs, F.lit("\\"))).otherwise(pairs)


def _name_counts(names: DataFrame, asked: DataFrame) -> DataFrame:
    """search, named: how many students' names match each distinct pattern of ``asked`` (search, pattern)."""
    literal = staged(asked.withColumn("parts", _literals(F.col("pattern"))))
    index = names.select("name", "n", F.explode(F.concat(*(_runs(F.col("name"), k) for k in range(1, LETTERS + 1)))).alias("run"))
    index = staged(index.filter("run <> ''").dropDuplicates(["name", "run"]))
    # Of each part its longest runs; a part of one or two letters is a run itself.
    runs = (literal.select("search", "pattern", F.explode("parts").alias("part")).filter("part <> ''")
            .withColumn("run", F.explode(F.when(F.char_length("part") < LETTERS, F.array("part")).otherwise(_runs(F.col("part"), LETTERS)))))
    rarity = index.groupBy("run").agg(F.count(F.lit(1)).alias("names"))
    rarest = staged(runs.join(rarity, "run", "left").groupBy("search", "pattern")
                    .agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "run")).alias("r"))
                    .select("search", "pattern", F.col("r.run").alias("run")))
    found = (rarest.join(index, "run").filter(F.expr("name like concat('%', pattern, '%')"))
             .groupBy("search").agg(F.sum("n").alias("named")))
    # Wildcards alone: at least so many characters as there are underscores, of names of any kind.
    length = F.char_length(F.regexp_replace("pattern", "%", ""))
    blank = (literal.filter(~F.exists("parts", lambda p: p != F.lit(""))).filter("search <> ''").select("search", length.alias("least")))
    by_length = names.groupBy(F.char_length("name").alias("length")).agg(F.sum("n").alias("n"))
    # Both sides are bounded by the length of a name or a term, whatever the tables.
    least = blank.select("least").distinct()
    longer = (least.select("least", F.explode(F.sequence("least", F.greatest(F.col("least"), F.lit(_longest(names))))).alias("length"))
              .join(by_length, "length").groupBy("least").agg(F.sum("n").alias("named")))
    return found.unionByName(blank.join(longer, "least").select("search", "named"))


def _longest(names: DataFrame) -> int:
    return names.agg(F.coalesce(F.max(F.char_length("name")), F.lit(0))).first()[0]


def search_outcomes(students: DataFrame, classes: DataFrame, terms: DataFrame) -> DataFrame:
    """term_key, search_term, match_count, outcome of every row of ``terms`` (term_key, admission_number, search).

    An admission number, if one is given, wins: 'found' or 'not_found'. Otherwise a student matches whose number equals the
    term or whose name contains it, wildcards kept and letter case aside: 'none', 'one' or 'many'. Students without a class
    row are not found. Equal terms are answered once.
    """
    t = conform(terms, schemas.SEARCH_TERMS).select(
        "term_key", php_trim(F.coalesce("admission_number", F.lit(""))).alias("number"), php_trim(F.coalesce("search", F.lit(""))).alias("search"))
    details = student_details(students, classes).select("student_id", text_key("admission_number").alias("key"), text_key("full_name").alias("name"))
    wanted = staged(t.select(F.when(F.col("number") != "", F.col("number")).otherwise(F.lit("")).alias("number"),
                             F.when(F.col("number") != "", F.lit("")).otherwise(F.col("search")).alias("search")).distinct()
                    .filter("number <> '' or search <> ''"))
    asked = staged(wanted.filter("search <> ''").select("search", text_key(_like_pattern(F.col("search"))).alias("pattern")))
    names = staged(details.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    named = _name_counts(names, asked)
    # Students found by their number: all of them for a number, and for a search those whose name does not match anyway.
    keyed = wanted.select("number", "search", text_key(F.concat("number", "search")).alias("key")).join(details, "key")
    like = F.expr("coalesce(name like concat('%', pattern, '%'), false)")
    numbered = (keyed.join(asked, "search", "left").filter((F.col("number") != "") | ~like)
                .groupBy("number", "search").agg(F.count(F.lit(1)).alias("numbered")))
    answers = (wanted.join(numbered, ["number", "search"], "left").join(named, "search", "left")
               .select("number", "search", (F.coalesce("numbered", F.lit(0)) + F.coalesce("named", F.lit(0))).alias("n")))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    by_number = F.col("number") != ""
    keys = t.withColumn("_s", F.when(by_number, F.lit("")).otherwise(F.col("search")))
    return (keys.join(answers.withColumnRenamed("search", "_s"), ["number", "_s"], "left")
            .select("term_key", F.when(by_number, F.col("number")).otherwise(F.col("search")).alias("search_term"), n.alias("match_count"),
                    F.when(by_number, F.when(n > 0, "found").otherwise("not_found"))
                    .otherwise(F.when(n == 0, "none").when(n == 1, "one").otherwise("many")).alias("outcome")))
