"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm.common import cut, small_batches

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Sketch cells keep so many leading binary digits: a value is off by less than 1 part in 64.
DIGITS = 7
#: A group needs so many documents for thresholds of its own; else its language's are taken, else all.
MIN_GROUP = 200
#: A document fails beyond the quartile plus FENCE times the interquartile range ...
FENCE = 6
#: ... and only if it is also this far (in thousandths) from the quartile: uniform groups stay whole.
SLACK = {"symbol_rate": 100, "dup_line_rate": 50, "repeat_rate": 300, "word_length": 3000}

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() parts at exactly the six ASCII white spaces
    spaces = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        last = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return (len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = pd.DataFrame([text_counts(t) for t in pdf["text"]],
                              columns=[c.split()[0] for c in COUNTS.split(", ")])
        yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), counts], axis=1)


def rates() -> dict[str, Column]:
    """Whole thousandths per word, so that sketches and comparisons are exact."""
    of = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words",
          "word_length": "word_chars"}
    return {name: F.expr(f"{count} * 1000 div greatest(n_words, 1)") for name, count in of.items()}


def cell(value: str) -> Column:
    """Log-linear sketch cell: the value with all but its ``DIGITS`` leading binary digits set to 0."""
    return F.expr(f"shiftleft(shiftright({value}, greatest(length(bin({value})) - {DIGITS}, 0)), "
                  f"greatest(length(bin({value})) - {DIGITS}, 0))")


def sketches(features: DataFrame) -> DataFrame:
    """lang, source, metric, cell, n: a sparse histogram per group, merged by adding counts.

    A metric has at most some 64 cells per binary order of magnitude, whatever the number of rows.
    """
    metric = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value"))
                                 for k, v in rates().items()))).alias("m")
    return (features.filter("not base_failed").select("lang", "source", metric)
            .groupBy("lang", "source", F.col("m.metric").alias("metric"), cell("m.value").alias("cell"))
            .agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that hold the first and third quartile of each group, and the group's rows."""
    merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
    walk = Window.partitionBy(*keys, "metric").orderBy("cell")
    whole = Window.partitionBy(*keys, "metric")
    return (merged.withColumn("upto", F.sum("n").over(walk)).withColumn("total", F.sum("n").over(whole))
            .groupBy(*keys, "metric")
            .agg(F.max("total").alias("total"),
                 F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("cell"))).alias("q1"),
                 F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("cell"))).alias("q3")))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """lang, source, and per metric its upper limit (for word_length also ``word_length_low``).

    One row for each group of the sketch; a group with fewer than ``min_group`` documents takes the
    merged sketch of its language, and if that is too small the sketch of everything.
    """
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select("lang", "metric", *(F.col(c).alias(f"l_{c}") for c in ("total", "q1", "q3")))
    every = _quartiles(sketch, []).select("metric", *(F.col(c).alias(f"a_{c}") for c in ("q1", "q3")))
    chosen = own.join(lang, own["lang"].eqNullSafe(lang["lang"]) & (own["metric"] == lang["metric"])) \
        .drop(lang["lang"]).drop(lang["metric"]).join(F.broadcast(every), "metric")  # one row per metric
    pick = {q: F.when(F.col("total") >= min_group, F.col(q)).when(F.col("l_total") >= min_group, F.col(f"l_{q}"))
            .otherwise(F.col(f"a_{q}")) for q in ("q1", "q3")}
    slack = F.element_at(F.create_map(*(F.lit(x) for kv in SLACK.items() for x in kv)), F.col("metric"))
    limits = (chosen.withColumns({"lo": pick["q1"], "hi": pick["q3"]})
              .withColumn("reach", F.greatest((F.col("hi") - F.col("lo")) * fence, slack)))
    at = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return limits.groupBy("lang", "source").agg(
        *(at(m, F.col("hi") + F.col("reach")).alias(f"{m}_max") for m in SLACK),
        at("word_length", F.col("lo") - F.col("reach")).alias("word_length_min"))


def quality_rules(documents: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """doc_id, lang, source, the counts of ``text_counts``, base_failed, the metrics, kept.

    ``base_failed``: under 50 words, or over half of them inside repeated 3-word windows. The others
    give one quantile sketch per language, source and metric; its quartiles set the limits beyond which
    a document is an outlier of its own group, and the limits are joined back to filter. Limits are
    fences, not fixed shares, so a group of like documents loses none.

    Texts are read once: the counts are cut into the checkpoint folder, and both the sketches and the
    filter start from there. Sketches are summed before the shuffle, so a source with a third of the
    rows costs as much as any other; the join is left to skew handling. Null language or source form
    groups of their own. A null or empty text has all counts 0 and fails the base rule. Repeated rows
    count and are judged one by one; an empty table gives no rows.
    """
    small_batches(documents)
    columns = [F.col(c) for c in ("doc_id", "lang", "source", "text")]
    narrow = documents.select(*columns)
    fields = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    features = cut(narrow.mapInPandas(_count, f"{fields}, {COUNTS}").withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")))
    limits = thresholds(sketches(features), min_group, fence)
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    judged = features.withColumns(rates()).join(
        limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & (F.col(m) <= F.col(f"{m}_max"))
    inside = inside & (F.col("word_length") >= F.col("word_length_min"))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", *SLACK,
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
