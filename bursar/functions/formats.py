"""Scalar column functions, all built from JVM-side ``pyspark.sql.functions``.

The reference evaluates these in PHP; the traps that matter (which characters ``trim`` strips, which
strings count as empty, half-up rounding) are reproduced column-wise, so they stay inside codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bursar.sources.schemas import RESULT_MONEY, TOTAL_MONEY

# These must equal the reference's for equal results.
# - the characters PHP's trim() strips by default (space, tab, newline, carriage return, NUL,
#   vertical tab);
# - term-label fall-backs shown when no current term exists;
# - the receipt-number prefix;
# - the student status the reports count, the stock level counted as low, and the wildcard value
#   of an item's section / gender.
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
NO_TERM_LABEL = "No term set"
NO_CURRENT_TERM_LABEL = "No current term set"
NOT_AVAILABLE = "N/A"
RECEIPT_PREFIX = "RCT-"
ACTIVE = "Active"
LOW_STOCK_LIMIT = 5
ALL = "All"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def php_trim(col: Column | str) -> Column:
    """Strip the six PHP whitespace characters from both ends (Spark's trim strips spaces only)."""
    return F.btrim(_c(col), F.lit(PHP_TRIM_CHARS))


def _folding() -> tuple[str, str]:
    """For translate(): small Latin letters with marks, and the letters without; marks that stand alone go."""
    letters = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]
               if chr(c).islower()}
    folded = {c: base for c, base in letters.items() if base != c and base.isascii()}
    return "".join(folded) + "".join(map(chr, range(0x300, 0x370))), "".join(folded.values())


_MARKED, _PLAIN = _folding()


def text_key(col: Column | str) -> Column:
    """Comparison and sort key for text that the reference compares in MySQL's default collation, which minds neither
    letter case nor accents: names, admission numbers, searches and the unique index.

    Spark's own accent-insensitive collations compare the same way, but not under LIKE, and a collated column has
    no plain key to hand to a task or a file; so the key is made, and everything else is a plain comparison of it.
    """
    return F.translate(F.lower(_c(col)), _MARKED, _PLAIN)


def is_php_empty(col: Column | str) -> Column:
    """PHP ``empty()`` on a form value: null, '' and '0' are empty."""
    c = _c(col).cast("string")
    return c.isNull() | (c == F.lit("")) | (c == F.lit("0"))


def falsy_default(col: Column | str, fallback: Column | str) -> Column:
    """PHP ``a ?: b``."""
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(is_php_empty(col), fb).otherwise(_c(col).cast("string"))


def term_label(term_number: Column | str, academic_year: Column | str,
               fallback: str = NO_TERM_LABEL) -> Column:
    """X2: 'Term n, yyyy', or the page's fall-back text when there is no term."""
    t, y = _c(term_number), _c(academic_year)
    label = F.concat(F.lit("Term "), t.cast("string"), F.lit(", "), y.cast("string"))
    return F.when(t.isNull() | y.isNull(), F.lit(fallback)).otherwise(label)


def short_term_label(term_number: Column | str, academic_year: Column | str) -> Column:
    """X3: 'Tn yyyy'."""
    return F.concat(F.lit("T"), _c(term_number).cast("string"), F.lit(" "),
                    _c(academic_year).cast("string"))


def class_label(class_name: Column | str, section: Column | str) -> Column:
    """X4: 'name (section)'."""
    return F.concat(_c(class_name), F.lit(" ("), _c(section), F.lit(")"))


def money_text(col: Column | str) -> Column:
    """PHP number_format(x): rounded half up to whole units, thousands separated by commas.

    ``format_number`` alone rounds half-even, so round half-up first.
    """
    return F.format_number(F.round(_c(col), 0), 0)


def yes_no(col: Column | str) -> Column:
    """Flag -> 'Yes' / 'No' (PHP truthiness of 0/1)."""
    return F.when(_c(col).cast("int") == 1, F.lit("Yes")).otherwise(F.lit("No"))


def first_name(col: Column | str) -> Column:
    """First space-separated token."""
    return F.substring_index(_c(col), " ", 1)


def sum_or_zero(col: Column | str) -> Column:
    """COALESCE(SUM(x), 0) as an exact decimal, wide enough for any table."""
    return F.coalesce(F.sum(_c(col)), F.lit(0)).cast(TOTAL_MONEY)


def php_int(col: Column | str) -> Column:
    """X11: (int) of a form value. Text that is not an integer is rejected (null), on purpose."""
    return F.expr(f"try_cast({_sql(col)} AS INT)") if isinstance(col, str) else col.try_cast("int")


def _sql(col: str) -> str:
    return f"`{col}`"


def ymd(col: Column | str) -> Column:
    """date('Ymd')."""
    return F.date_format(_c(col), "yyyyMMdd")


def receipt_number(date_col: Column | str, key_col: Column | str) -> Column:
    """X13: 'RCT-yyyymmdd-nnnn'. The reference draws nnnn at random (1000-9999, unchecked); ours is
    derived from the new row's key, so a rerun gives the same receipt."""
    suffix = F.lit(1000) + F.pmod(_c(key_col), F.lit(9000))
    return F.concat(F.lit(RECEIPT_PREFIX), ymd(date_col), F.lit("-"), suffix.cast("string"))


def payment_state(balance: Column | str) -> Column:
    """P4: 'owing' when something is still due, else 'paid' (overpaid counts as paid-up)."""
    return F.when(_c(balance) > 0, F.lit("owing")).otherwise(F.lit("paid"))


def money(col: Column | str) -> Column:
    """Cast to the result money type, DECIMAL(18,2)."""
    return _c(col).cast(RESULT_MONEY)


def total_money(col: Column | str) -> Column:
    """Cast to the type of whole-table totals, DECIMAL(38,2)."""
    return _c(col).cast(TOTAL_MONEY)
