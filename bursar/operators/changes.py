"""Table changes as batch jobs.

The reference changes one row per POST. Here a *batch* of commands (one row each, ``seq`` = arrival
order) is applied to a base table in one Spark job:

    apply_x(base, commands, ...) -> Applied(table=new base version, rejects=commands refused + reason)

Validation runs column-wise, in the reference's order; the first failing rule names the reason.
Per-key resolution ("last edit wins", "first registration wins") uses ``max_by`` / ``min_by``
aggregates, which combine map-side, so a key carrying a large share of the commands is reduced before
the shuffle and never gathered into one task. New keys continue after the base's largest key, offset by
the command's dense position in the batch (by ``seq``; commands with the same ``seq`` have positions of
their own), so every command is accounted for and reruns give equal ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bursar.operators.numbering import numbered
from bursar.operators.staging import staged
from bursar.functions.formats import ACTIVE, is_php_empty, php_trim, receipt_number, text_key
from bursar.sources import schemas
from bursar.sources.tables import conform


@dataclass
class Applied:
    """Result of a change job.

    ``table`` is the complete new version. For insert-only jobs ``added`` holds just the new rows:
    at scale, append those to the table's folder instead of rewriting the table.
    """
    table: DataFrame
    rejects: DataFrame
    added: DataFrame | None = None


def _reason(*rules: tuple[Column, str]) -> Column:
    """First failing rule's reason, or null when the command is valid."""
    expr = None
    for failed, reason in rules:
        expr = F.when(failed, F.lit(reason)) if expr is None else expr.when(failed, F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


def _split(commands: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    tagged = commands.withColumn("reject_reason", reason)
    ok = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.filter(F.col("reject_reason").isNotNull())
    return ok, bad


def _rejects(bad: DataFrame, key: str | None = None) -> DataFrame:
    cols = ["seq"] + ([key] if key else []) + ["reject_reason"]
    return bad.select(*cols)


POSITION = "_pos"


def _positioned(commands: DataFrame) -> DataFrame:
    """Commands with their dense position in the batch, the identity of a command from here on."""
    return numbered(commands, ["seq"], POSITION)


def _new_ids(base: DataFrame, key: str) -> Column:
    """Key for a new row: base max + the command's position."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return top + F.col(POSITION)


def _last_by_key(commands: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Latest command per key (highest seq; of equal seq the largest values): one row per key, ``seq`` kept."""
    latest = F.max(F.struct(F.col("seq"), *[F.col(c) for c in cols]))
    return commands.groupBy(key).agg(latest.alias("_c")).select(key, "_c.*")


def _first_by_key(commands: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """First command per key by position: one row per key, the position kept."""
    first = F.min_by(F.struct(F.col(POSITION), *[F.col(c) for c in cols]), F.col(POSITION))
    return commands.groupBy(*keys).agg(first.alias("_c")).select(*keys, "_c.*")


def _present(base: DataFrame, commands: DataFrame, keys: list[str]) -> DataFrame:
    """The commands' keys that the base has, marked ``_present``: at most one row per command.

    The commands' distinct keys are written first, so their size is known: up to the session's broadcast
    threshold they meet the base where it lies, which is then neither sorted nor shuffled.
    """
    wanted = staged(commands.select(*keys).distinct())
    return base.select(*keys).join(wanted, keys).distinct().withColumn("_present", F.lit(True))


def _replace(base: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Apply one change row per key; fields are replaced even when the new value is blank.

    Unknown keys change nothing (a left join from the base). The base keeps its partitioning by
    ``key`` for the join; the changes side holds at most one row per key.
    """
    ch = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    joined = base.join(ch, key, "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols
           else F.col(c) for c in base.columns]
    return joined.select(*out)


def _unknown_keys(commands: DataFrame, base: DataFrame, key: str, reason: str | None = None) -> DataFrame:
    """Commands whose key is not in the base: a silent no-op in the reference, reported here."""
    return (commands.join(_present(base, commands, [key]), key, "left_anti")
                    .withColumn("reject_reason", F.lit(reason or "unknown_" + key.replace("_id", "")))
                    .select("seq", key, "reject_reason"))


# ----------------------------------------------------------------------------------------- students

def apply_registrations(students: DataFrame, commands: DataFrame) -> Applied:
    """M1 registration: trim; admission, name and class required ('0' counts as empty);
    admission numbers unique against the table and, within the batch, the first valid command wins."""
    c = _positioned(conform(commands, schemas.REGISTRATION_COMMANDS))
    c = c.withColumns({k: php_trim(k) for k in ("admission_number", "full_name", "guardian_name",
                                                "guardian_phone")})
    missing = is_php_empty("admission_number") | is_php_empty("full_name") | is_php_empty("class_id")
    valid, bad = _split(c, _reason((missing, "missing_fields")))
    # The unique index compares in the default (case-insensitive) collation.
    valid = valid.withColumn("_adm_key", text_key("admission_number"))
    existing = students.select(text_key("admission_number").alias("_adm_key"))
    marked = valid.join(_present(existing, valid, ["_adm_key"]), "_adm_key", "left")
    fresh = marked.filter(F.col("_present").isNull()).drop("_present")
    taken = marked.filter(F.col("_present"))
    cols = [f.name for f in schemas.REGISTRATION_COMMANDS.fields if f.name != "seq"]
    winners = _first_by_key(fresh, ["_adm_key"], cols).drop("_adm_key")
    losers = fresh.join(winners.select(POSITION), POSITION, "left_anti")
    new_rows = winners.withColumns({
        "student_id": _new_ids(students, "student_id"),
        "is_boarder": F.coalesce(F.col("is_boarder"), F.lit(0)),
        "status": F.lit(ACTIVE),
    })
    added = conform(new_rows, schemas.STUDENTS)
    table = students.unionByName(added)
    rejects = (_rejects(bad, "admission_number")
               .unionByName(taken.select("seq", "admission_number",
                                         F.lit("admission_exists").alias("reject_reason")))
               .unionByName(losers.select("seq", "admission_number",
                                          F.lit("admission_exists").alias("reject_reason"))))
    return Applied(table, rejects, added)


# The columns the student, payment and item pages edit (here and below).
STUDENT_EDIT_COLUMNS = ["full_name", "gender", "date_of_birth", "class_id", "is_boarder",
                        "guardian_name", "guardian_phone", "status"]


def apply_student_updates(students: DataFrame, commands: DataFrame) -> Applied:
    """M2 student edits: eight columns replaced, admission number fixed; last command per student
    wins; no validation (as the reference); unknown ids change nothing."""
    c = conform(commands, schemas.STUDENT_UPDATE_COMMANDS)
    c = c.withColumns({k: php_trim(k) for k in ("full_name", "guardian_name", "guardian_phone")})
    c = c.withColumn("is_boarder", F.coalesce(F.col("is_boarder"), F.lit(0)))
    latest = _last_by_key(c, "student_id", STUDENT_EDIT_COLUMNS)
    table = _replace(students, latest, "student_id", STUDENT_EDIT_COLUMNS)
    return Applied(table, _unknown_keys(c, students, "student_id"))


@dataclass
class Cascade:
    students: DataFrame
    payments: DataFrame
    discounts: DataFrame
    issues: DataFrame


def apply_student_deletes(students: DataFrame, payments: DataFrame, discounts: DataFrame,
                          issues: DataFrame, commands: DataFrame) -> Cascade:
    """M3 student deletion: the students and, in the same change set, their payments, discounts and
    uniform issues (J13: four anti joins). Publish with ``sources.tables.write_versions``."""
    gone = conform(commands, schemas.KEY_COMMANDS_STUDENT).select("student_id").distinct()
    return Cascade(*(t.join(gone, "student_id", "left_anti")
                     for t in (students, payments, discounts, issues)))


# ----------------------------------------------------------------------------------------- payments

def _bad_amount(col: str) -> Column:
    return F.col(col).isNull() | (F.col(col) <= 0)


def apply_payments(payments: DataFrame, commands: DataFrame, today: str | None = None) -> Applied:
    """M4 new payments: amount required and > 0 (no check against the balance, as the
    reference); new payment ids follow the largest; receipt number derived from date and id."""
    c = _positioned(conform(commands, schemas.PAYMENT_COMMANDS)).withColumn("received_by", php_trim("received_by"))
    valid, bad = _split(c, _reason((_bad_amount("amount_paid"), "invalid_amount")))
    day = F.to_date(F.lit(today)) if today else F.current_date()
    new = (valid.withColumn("payment_id", _new_ids(payments, "payment_id"))
                .withColumn("date_paid", F.coalesce(F.col("date_paid"), day)))
    new = new.withColumn("receipt_number", receipt_number("date_paid", "payment_id"))
    added = conform(new, schemas.FEE_PAYMENTS)
    return Applied(payments.unionByName(added), _rejects(bad, "student_id"), added)


PAYMENT_EDIT_COLUMNS = ["amount_paid", "payment_method", "received_by"]


def apply_payment_edits(payments: DataFrame, commands: DataFrame) -> Applied:
    """M5 payment edits: amount > 0 required; last valid edit per payment wins."""
    c = conform(commands, schemas.PAYMENT_EDIT_COMMANDS).withColumn("received_by", php_trim("received_by"))
    valid, bad = _split(c, _reason((_bad_amount("amount_paid"), "invalid_amount")))
    latest = _last_by_key(valid, "payment_id", PAYMENT_EDIT_COLUMNS)
    table = _replace(payments, latest, "payment_id", PAYMENT_EDIT_COLUMNS)
    rejects = _rejects(bad, "payment_id").unionByName(_unknown_keys(valid, payments, "payment_id"))
    return Applied(table, rejects)


def apply_payment_deletes(payments: DataFrame, commands: DataFrame) -> Applied:
    """M6 payment deletion: anti join on payment_id; unknown ids are reported, nothing else."""
    c = conform(commands, schemas.KEY_COMMANDS_PAYMENT)
    table = payments.join(c.select("payment_id"), "payment_id", "left_anti")
    return Applied(table, _unknown_keys(c, payments, "payment_id"))


def apply_discounts(discounts: DataFrame, students: DataFrame, terms: DataFrame,
                    commands: DataFrame, today: str | None = None) -> Applied:
    """M7 new discounts: amount > 0, then an approver; the table's foreign keys (student, term)
    refuse orphans (J14). No cap at the amount due, as in the reference."""
    c = _positioned(conform(commands, schemas.DISCOUNT_COMMANDS)).withColumns(
        {"reason": php_trim("reason"), "approved_by": php_trim("approved_by")})
    known_s = _present(students, c, ["student_id"]).withColumnRenamed("_present", "_s")
    known_t = _present(terms, c, ["term_id"]).withColumnRenamed("_present", "_t")
    c = c.join(known_s, "student_id", "left").join(known_t, "term_id", "left")
    reason = _reason((_bad_amount("discount_amount"), "invalid_amount"),
                     (is_php_empty("approved_by"), "missing_approver"),
                     (F.col("_s").isNull(), "unknown_student"),
                     (F.col("_t").isNull(), "unknown_term"))
    valid, bad = _split(c, reason)
    day = F.to_date(F.lit(today)) if today else F.current_date()
    new = (valid.withColumn("discount_id", _new_ids(discounts, "discount_id"))
                .withColumn("date_given", F.coalesce(F.col("date_given"), day)))
    added = conform(new, schemas.FEE_DISCOUNTS)
    return Applied(discounts.unionByName(added), _rejects(bad, "student_id"), added)


# -------------------------------------------------------------------------------------------- terms

def apply_new_terms(terms: DataFrame, commands: DataFrame) -> Applied:
    """M8 new terms: (year, term) unique against the table and within the batch; starts not current."""
    c = _positioned(conform(commands, schemas.TERM_COMMANDS))
    valid, bad = _split(c, _reason(
        (F.col("academic_year").isNull() | F.col("term_number").isNull(), "missing_fields")))
    pair = ["academic_year", "term_number"]
    marked = valid.join(_present(terms, valid, pair), pair, "left")
    fresh = marked.filter(F.col("_present").isNull()).drop("_present")
    taken = marked.filter(F.col("_present"))
    winners = _first_by_key(fresh, pair, [])
    losers = fresh.join(winners.select(POSITION), POSITION, "left_anti")
    new = winners.withColumns({"term_id": _new_ids(terms, "term_id").cast("int"),
                               "is_current": F.lit(0)})
    rejects = (_rejects(bad).unionByName(taken.select("seq", F.lit("term_exists").alias("reject_reason")))
               .unionByName(losers.select("seq", F.lit("term_exists").alias("reject_reason"))))
    added = conform(new, schemas.ACADEMIC_TERMS)
    return Applied(terms.unionByName(added), rejects, added)


def set_current_term(terms: DataFrame, term_id: int) -> DataFrame:
    """M9 set the current term: flag exactly the given term. An unknown id leaves no current term, as the
    reference's unconditional reset does."""
    return terms.withColumn("is_current",
                            F.when(F.col("term_id") == F.lit(term_id), F.lit(1)).otherwise(F.lit(0)))


# ------------------------------------------------------------------------------------- fee defaults

# The four fee rows the fee page seeds when missing (key, label, amount).
FEE_DEFAULT_SEED = [
    ("boarding", "Boarding", 350000),
    ("upper_primary", "Upper Primary", 90000),
    ("lower_primary", "Lower Primary", 90000),
    ("nursery", "Nursery", 80000),
]


def seed_fee_defaults(fee_defaults: DataFrame) -> DataFrame:
    """Add each seed row whose key is missing; existing amounts are kept."""
    spark = fee_defaults.sparkSession
    seed = spark.createDataFrame(FEE_DEFAULT_SEED, schemas.FEE_DEFAULTS)
    return fee_defaults.unionByName(seed.join(fee_defaults.select("fee_key"), "fee_key", "left_anti"))


def apply_fee_default_updates(fee_defaults: DataFrame, commands: DataFrame) -> Applied:
    """M11 fee default edits: key non-empty and amount >= 0; last valid per key wins; unknown keys no-op."""
    c = conform(commands, schemas.FEE_DEFAULT_COMMANDS)
    c = c.withColumn("amount", F.coalesce(F.col("amount"), F.lit(0)))
    valid, bad = _split(c, _reason(
        ((F.col("fee_key").isNull()) | (F.col("fee_key") == ""), "invalid_fee"),
        (F.col("amount") < 0, "invalid_fee")))
    latest = _last_by_key(valid, "fee_key", ["amount"])
    table = _replace(fee_defaults, latest, "fee_key", ["amount"])
    return Applied(table, _rejects(bad, "fee_key").unionByName(
        _unknown_keys(valid, fee_defaults, "fee_key", "unknown_fee")))


# ------------------------------------------------------------------------------------------ uniforms

def apply_restock(items: DataFrame, commands: DataFrame) -> Applied:
    """M12 restocking: quantity > 0; valid quantities are summed per item (map-side), then added."""
    c = conform(commands, schemas.RESTOCK_COMMANDS)
    valid, bad = _split(c, _reason((F.col("add_quantity").isNull() | (F.col("add_quantity") <= 0),
                                    "invalid_quantity")))
    added = valid.groupBy("uniform_id").agg(F.sum("add_quantity").alias("_add"))
    table = (items.join(added, "uniform_id", "left")
                  .withColumn("quantity_in_stock",
                              (F.col("quantity_in_stock") + F.coalesce(F.col("_add"), F.lit(0))).cast("int"))
                  .select(*items.columns))
    rejects = _rejects(bad, "uniform_id").unionByName(_unknown_keys(valid, items, "uniform_id"))
    return Applied(table, rejects)


def _item_rules() -> Column:
    bad_name = is_php_empty("item_name")
    bad_price = F.col("price").isNull() | (F.col("price") < 0)
    return _reason((bad_name | bad_price, "invalid_item"))


def apply_new_items(items: DataFrame, commands: DataFrame) -> Applied:
    """M13 new uniform items: name non-empty, price given and >= 0; the opening stock is taken as given
    (negative included, as the reference does server-side)."""
    c = _positioned(conform(commands, schemas.ITEM_COMMANDS)).withColumn("item_name", php_trim("item_name"))
    valid, bad = _split(c, _item_rules())
    new = (valid.withColumn("uniform_id", _new_ids(items, "uniform_id"))
                .withColumn("quantity_in_stock", F.coalesce(F.col("initial_stock"), F.lit(0))))
    added = conform(new, schemas.UNIFORM_ITEMS)
    return Applied(items.unionByName(added), _rejects(bad), added)


ITEM_EDIT_COLUMNS = ["item_name", "applicable_section", "applicable_gender", "price"]


def apply_item_updates(items: DataFrame, commands: DataFrame) -> Applied:
    """M14 uniform item edits: same rules as M13; stock is not touched; last valid edit per item wins."""
    c = conform(commands, schemas.ITEM_COMMANDS).withColumn("item_name", php_trim("item_name"))
    valid, bad = _split(c, _item_rules())
    latest = _last_by_key(valid, "uniform_id", ITEM_EDIT_COLUMNS)
    table = _replace(items, latest, "uniform_id", ITEM_EDIT_COLUMNS)
    rejects = _rejects(bad, "uniform_id").unionByName(_unknown_keys(valid, items, "uniform_id"))
    return Applied(table, rejects)
