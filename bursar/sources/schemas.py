"""Declared schemas of the school tables (fixed, never inferred).

Money is DECIMAL in storage (12,2; discounts 10,2) and DECIMAL(18,2) in every computed result, so no
double arithmetic ever touches an amount. Flags are INT 0/1 as stored.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
DISCOUNT_MONEY = T.DecimalType(10, 2)
RESULT_MONEY = T.DecimalType(18, 2)
# Totals over whole tables: 10^12 rows of the largest amount stay far below the limit.
TOTAL_MONEY = T.DecimalType(38, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


STUDENTS = _schema(
    ("student_id", T.LongType(), False),
    ("admission_number", T.StringType(), False),
    ("full_name", T.StringType(), True),
    ("gender", T.StringType(), True),
    ("date_of_birth", T.DateType(), True),
    ("class_id", T.IntegerType(), True),
    ("is_boarder", T.IntegerType(), True),
    ("guardian_name", T.StringType(), True),
    ("guardian_phone", T.StringType(), True),
    ("status", T.StringType(), True),
)

CLASSES = _schema(
    ("class_id", T.IntegerType(), False),
    ("class_name", T.StringType(), True),
    ("section", T.StringType(), True),
    ("term_fee", MONEY, True),
)

ACADEMIC_TERMS = _schema(
    ("term_id", T.IntegerType(), False),
    ("academic_year", T.IntegerType(), True),
    ("term_number", T.IntegerType(), True),
    ("is_current", T.IntegerType(), True),
)

FEE_PAYMENTS = _schema(
    ("payment_id", T.LongType(), False),
    ("student_id", T.LongType(), True),
    ("term_id", T.IntegerType(), True),
    ("amount_paid", MONEY, True),
    ("payment_method", T.StringType(), True),
    ("received_by", T.StringType(), True),
    ("receipt_number", T.StringType(), True),
    ("date_paid", T.DateType(), True),
)

FEE_DISCOUNTS = _schema(
    ("discount_id", T.LongType(), False),
    ("student_id", T.LongType(), False),
    ("term_id", T.IntegerType(), False),
    ("discount_amount", DISCOUNT_MONEY, False),
    ("reason", T.StringType(), True),
    ("approved_by", T.StringType(), True),
    ("date_given", T.DateType(), True),
)

BOARDING_FEE = _schema(("amount", MONEY, True))

FEE_DEFAULTS = _schema(
    ("fee_key", T.StringType(), False),
    ("label", T.StringType(), False),
    ("amount", T.IntegerType(), False),
)

UNIFORM_ITEMS = _schema(
    ("uniform_id", T.LongType(), False),
    ("item_name", T.StringType(), True),
    ("applicable_section", T.StringType(), True),
    ("applicable_gender", T.StringType(), True),
    ("price", MONEY, True),
    ("quantity_in_stock", T.IntegerType(), True),
)

UNIFORM_ISSUES = _schema(
    ("issue_key", T.LongType(), True),
    ("student_id", T.LongType(), True),
    ("uniform_id", T.LongType(), True),
    ("quantity", T.IntegerType(), True),
    ("total_price", MONEY, True),
    ("amount_paid", MONEY, True),
    ("date_issued", T.DateType(), True),
)

# Staff roster: the password hash column is deliberately absent, so it is never read.
USERS = _schema(
    ("user_id", T.LongType(), False),
    ("username", T.StringType(), False),
    ("full_name", T.StringType(), True),
    ("role", T.StringType(), True),
)

TABLES: dict[str, T.StructType] = {
    "students": STUDENTS,
    "classes": CLASSES,
    "academic_terms": ACADEMIC_TERMS,
    "fee_payments": FEE_PAYMENTS,
    "fee_discounts": FEE_DISCOUNTS,
    "boarding_fee": BOARDING_FEE,
    "fee_defaults": FEE_DEFAULTS,
    "uniform_items": UNIFORM_ITEMS,
    "uniform_issues": UNIFORM_ISSUES,
    "users": USERS,
}

# Batch command tables for the change jobs. ``seq`` is the arrival order the
# reference gets implicitly from one POST after another.
PAYMENT_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("student_id", T.LongType(), True),
    ("term_id", T.IntegerType(), True),
    ("amount_paid", MONEY, True),
    ("payment_method", T.StringType(), True),
    ("received_by", T.StringType(), True),
    ("date_paid", T.DateType(), True),
)

PAYMENT_EDIT_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("payment_id", T.LongType(), True),
    ("amount_paid", MONEY, True),
    ("payment_method", T.StringType(), True),
    ("received_by", T.StringType(), True),
)

KEY_COMMANDS_PAYMENT = _schema(("seq", T.LongType(), False), ("payment_id", T.LongType(), True))
KEY_COMMANDS_STUDENT = _schema(("seq", T.LongType(), False), ("student_id", T.LongType(), True))

DISCOUNT_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("student_id", T.LongType(), True),
    ("term_id", T.IntegerType(), True),
    ("discount_amount", DISCOUNT_MONEY, True),
    ("reason", T.StringType(), True),
    ("approved_by", T.StringType(), True),
    ("date_given", T.DateType(), True),
)

REGISTRATION_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("admission_number", T.StringType(), True),
    ("full_name", T.StringType(), True),
    ("gender", T.StringType(), True),
    ("date_of_birth", T.DateType(), True),
    ("class_id", T.IntegerType(), True),
    ("is_boarder", T.IntegerType(), True),
    ("guardian_name", T.StringType(), True),
    ("guardian_phone", T.StringType(), True),
)

STUDENT_UPDATE_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("student_id", T.LongType(), True),
    ("full_name", T.StringType(), True),
    ("gender", T.StringType(), True),
    ("date_of_birth", T.DateType(), True),
    ("class_id", T.IntegerType(), True),
    ("is_boarder", T.IntegerType(), True),
    ("guardian_name", T.StringType(), True),
    ("guardian_phone", T.StringType(), True),
    ("status", T.StringType(), True),
)

TERM_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("academic_year", T.IntegerType(), True),
    ("term_number", T.IntegerType(), True),
)

FEE_DEFAULT_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("fee_key", T.StringType(), True),
    ("amount", T.IntegerType(), True),
)

RESTOCK_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("uniform_id", T.LongType(), True),
    ("add_quantity", T.IntegerType(), True),
)

DATED_RESTOCKS = _schema(
    ("seq", T.LongType(), False),
    ("uniform_id", T.LongType(), True),
    ("add_quantity", T.IntegerType(), True),
    ("date_added", T.DateType(), True),
)

# Payments recorded, edited and deleted in one time order.
PAYMENT_LOG = _schema(
    ("seq", T.LongType(), False),
    ("action", T.StringType(), True),
    ("payment_id", T.LongType(), True),
    ("student_id", T.LongType(), True),
    ("term_id", T.IntegerType(), True),
    ("amount_paid", MONEY, True),
    ("payment_method", T.StringType(), True),
    ("received_by", T.StringType(), True),
    ("date_paid", T.DateType(), True),
)

# Students registered and deleted in one time order.
STUDENT_LOG = _schema(
    ("seq", T.LongType(), False),
    ("action", T.StringType(), True),
    ("student_id", T.LongType(), True),
    ("admission_number", T.StringType(), True),
    ("full_name", T.StringType(), True),
    ("gender", T.StringType(), True),
    ("date_of_birth", T.DateType(), True),
    ("class_id", T.IntegerType(), True),
    ("is_boarder", T.IntegerType(), True),
    ("guardian_name", T.StringType(), True),
    ("guardian_phone", T.StringType(), True),
)

SEARCH_TERMS = _schema(("term_key", T.LongType(), False), ("admission_number", T.StringType(), True),
                       ("search", T.StringType(), True))

ITEM_COMMANDS = _schema(
    ("seq", T.LongType(), False),
    ("uniform_id", T.LongType(), True),
    ("item_name", T.StringType(), True),
    ("applicable_section", T.StringType(), True),
    ("applicable_gender", T.StringType(), True),
    ("price", MONEY, True),
    ("initial_stock", T.IntegerType(), True),
)

ISSUE_REQUESTS = _schema(
    ("request_id", T.LongType(), False),
    ("student_id", T.LongType(), True),
    ("uniform_id", T.LongType(), True),
    ("quantity", T.IntegerType(), True),
    ("amount_paid", MONEY, True),
    ("date_issued", T.DateType(), True),
)
