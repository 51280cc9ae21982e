"""Registered batch change jobs over the fixture command tables, with DuckDB oracles.

Each job is registered twice: the new version of its table and its rejects. The oracle SQL states
the same rules the way a SQL user would (window ``row_number`` for first/last wins, NOT EXISTS for
key checks); it is independent of the Spark formulation.
"""

from __future__ import annotations

from bursar.operators import changes as ch
from bursar.plans.catalog import _q
from bursar.plans.oracle import _with
from bursar.sources import schemas

SET_CURRENT_TERM_ID = 12
#: The day of the batch, for commands without a date.
TODAY = "1998-08-02"

# PHP trim() characters, spelled for DuckDB.
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"


def _t(x: str) -> str:
    return f"trim({x}, {_TRIM})"


def _empty(x: str) -> str:
    return f"({x} IS NULL OR CAST({x} AS VARCHAR) IN ('', '0'))"


# A command's position in its batch; new keys are the table's largest plus that.
_POS = "row_number() OVER (ORDER BY seq) AS pos"


def _new_id(table: str, key: str) -> str:
    return f"(SELECT COALESCE(max({key}), 0) FROM {table}) + pos"


def _latest(src: str, key: str, desc: bool = True) -> str:
    order = "seq DESC" if desc else "seq"
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn "
            f"FROM {src}) WHERE rn = 1)")


def _replace_cols(base_alias: str, cols_all: list[str], edited: list[str], key: str) -> str:
    out = []
    for c in cols_all:
        if c in edited:
            out.append(f"CASE WHEN l.{key} IS NOT NULL THEN l.{c} ELSE {base_alias}.{c} END AS {c}")
        else:
            out.append(f"{base_alias}.{c}")
    return ", ".join(out)


STUDENT_COLS, PAYMENT_COLS, DISCOUNT_COLS, ITEM_COLS, ISSUE_COLS = (
    schemas.TABLES[t].fieldNames()
    for t in ("students", "fee_payments", "fee_discounts", "uniform_items", "uniform_issues"))


def _unknown(src: str, table: str, key: str, reason: str) -> str:
    return (f"SELECT seq, {key}, '{reason}' AS reject_reason FROM {src} x "
            f"WHERE NOT EXISTS (SELECT 1 FROM {table} b WHERE b.{key} = x.{key})")


# ------------------------------------------------------------------------------------ registrations
_REG = _with(("students", "registration_commands"), f"""c AS (SELECT {_POS}, seq, {_t('admission_number')} AS admission_number,
  {_t('full_name')} AS full_name, gender, date_of_birth, class_id, is_boarder,
  {_t('guardian_name')} AS guardian_name, {_t('guardian_phone')} AS guardian_phone FROM registration_commands)""",
    f"v AS (SELECT * FROM c WHERE NOT ({_empty('admission_number')} OR {_empty('full_name')} OR {_empty('class_id')}))",
    "f AS (SELECT *, row_number() OVER (PARTITION BY lower(admission_number) ORDER BY seq) AS rn FROM v "
    "WHERE NOT EXISTS (SELECT 1 FROM students s WHERE lower(s.admission_number) = lower(v.admission_number)))")

CHANGE_ORACLE: dict[str, str] = {
    "apply_registrations": _REG + f"""
SELECT {', '.join(STUDENT_COLS)} FROM students
UNION ALL
SELECT CAST({_new_id('students', 'student_id')} AS BIGINT), admission_number, full_name, gender, date_of_birth,
       class_id, COALESCE(is_boarder, 0), guardian_name, guardian_phone, 'Active' FROM f WHERE rn = 1""",
    "apply_registrations_rejects": _REG + f"""
SELECT seq, admission_number, 'missing_fields' AS reject_reason FROM c
WHERE {_empty('admission_number')} OR {_empty('full_name')} OR {_empty('class_id')}
UNION ALL SELECT seq, admission_number, 'admission_exists' FROM v
WHERE EXISTS (SELECT 1 FROM students s WHERE lower(s.admission_number) = lower(v.admission_number))
UNION ALL SELECT seq, admission_number, 'admission_exists' FROM f WHERE rn > 1""",
}

# --------------------------------------------------------------------------------- student updates
_SUPD = _with(("students", "student_update_commands"), f"""c AS (SELECT seq, student_id, {_t('full_name')} AS full_name,
  gender, date_of_birth, class_id, COALESCE(is_boarder, 0) AS is_boarder, {_t('guardian_name')} AS guardian_name,
  {_t('guardian_phone')} AS guardian_phone, status FROM student_update_commands)""",
    f"l AS {_latest('c', 'student_id')}")
CHANGE_ORACLE["apply_student_updates"] = _SUPD + f"""
SELECT {_replace_cols('s', STUDENT_COLS, ch.STUDENT_EDIT_COLUMNS, 'student_id')}
FROM students s LEFT JOIN l ON l.student_id = s.student_id"""
CHANGE_ORACLE["apply_student_updates_rejects"] = _SUPD + "\n" + _unknown("c", "students", "student_id",
                                                                          "unknown_student")

# --------------------------------------------------------------------------------- student deletes
_SDEL = ("students", "fee_payments", "fee_discounts", "uniform_issues", "student_delete_commands")
for _name, _table, _cols in (("students", "students", STUDENT_COLS),
                             ("payments", "fee_payments", PAYMENT_COLS),
                             ("discounts", "fee_discounts", DISCOUNT_COLS),
                             ("issues", "uniform_issues", ISSUE_COLS)):
    CHANGE_ORACLE[f"apply_student_deletes_{_name}"] = _with(_SDEL) + f"""
SELECT {', '.join(_cols)} FROM {_table} t
WHERE NOT EXISTS (SELECT 1 FROM student_delete_commands d WHERE d.student_id = t.student_id)"""

# ---------------------------------------------------------------------------------------- payments
_PAY = _with(("fee_payments", "payment_commands"),
             f"c AS (SELECT {_POS}, seq, student_id, term_id, amount_paid, payment_method, {_t('received_by')} AS received_by, "
             "date_paid FROM payment_commands)",
             f"n AS (SELECT {_new_id('fee_payments', 'payment_id')} AS payment_id, * FROM c "
             "WHERE amount_paid IS NOT NULL AND amount_paid > 0)")
CHANGE_ORACLE["apply_payments"] = _PAY + f"""
SELECT {', '.join(PAYMENT_COLS)} FROM fee_payments
UNION ALL
SELECT CAST(payment_id AS BIGINT), student_id, term_id, amount_paid, payment_method, received_by,
  'RCT-' || strftime(COALESCE(date_paid, DATE '{TODAY}'), '%Y%m%d') || '-' || CAST(1000 + payment_id % 9000 AS VARCHAR),
  COALESCE(date_paid, DATE '{TODAY}') FROM n"""
CHANGE_ORACLE["apply_payments_rejects"] = _PAY + """
SELECT seq, student_id, 'invalid_amount' AS reject_reason FROM c WHERE amount_paid IS NULL OR amount_paid <= 0"""

_PEDIT = _with(("fee_payments", "payment_edit_commands"),
               f"c AS (SELECT seq, payment_id, amount_paid, payment_method, {_t('received_by')} AS received_by "
               "FROM payment_edit_commands)",
               "v AS (SELECT * FROM c WHERE amount_paid IS NOT NULL AND amount_paid > 0)",
               f"l AS {_latest('v', 'payment_id')}")
CHANGE_ORACLE["apply_payment_edits"] = _PEDIT + f"""
SELECT {_replace_cols('p', PAYMENT_COLS, ch.PAYMENT_EDIT_COLUMNS, 'payment_id')}
FROM fee_payments p LEFT JOIN l ON l.payment_id = p.payment_id"""
CHANGE_ORACLE["apply_payment_edits_rejects"] = _PEDIT + """
SELECT seq, payment_id, 'invalid_amount' AS reject_reason FROM c WHERE amount_paid IS NULL OR amount_paid <= 0
UNION ALL """ + _unknown("v", "fee_payments", "payment_id", "unknown_payment")

_PDEL = _with(("fee_payments", "payment_delete_commands"))
CHANGE_ORACLE["apply_payment_deletes"] = _PDEL + f"""
SELECT {', '.join(PAYMENT_COLS)} FROM fee_payments p
WHERE NOT EXISTS (SELECT 1 FROM payment_delete_commands d WHERE d.payment_id = p.payment_id)"""
CHANGE_ORACLE["apply_payment_deletes_rejects"] = _PDEL + "\n" + _unknown(
    "payment_delete_commands", "fee_payments", "payment_id", "unknown_payment")

# --------------------------------------------------------------------------------------- discounts
_DISC = _with(("fee_discounts", "students", "academic_terms", "discount_commands"),
              f"c AS (SELECT {_POS}, seq, student_id, term_id, discount_amount, {_t('reason')} AS reason, "
              f"{_t('approved_by')} AS approved_by, date_given FROM discount_commands)",
              f"""r AS (SELECT *, CASE WHEN discount_amount IS NULL OR discount_amount <= 0 THEN 'invalid_amount'
   WHEN {_empty('approved_by')} THEN 'missing_approver'
   WHEN NOT EXISTS (SELECT 1 FROM students s WHERE s.student_id = c.student_id) THEN 'unknown_student'
   WHEN NOT EXISTS (SELECT 1 FROM academic_terms t WHERE t.term_id = c.term_id) THEN 'unknown_term'
   END AS reject_reason FROM c)""")
CHANGE_ORACLE["apply_discounts"] = _DISC + f"""
SELECT {', '.join(DISCOUNT_COLS)} FROM fee_discounts
UNION ALL
SELECT CAST({_new_id('fee_discounts', 'discount_id')} AS BIGINT), student_id, term_id, discount_amount, reason,
       approved_by, COALESCE(date_given, DATE '{TODAY}') FROM r WHERE reject_reason IS NULL"""
CHANGE_ORACLE["apply_discounts_rejects"] = _DISC + """
SELECT seq, student_id, reject_reason FROM r WHERE reject_reason IS NOT NULL"""

# ------------------------------------------------------------------------------------------- terms
_TERMS = _with(("academic_terms", "term_commands"), f"c AS (SELECT {_POS}, * FROM term_commands)",
               "v AS (SELECT * FROM c WHERE academic_year IS NOT NULL AND term_number IS NOT NULL)",
               "f AS (SELECT *, row_number() OVER (PARTITION BY academic_year, term_number ORDER BY seq) AS rn "
               "FROM v WHERE NOT EXISTS (SELECT 1 FROM academic_terms t WHERE t.academic_year = v.academic_year "
               "AND t.term_number = v.term_number))")
CHANGE_ORACLE["apply_new_terms"] = _TERMS + f"""
SELECT term_id, academic_year, term_number, is_current FROM academic_terms
UNION ALL
SELECT CAST({_new_id('academic_terms', 'term_id')} AS INTEGER), academic_year, term_number, 0 FROM f WHERE rn = 1"""
CHANGE_ORACLE["apply_new_terms_rejects"] = _TERMS + """
SELECT seq, 'missing_fields' AS reject_reason FROM c WHERE academic_year IS NULL OR term_number IS NULL
UNION ALL SELECT seq, 'term_exists' FROM v WHERE EXISTS (SELECT 1 FROM academic_terms t
  WHERE t.academic_year = v.academic_year AND t.term_number = v.term_number)
UNION ALL SELECT seq, 'term_exists' FROM f WHERE rn > 1"""
CHANGE_ORACLE["set_current_term"] = _with(("academic_terms",)) + f"""
SELECT term_id, academic_year, term_number, CASE WHEN term_id = {SET_CURRENT_TERM_ID} THEN 1 ELSE 0 END AS is_current
FROM academic_terms"""

# ------------------------------------------------------------------------------------ fee defaults
_SEED_VALUES = ", ".join(f"('{k}', '{lbl}', {a})" for k, lbl, a in ch.FEE_DEFAULT_SEED)
CHANGE_ORACLE["seed_fee_defaults"] = _with(("fee_defaults",)) + f""",
seed(fee_key, label, amount) AS (VALUES {_SEED_VALUES})
SELECT fee_key, label, amount FROM fee_defaults
UNION ALL SELECT fee_key, label, CAST(amount AS INTEGER) FROM seed s
WHERE NOT EXISTS (SELECT 1 FROM fee_defaults d WHERE d.fee_key = s.fee_key)"""
_FEE = _with(("fee_defaults", "fee_default_commands"),
             "c AS (SELECT seq, fee_key, COALESCE(amount, 0) AS amount FROM fee_default_commands)",
             "r AS (SELECT *, CASE WHEN fee_key IS NULL OR fee_key = '' OR amount < 0 THEN 'invalid_fee' END "
             "AS reject_reason FROM c)",
             "v AS (SELECT * FROM r WHERE reject_reason IS NULL)",
             f"l AS {_latest('v', 'fee_key')}")
CHANGE_ORACLE["apply_fee_default_updates"] = _FEE + f"""
SELECT {_replace_cols('d', ['fee_key', 'label', 'amount'], ['amount'], 'fee_key')}
FROM fee_defaults d LEFT JOIN l ON l.fee_key = d.fee_key"""
CHANGE_ORACLE["apply_fee_default_updates_rejects"] = _FEE + """
SELECT seq, fee_key, reject_reason FROM r WHERE reject_reason IS NOT NULL
UNION ALL """ + _unknown("v", "fee_defaults", "fee_key", "unknown_fee")

# ---------------------------------------------------------------------------------------- uniforms
_RESTOCK = _with(("uniform_items", "restock_commands"), "c AS (SELECT * FROM restock_commands)",
                 "v AS (SELECT * FROM c WHERE add_quantity IS NOT NULL AND add_quantity > 0)",
                 "a AS (SELECT uniform_id, sum(add_quantity) AS added FROM v GROUP BY uniform_id)")
CHANGE_ORACLE["apply_restock"] = _RESTOCK + """
SELECT i.uniform_id, i.item_name, i.applicable_section, i.applicable_gender, i.price,
       CAST(i.quantity_in_stock + COALESCE(a.added, 0) AS INTEGER) AS quantity_in_stock
FROM uniform_items i LEFT JOIN a ON a.uniform_id = i.uniform_id"""
CHANGE_ORACLE["apply_restock_rejects"] = _RESTOCK + """
SELECT seq, uniform_id, 'invalid_quantity' AS reject_reason FROM c WHERE add_quantity IS NULL OR add_quantity <= 0
UNION ALL """ + _unknown("v", "uniform_items", "uniform_id", "unknown_uniform")

_ITEM_RULE = (f"CASE WHEN {_empty('item_name')} OR price IS NULL OR price < 0 THEN 'invalid_item' END")
_ITEMADD = _with(("uniform_items", "item_add_commands"),
                 f"c AS (SELECT {_POS}, seq, {_t('item_name')} AS item_name, applicable_section, applicable_gender, price, "
                 "initial_stock FROM item_add_commands)",
                 f"r AS (SELECT *, {_ITEM_RULE} AS reject_reason FROM c)")
CHANGE_ORACLE["apply_new_items"] = _ITEMADD + f"""
SELECT {', '.join(ITEM_COLS)} FROM uniform_items
UNION ALL
SELECT CAST({_new_id('uniform_items', 'uniform_id')} AS BIGINT), item_name, applicable_section, applicable_gender,
       price, COALESCE(initial_stock, 0) FROM r WHERE reject_reason IS NULL"""
CHANGE_ORACLE["apply_new_items_rejects"] = _ITEMADD + """
SELECT seq, reject_reason FROM r WHERE reject_reason IS NOT NULL"""

_ITEMUPD = _with(("uniform_items", "item_update_commands"),
                 f"c AS (SELECT seq, uniform_id, {_t('item_name')} AS item_name, applicable_section, "
                 "applicable_gender, price FROM item_update_commands)",
                 f"r AS (SELECT *, {_ITEM_RULE} AS reject_reason FROM c)",
                 "v AS (SELECT * FROM r WHERE reject_reason IS NULL)",
                 f"l AS {_latest('v', 'uniform_id')}")
CHANGE_ORACLE["apply_item_updates"] = _ITEMUPD + f"""
SELECT {_replace_cols('i', ITEM_COLS, ch.ITEM_EDIT_COLUMNS, 'uniform_id')}
FROM uniform_items i LEFT JOIN l ON l.uniform_id = i.uniform_id"""
CHANGE_ORACLE["apply_item_updates_rejects"] = _ITEMUPD + """
SELECT seq, uniform_id, reject_reason FROM r WHERE reject_reason IS NOT NULL
UNION ALL """ + _unknown("v", "uniform_items", "uniform_id", "unknown_uniform")


# ---------------------------------------------------------------------------------- Spark side
def _reg(fx):
    return ch.apply_registrations(fx["students"], fx["registration_commands"])


def _supd(fx):
    return ch.apply_student_updates(fx["students"], fx["student_update_commands"])


def _sdel(fx):
    return ch.apply_student_deletes(fx["students"], fx["fee_payments"], fx["fee_discounts"],
                                    fx["uniform_issues"], fx["student_delete_commands"])


def _pay(fx):
    return ch.apply_payments(fx["fee_payments"], fx["payment_commands"], today=TODAY)


def _pedit(fx):
    return ch.apply_payment_edits(fx["fee_payments"], fx["payment_edit_commands"])


def _pdel(fx):
    return ch.apply_payment_deletes(fx["fee_payments"], fx["payment_delete_commands"])


def _disc(fx):
    return ch.apply_discounts(fx["fee_discounts"], fx["students"], fx["academic_terms"],
                              fx["discount_commands"], today=TODAY)


def _terms(fx):
    return ch.apply_new_terms(fx["academic_terms"], fx["term_commands"])


def _fee(fx):
    return ch.apply_fee_default_updates(fx["fee_defaults"], fx["fee_default_commands"])


def _restock(fx):
    return ch.apply_restock(fx["uniform_items"], fx["restock_commands"])


def _itemadd(fx):
    return ch.apply_new_items(fx["uniform_items"], fx["item_add_commands"])


def _itemupd(fx):
    return ch.apply_item_updates(fx["uniform_items"], fx["item_update_commands"])


CHANGE_QUERIES: dict = {}
for _key, _job in (("apply_registrations", _reg), ("apply_student_updates", _supd),
                   ("apply_payments", _pay), ("apply_payment_edits", _pedit),
                   ("apply_payment_deletes", _pdel), ("apply_discounts", _disc),
                   ("apply_new_terms", _terms), ("apply_fee_default_updates", _fee),
                   ("apply_restock", _restock), ("apply_new_items", _itemadd),
                   ("apply_item_updates", _itemupd)):
    CHANGE_QUERIES[_key] = _q(lambda fx, j=_job: j(fx).table)
    CHANGE_QUERIES[_key + "_rejects"] = _q(lambda fx, j=_job: j(fx).rejects)
for _part in ("students", "payments", "discounts", "issues"):
    CHANGE_QUERIES[f"apply_student_deletes_{_part}"] = _q(lambda fx, p=_part: getattr(_sdel(fx), p))
CHANGE_QUERIES["set_current_term"] = _q(lambda fx: ch.set_current_term(fx["academic_terms"],
                                                                        SET_CURRENT_TERM_ID))
CHANGE_QUERIES["seed_fee_defaults"] = _q(lambda fx: ch.seed_fee_defaults(fx["fee_defaults"]))

# ------------------------------------------------------------------------------- M15 stock fold
# The oracle is the plain sequential fold: a recursive CTE stepping through each item's requests.
_FOLD = "WITH RECURSIVE " + _with(("uniform_items", "issue_requests"), """t AS (SELECT r.*, i.price,
  COALESCE(i.quantity_in_stock, 0) AS opening,
  CASE WHEN i.uniform_id IS NULL THEN 'unknown_item' WHEN r.quantity IS NULL OR r.quantity < 1 THEN 'invalid_quantity' END AS bad
  FROM issue_requests r LEFT JOIN uniform_items i ON i.uniform_id = r.uniform_id)""",
    """v AS (SELECT *, row_number() OVER (PARTITION BY uniform_id ORDER BY date_issued NULLS FIRST,
  request_id NULLS FIRST, student_id NULLS FIRST, quantity NULLS FIRST) AS rn FROM t WHERE bad IS NULL)""",
    """fold AS (SELECT uniform_id, 0 AS rn, CAST(min(opening) AS BIGINT) AS left_after, CAST(NULL AS BOOLEAN) AS accepted
  FROM v GROUP BY uniform_id
  UNION ALL
  SELECT f.uniform_id, f.rn + 1,
         CASE WHEN v.quantity <= f.left_after THEN f.left_after - v.quantity ELSE f.left_after END,
         v.quantity <= f.left_after
  FROM fold f JOIN v ON v.uniform_id = f.uniform_id AND v.rn = f.rn + 1)""",
    "d AS (SELECT v.*, f.accepted FROM v JOIN fold f ON f.uniform_id = v.uniform_id AND f.rn = v.rn)")[len("WITH "):]
CHANGE_ORACLE["issue_uniforms"] = _FOLD + """
SELECT request_id AS issue_key, student_id, uniform_id, quantity,
       CAST(price * quantity AS DECIMAL(12,2)) AS total_price, amount_paid, date_issued FROM d WHERE accepted"""
CHANGE_ORACLE["issue_uniforms_rejects"] = _FOLD + """
SELECT request_id, uniform_id, bad AS reject_reason FROM t WHERE bad IS NOT NULL
UNION ALL SELECT request_id, uniform_id, 'insufficient_stock' FROM d WHERE NOT accepted"""
CHANGE_ORACLE["issue_uniforms_stock"] = _FOLD + f""",
u AS (SELECT uniform_id, sum(quantity) AS used FROM d WHERE accepted GROUP BY uniform_id)
SELECT i.uniform_id, i.item_name, i.applicable_section, i.applicable_gender, i.price,
       CAST(i.quantity_in_stock - COALESCE(u.used, 0) AS INTEGER) AS quantity_in_stock
FROM uniform_items i LEFT JOIN u ON u.uniform_id = i.uniform_id"""


def _issue(fx):
    from bursar.operators.stock_fold import issue_uniforms
    return issue_uniforms(fx["uniform_items"], fx["issue_requests"])


CHANGE_QUERIES["issue_uniforms"] = _q(lambda fx: _issue(fx).issued)
CHANGE_QUERIES["issue_uniforms_rejects"] = _q(lambda fx: _issue(fx).rejects)
CHANGE_QUERIES["issue_uniforms_stock"] = _q(lambda fx: _issue(fx).items)
