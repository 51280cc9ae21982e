"""Registered queries over command logs in one time order and over tables of terms, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bursar.operators import changes as ch
from bursar.operators import versions
from bursar.operators.audits import boarding_fee_check
from bursar.operators.balances import term_balances
from bursar.operators.numbering import positions
from bursar.operators.payment_log import apply_payment_log
from bursar.operators.staging import staged
from bursar.operators.stock_fold import issue_uniforms
from bursar.operators.stock_ledger import stock_ledger
from bursar.operators.student_log import apply_student_log
from bursar.operators.student_search_many import search_outcomes
from bursar.plans.catalog import READ_QUERIES, _q
from bursar.plans.changes_catalog import _FOLD, ISSUE_COLS, ITEM_COLS, PAYMENT_COLS, STUDENT_COLS, TODAY, _empty, _t
from bursar.plans.oracle import BAL_CTES, BAL_SELECT, ORACLE, _with
from bursar.session import ensure_checkpoint_dir
from bursar.sources import declared, tables

LOG_ORACLE: dict[str, str] = {}
LOG_QUERIES: dict = {}

# ----------------------------------------------------------------- restocks between issues (M12 with M15)
# The plain serial fold: a recursive CTE over each item's events in time order.
_LEDGER = "WITH RECURSIVE " + _with(("uniform_items", "issue_requests", "dated_restock_commands"),
    """e AS (SELECT uniform_id, date_issued AS day, 1 AS kind, request_id AS event_id, student_id, quantity, amount_paid
  FROM issue_requests UNION ALL
  SELECT uniform_id, date_added, 0, seq, NULL, add_quantity, NULL FROM dated_restock_commands)""",
    """t AS (SELECT e.*, i.price, COALESCE(i.quantity_in_stock, 0) AS opening,
  CASE WHEN kind = 0 AND (quantity IS NULL OR quantity < 1) THEN 'invalid_quantity'
       WHEN i.uniform_id IS NULL THEN CASE kind WHEN 0 THEN 'unknown_uniform' ELSE 'unknown_item' END
       WHEN quantity IS NULL OR quantity < 1 THEN 'invalid_quantity' END AS bad
  FROM e LEFT JOIN uniform_items i ON i.uniform_id = e.uniform_id)""",
    """v AS (SELECT *, row_number() OVER (PARTITION BY uniform_id ORDER BY day NULLS FIRST, kind, event_id, student_id NULLS FIRST, quantity) AS rn
  FROM t WHERE bad IS NULL)""",
    """fold AS (SELECT uniform_id, 0 AS rn, CAST(min(opening) AS BIGINT) AS left_after, CAST(NULL AS BOOLEAN) AS accepted FROM v GROUP BY uniform_id
  UNION ALL
  SELECT f.uniform_id, f.rn + 1,
         CASE WHEN v.kind = 0 THEN f.left_after + v.quantity WHEN v.quantity <= f.left_after THEN f.left_after - v.quantity ELSE f.left_after END,
         v.kind = 0 OR v.quantity <= f.left_after
  FROM fold f JOIN v ON v.uniform_id = f.uniform_id AND v.rn = f.rn + 1)""",
    "d AS (SELECT v.*, f.accepted FROM v JOIN fold f ON f.uniform_id = v.uniform_id AND f.rn = v.rn)")[len("WITH "):]
LOG_ORACLE["stock_ledger_issued"] = _LEDGER + """
SELECT event_id AS issue_key, student_id, uniform_id, quantity, CAST(price * quantity AS DECIMAL(12,2)) AS total_price, amount_paid,
       day AS date_issued FROM d WHERE kind = 1 AND accepted"""
LOG_ORACLE["stock_ledger_rejects"] = _LEDGER + """
SELECT CASE kind WHEN 0 THEN 'restock' ELSE 'issue' END AS kind, event_id, uniform_id, bad AS reject_reason FROM t WHERE bad IS NOT NULL
UNION ALL SELECT 'issue', event_id, uniform_id, 'insufficient_stock' FROM d WHERE NOT accepted"""
LOG_ORACLE["stock_ledger_stock"] = _LEDGER + f""",
u AS (SELECT uniform_id, sum(CASE kind WHEN 0 THEN quantity ELSE -quantity END) AS change FROM d WHERE accepted GROUP BY uniform_id)
SELECT {', '.join('i.' + c for c in ITEM_COLS if c != 'quantity_in_stock')},
       CAST(i.quantity_in_stock + COALESCE(u.change, 0) AS INTEGER) AS quantity_in_stock
FROM uniform_items i LEFT JOIN u ON u.uniform_id = i.uniform_id"""


def _ledger(fx):
    return stock_ledger(fx["uniform_items"], fx["issue_requests"], fx["dated_restock_commands"])


LOG_QUERIES["stock_ledger_issued"] = _q(lambda fx: _ledger(fx).issued)
LOG_QUERIES["stock_ledger_rejects"] = _q(lambda fx: _ledger(fx).rejects)
LOG_QUERIES["stock_ledger_stock"] = _q(lambda fx: _ledger(fx).items)

# ------------------------------------------------------------------ payments in one log (M4, M5, M6)
# Whether a payment is there is asked anew for every command: known before it, and not deleted in between.
_PAYLOG = _with(("fee_payments", "payment_log"), f"""c AS (SELECT *, row_number() OVER (ORDER BY seq) AS pos,
  CASE WHEN action <> 'delete' AND (amount_paid IS NULL OR amount_paid <= 0) THEN 'invalid_amount' END AS bad FROM payment_log)""",
    """n AS (SELECT (SELECT max(payment_id) FROM fee_payments) + row_number() OVER (ORDER BY pos) AS new_id, *
  FROM c WHERE action = 'record' AND bad IS NULL)""",
    """born AS (SELECT payment_id, 0 AS at FROM fee_payments UNION ALL SELECT new_id, pos FROM n)""",
    """k AS (SELECT c.*, EXISTS (SELECT 1 FROM born b WHERE b.payment_id = c.payment_id AND b.at < c.pos) AS made FROM c
  WHERE action <> 'record' AND bad IS NULL)""",
    """s AS (SELECT k.*, made AND NOT EXISTS (SELECT 1 FROM k x WHERE x.action = 'delete' AND x.made AND x.payment_id = k.payment_id
  AND x.pos < k.pos) AS there FROM k)""",
    "gone AS (SELECT payment_id FROM s WHERE action = 'delete' AND there)",
    """edited AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY pos DESC) AS rn FROM s
  WHERE action = 'edit' AND there) WHERE rn = 1)""",
    f"""p AS (SELECT {', '.join(PAYMENT_COLS)} FROM fee_payments
  UNION ALL SELECT new_id, student_id, term_id, amount_paid, payment_method, {_t('received_by')},
    'RCT-' || strftime(COALESCE(date_paid, DATE '{TODAY}'), '%Y%m%d') || '-' || CAST(1000 + new_id % 9000 AS VARCHAR),
    COALESCE(date_paid, DATE '{TODAY}') FROM n)""")
_PAYCOLS = ", ".join((f"CASE WHEN e.payment_id IS NOT NULL THEN {_t('e.received_by') if c == 'received_by' else 'e.' + c} ELSE p.{c} END AS {c}"
                      if c in ch.PAYMENT_EDIT_COLUMNS else f"p.{c}") for c in PAYMENT_COLS)
LOG_ORACLE["apply_payment_log"] = _PAYLOG + f"""
SELECT {_PAYCOLS} FROM p LEFT JOIN edited e ON e.payment_id = p.payment_id
WHERE p.payment_id NOT IN (SELECT payment_id FROM gone)"""
LOG_ORACLE["apply_payment_log_rejects"] = _PAYLOG + """
SELECT seq, action, payment_id, bad AS reject_reason FROM c WHERE bad IS NOT NULL
UNION ALL SELECT seq, action, payment_id, 'unknown_payment' FROM s WHERE NOT there"""


def _paylog(fx):
    return apply_payment_log(fx["fee_payments"], fx["payment_log"], today=TODAY)


LOG_QUERIES["apply_payment_log"] = _q(lambda fx: _paylog(fx).table)
LOG_QUERIES["apply_payment_log_rejects"] = _q(lambda fx: _paylog(fx).rejects)

# ------------------------------------------------- registrations and deletions in one log (M1 with M3)
# Owner after owner of each number: a recursive CTE that looks for the first registration after the last one's end.
_STULOG = "WITH RECURSIVE " + _with(("students", "student_log"), f"""c AS (SELECT row_number() OVER (ORDER BY seq) AS pos, seq, action, student_id,
  {_t('admission_number')} AS admission_number, {_t('full_name')} AS full_name, gender, date_of_birth, class_id, is_boarder,
  {_t('guardian_name')} AS guardian_name, {_t('guardian_phone')} AS guardian_phone FROM student_log)""",
    f"""bad AS (SELECT * FROM c WHERE action = 'register'
  AND ({_empty('admission_number')} OR {_empty('full_name')} OR {_empty('class_id')}))""",
    """r AS (SELECT *, lower(admission_number) AS key, (SELECT max(student_id) FROM students) + pos AS new_id FROM c
  WHERE action = 'register' AND pos NOT IN (SELECT pos FROM bad))""",
    "d AS (SELECT * FROM c WHERE action = 'delete')",
    """re AS (SELECT r.*, (SELECT min(d.pos) FROM d WHERE d.student_id = r.new_id AND d.pos > r.pos) AS ends FROM r)""",
    """old AS (SELECT s.*, lower(s.admission_number) AS key, (SELECT min(d.pos) FROM d WHERE d.student_id = s.student_id) AS ends FROM students s)""",
    """free AS (SELECT k.key, COALESCE(max(o.ends), 0) AS at FROM (SELECT DISTINCT key FROM r) k LEFT JOIN old o ON o.key = k.key
  GROUP BY k.key HAVING count(*) FILTER (WHERE o.student_id IS NOT NULL AND o.ends IS NULL) = 0)""",
    """chain AS (SELECT f.key, min(re.pos) AS pos FROM free f JOIN re ON re.key = f.key AND re.pos > f.at GROUP BY f.key
  UNION ALL
  SELECT h.key, (SELECT min(x.pos) FROM re x WHERE x.key = h.key AND x.pos > re.ends) FROM chain h JOIN re ON re.pos = h.pos
  WHERE re.ends IS NOT NULL AND EXISTS (SELECT 1 FROM re x WHERE x.key = h.key AND x.pos > re.ends))""",
    "taken AS (SELECT * FROM re WHERE pos IN (SELECT pos FROM chain))",
    "ended AS (SELECT ends AS pos FROM taken WHERE ends IS NOT NULL UNION SELECT ends FROM old WHERE ends IS NOT NULL)")[len("WITH "):]
LOG_ORACLE["apply_student_log"] = _STULOG + f"""
SELECT {', '.join(STUDENT_COLS)} FROM old WHERE ends IS NULL
UNION ALL SELECT CAST(new_id AS BIGINT), admission_number, full_name, gender, date_of_birth, class_id, COALESCE(is_boarder, 0),
  guardian_name, guardian_phone, 'Active' FROM taken WHERE ends IS NULL"""
LOG_ORACLE["apply_student_log_rejects"] = _STULOG + """
SELECT seq, action, student_id, admission_number, 'missing_fields' AS reject_reason FROM bad
UNION ALL SELECT seq, action, NULL, admission_number, 'admission_exists' FROM r WHERE pos NOT IN (SELECT pos FROM taken)
UNION ALL SELECT seq, action, student_id, NULL, 'unknown_student' FROM d WHERE pos NOT IN (SELECT pos FROM ended)"""


def _stulog(fx):
    return apply_student_log(fx["students"], fx["student_log"])


LOG_QUERIES["apply_student_log"] = _q(lambda fx: _stulog(fx).table)
LOG_QUERIES["apply_student_log_rejects"] = _q(lambda fx: _stulog(fx).rejects)

# ----------------------------------------------------------------------- many searches at once
LOG_ORACLE["search_outcomes"] = _with(("students", "classes", "search_terms"), f"""t AS (SELECT term_key,
  {_t("COALESCE(admission_number, '')")} AS number, {_t("COALESCE(search, '')")} AS search FROM search_terms)""",
    "e AS (SELECT s.* FROM students s JOIN classes c ON c.class_id = s.class_id)",
    """m AS (SELECT t.term_key, t.number, t.search, count(e.student_id) AS n FROM t LEFT JOIN e ON CASE
  WHEN number <> '' THEN lower(e.admission_number) = lower(number)
  WHEN search <> '' THEN lower(e.admission_number) = lower(search) OR e.full_name ILIKE '%' || search || '%' ELSE false END
  GROUP BY ALL)""") + """
SELECT term_key, CASE WHEN number <> '' THEN number ELSE search END AS search_term, n AS match_count,
  CASE WHEN number <> '' THEN CASE WHEN n > 0 THEN 'found' ELSE 'not_found' END
       WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS outcome FROM m"""
LOG_QUERIES["search_outcomes"] = _q(lambda fx: search_outcomes(fx["students"], fx["classes"], fx["search_terms"]))

# ------------------------------------------------------------- balances from stored sums
# The stored sums of the table before the log, moved by the log's deltas; the oracle sums the table after it.


def _kept(fx):
    from bursar.operators import kept_sums as ks
    payments, result = fx["fee_payments"], _paylog(fx)
    after = staged(result.table)
    # Keys that the log touched or made: its own, and those beyond the table's largest.
    top = payments.agg(F.max("payment_id")).scalar()
    touched = fx["payment_log"].select("payment_id").filter("payment_id is not null").unionByName(
        after.filter(F.col("payment_id") > top).select("payment_id"))
    out, into = ks.row_changes(payments, after, touched, "payment_id")
    sums = ks.merged_sums(ks.stored_sums(payments, "amount_paid"), ks.deltas(out, into, "amount_paid"))
    return sums, fx


LOG_ORACLE["payment_sums_kept"] = _PAYLOG + f""",
t AS (SELECT {_PAYCOLS} FROM p LEFT JOIN edited e ON e.payment_id = p.payment_id WHERE p.payment_id NOT IN (SELECT payment_id FROM gone))
SELECT student_id, term_id, CAST(sum(amount_paid) AS DECIMAL(38,2)) AS total, count(*) AS n FROM t GROUP BY student_id, term_id"""
LOG_QUERIES["payment_sums_kept"] = _q(lambda fx: _kept(fx)[0])


def _kept_balances(fx):
    from bursar.operators import kept_sums as ks
    sums, _ = _kept(fx)
    return ks.balances_from_sums(fx["students"], fx["classes"], sums, ks.stored_sums(fx["fee_discounts"], "discount_amount"),
                                 fx["academic_terms"], fx["boarding_fee"])


# The log's table takes the place of the payments in the balance query's SQL.
_AFTER = ["students", "classes", "academic_terms", "fee_discounts", "boarding_fee"]
LOG_ORACLE["student_balances_kept"] = (_PAYLOG + ",\n" + _with(_AFTER)[len("WITH "):] + f""",
after_log AS (SELECT {_PAYCOLS} FROM p LEFT JOIN edited e ON e.payment_id = p.payment_id WHERE p.payment_id NOT IN (SELECT payment_id FROM gone)),
""" + ",\n".join(c.replace("FROM fee_payments", "FROM after_log") for c in BAL_CTES) + f"""
SELECT {BAL_SELECT} FROM bal""")
LOG_QUERIES["student_balances_kept"] = _q(_kept_balances)

# ------------------------------------------------------------------------ versions (S11, S12, S13, M15's table)


def _folder(fx, name):
    return f"{ensure_checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def _published(fx):
    """The payments after two published versions: first as they are, then after the log."""
    root = _folder(fx, "published")
    tables.publish({"fee_payments": fx["fee_payments"], "academic_terms": fx["academic_terms"]}, root, "v1")
    before = tables.fee_payments(fx.spark, tables.current_path(fx.spark, root, "fee_payments"))
    tables.publish({"fee_payments": apply_payment_log(before, fx["payment_log"], today=TODAY).table}, root, "v2")
    assert tables.current_path(fx.spark, root, "academic_terms").endswith("/v1/academic_terms")
    return tables.fee_payments(fx.spark, tables.current_path(fx.spark, root, "fee_payments"))


def _restored(fx):
    """The discounts from a backup that was checked and restored."""
    dest, root = _folder(fx, "backup"), _folder(fx, "restored")
    versions.backup({"fee_discounts": fx["fee_discounts"]}, dest, "1998-08-02")
    versions.restore(fx.spark, dest, "1998-08-02", root, "v1")
    return tables.fee_discounts(fx.spark, tables.current_path(fx.spark, root, "fee_discounts"))


def _ensured(fx):
    """The items from a folder that was created empty and then filled."""
    path = _folder(fx, "ensured")
    tables.ensure_table(fx.spark, "uniform_items", path)
    fx["uniform_items"].write.mode("append").parquet(path)
    return tables.ensure_table(fx.spark, "uniform_items", path)


def _declared(fx):
    """The core balances over declared, bucketed tables."""
    database, folder = f"bursar_{uuid.uuid4().hex[:12]}", _folder(fx, "declared")
    for name in ("students", "fee_payments", "fee_discounts"):
        declared.declare(fx.spark, name, database, buckets=8, path=f"{folder}/{name}")
        declared.append(fx[name], name, database)
    of = lambda name: declared.table(fx.spark, name, database)
    return term_balances(of("students"), fx["classes"], of("fee_payments"), of("fee_discounts"), fx["academic_terms"], fx["boarding_fee"])


LOG_QUERIES["published_payments"] = _q(_published)
LOG_ORACLE["published_payments"] = LOG_ORACLE["apply_payment_log"]
LOG_QUERIES["restored_discounts"] = _q(_restored)
LOG_ORACLE["restored_discounts"] = _with(("fee_discounts",)) + "\nSELECT * FROM fee_discounts"
LOG_QUERIES["ensured_items"] = _q(_ensured)
LOG_ORACLE["ensured_items"] = _with(("uniform_items",)) + "\nSELECT * FROM uniform_items"
LOG_QUERIES["student_balances_declared"] = _q(_declared)
LOG_ORACLE["student_balances_declared"] = ORACLE["student_balances"]
LOG_QUERIES["payment_differences"] = _q(lambda fx: versions.differences(
    staged(fx["fee_payments"]), staged(_paylog(fx).table), "payment_id"))
LOG_ORACLE["payment_differences"] = _PAYLOG + f""",
t AS (SELECT {_PAYCOLS} FROM p LEFT JOIN edited e ON e.payment_id = p.payment_id WHERE p.payment_id NOT IN (SELECT payment_id FROM gone)),
f AS (SELECT * FROM fee_payments)
SELECT COALESCE(f.payment_id, t.payment_id) AS payment_id,
  CASE WHEN f.payment_id IS NULL THEN 'added' WHEN t.payment_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN f.payment_id IS NULL OR t.payment_id IS NULL THEN '' ELSE concat_ws(',', {', '.join(
      f"CASE WHEN f.{c} IS DISTINCT FROM t.{c} THEN '{c}' END" for c in PAYMENT_COLS[1:])}) END AS columns
FROM f FULL JOIN t ON t.payment_id = f.payment_id
WHERE f.payment_id IS NULL OR t.payment_id IS NULL OR {' OR '.join(f'f.{c} IS DISTINCT FROM t.{c}' for c in PAYMENT_COLS[1:])}"""
LOG_QUERIES["issue_uniforms_table"] = _q(lambda fx: issue_uniforms(fx["uniform_items"], fx["issue_requests"], fx["uniform_issues"]).table)
LOG_ORACLE["issue_uniforms_table"] = _FOLD.replace("WITH RECURSIVE ", "WITH RECURSIVE " + _with(("uniform_issues",))[len("WITH "):] + ",\n", 1) + f"""
SELECT {', '.join(ISSUE_COLS)} FROM uniform_issues
UNION ALL SELECT (SELECT max(issue_key) FROM uniform_issues) + row_number() OVER (ORDER BY request_id, date_issued, student_id, uniform_id, quantity), student_id, uniform_id, quantity,
       CAST(price * quantity AS DECIMAL(12,2)), amount_paid, date_issued FROM d WHERE accepted"""
LOG_QUERIES["audit_boarding_fee"] = _q(lambda fx: boarding_fee_check(fx["boarding_fee"]))
LOG_ORACLE["audit_boarding_fee"] = _with(("boarding_fee",)) + """
SELECT count(*) AS rows, CAST(COALESCE(min(amount), 0) AS DECIMAL(18,2)) AS amount_used, count(*) = 1 AS ok FROM boarding_fee"""

# ------------------------------------------------------- the pages' orders (O1-O14, X14), as positions
# The place of each row in the order the operator returns; the oracle numbers the rows by the page's order.
_NAME = "lower(full_name), full_name, student_id"
_ITEM = "lower(item_name), item_name, uniform_id"
for _of, _order in {
        "outstanding_balances": f"class_id, {_NAME}", "class_fee_status_paid_up": f"class_id, {_NAME}",
        "class_fee_status_owing": f"class_id, balance DESC, {_NAME}",
        "recent_payments": "class_id, payment_id DESC", "uniform_item_sales": "revenue DESC, uniform_id",
        "payment_history_one": "payment_id DESC", "discount_history_one": "discount_id DESC",
        "uniform_issue_history_one": "date_issued DESC, issue_key, uniform_id", "term_list": "academic_year DESC, term_number DESC, term_id",
        "uniform_stock": _ITEM, "uniform_eligibility": f"section, gender, {_ITEM}", "fee_default_list": "lower(label), fee_key", "staff_roster": "role, username",
        "class_list": "class_id", "class_counts": "class_id", "low_stock_items": "quantity_in_stock, uniform_id",
        "student_search": "class_id, lower(full_name), student_id", "student_directory": f"class_id, {_NAME}"}.items():
    LOG_QUERIES[f"{_of}_in_order"] = (lambda spark, sf_dir, q=READ_QUERIES[_of]: positions(q(spark, sf_dir)))
    LOG_ORACLE[f"{_of}_in_order"] = f"SELECT *, row_number() OVER (ORDER BY {_order}) AS position FROM ({ORACLE[_of]})"
