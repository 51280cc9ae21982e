"""DuckDB SQL for every registered query: the independent oracle the Spark results are checked against.

Written as the reference's pages would compute it (correlated lookups become grouped CTEs), over the
same fixture views. Every output column is cast to the type the Spark side returns.
"""

from __future__ import annotations

from bursar.sources.fixtures import duckdb_with

M = "DECIMAL(18,2)"
TOTAL = "DECIMAL(38,2)"  # of whole-table totals

BALANCE_VIEWS = ("students", "classes", "academic_terms", "fee_payments", "fee_discounts", "boarding_fee")


def _with(views, *ctes: str) -> str:
    head = duckdb_with(*views)
    return head + "".join(f",\n{c}" for c in ctes)


CUR = "cur AS (SELECT min(term_id) AS term_id FROM academic_terms WHERE is_current = 1)"
BOARD = f"board AS (SELECT CAST(COALESCE(min(amount), 0) AS DECIMAL(12,2)) AS amount FROM boarding_fee)"


def _gross(alias_s: str = "s", alias_c: str = "c") -> str:
    return (f"CAST(CASE WHEN COALESCE({alias_s}.is_boarder, 0) <> 0 THEN (SELECT amount FROM board) "
            f"ELSE {alias_c}.term_fee END AS {M})")


BAL_CTES = (
    CUR, BOARD,
    "disc AS (SELECT student_id, sum(discount_amount) AS discount FROM fee_discounts "
    "WHERE term_id = (SELECT term_id FROM cur) GROUP BY student_id)",
    "paid AS (SELECT student_id, sum(amount_paid) AS total_paid FROM fee_payments "
    "WHERE term_id = (SELECT term_id FROM cur) GROUP BY student_id)",
    f"""bal0 AS (SELECT s.student_id, s.admission_number, s.full_name, c.class_id, c.class_name, c.section,
   s.is_boarder, (SELECT term_id FROM cur) AS term_id, {_gross()} AS gross_fee,
   CAST(COALESCE(d.discount, 0) AS {M}) AS discount, CAST(COALESCE(p.total_paid, 0) AS {M}) AS total_paid
 FROM students s JOIN classes c ON s.class_id = c.class_id
 LEFT JOIN disc d ON d.student_id = s.student_id
 LEFT JOIN paid p ON p.student_id = s.student_id
 WHERE s.status = 'Active' AND (SELECT term_id FROM cur) IS NOT NULL)""",
    f"""bal AS (SELECT *, CAST(gross_fee - discount AS {M}) AS total_due,
   CAST(gross_fee - discount - total_paid AS {M}) AS balance,
   CASE WHEN gross_fee - discount - total_paid > 0 THEN 'owing' ELSE 'paid' END AS payment_state,
   discount > 0 AS has_discount
 FROM bal0)""",
)

BAL_SELECT = ("student_id, admission_number, full_name, class_id, class_name, section, is_boarder, term_id, "
              "gross_fee, discount, has_discount, total_due, total_paid, balance, payment_state")

STATUS_SELECT = ("class_id, student_id, admission_number, full_name, is_boarder, gross_fee, discount, "
                 "has_discount, total_due, total_paid, balance")


def _bal(select: str) -> str:
    return _with(BALANCE_VIEWS, *BAL_CTES) + "\n" + select


ORACLE: dict[str, str] = {
    "student_balances": _bal(f"SELECT {BAL_SELECT} FROM bal"),
    "outstanding_balances": _bal(f"SELECT {BAL_SELECT} FROM bal WHERE balance > 0 "
                                 "ORDER BY class_id, lower(full_name), full_name, student_id"),
    "outstanding_summary": _bal(
        f"SELECT CAST(COALESCE(sum(balance), 0) AS {TOTAL}) AS total_outstanding, "
        "CAST(count(*) AS BIGINT) AS owing_count FROM bal WHERE balance > 0"),
    "class_fee_status_owing": _bal(f"SELECT {STATUS_SELECT} FROM bal WHERE balance > 0"),
    "class_fee_status_paid_up": _bal(
        f"SELECT {STATUS_SELECT}, CAST(greatest(balance, 0) AS {M}) AS shown_balance "
        "FROM bal WHERE balance <= 0"),
    "class_fee_status_counts": _bal(
        "SELECT c.class_id, c.class_name, c.section, "
        "CAST(COALESCE(sum(CASE WHEN b.balance <= 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS paid_up_count, "
        "CAST(COALESCE(sum(CASE WHEN b.balance > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS owing_count "
        "FROM classes c LEFT JOIN bal b ON b.class_id = c.class_id "
        "GROUP BY c.class_id, c.class_name, c.section"),
    "fee_collection_summary": _with(("academic_terms", "fee_payments"), CUR) + f"""
SELECT CAST(COALESCE((SELECT sum(amount_paid) FROM fee_payments WHERE term_id = (SELECT term_id FROM cur)), 0) AS {TOTAL}) AS collected_term,
       CAST(COALESCE((SELECT sum(amount_paid) FROM fee_payments), 0) AS {TOTAL}) AS collected_all""",
    "uniform_sales_summary": _with(("uniform_issues",)) + f"""
SELECT CAST(COALESCE(sum(quantity), 0) AS BIGINT) AS total_items_sold,
       CAST(COALESCE(sum(total_price), 0) AS {TOTAL}) AS total_value,
       CAST(COALESCE(sum(amount_paid), 0) AS {TOTAL}) AS total_collected,
       CAST(COALESCE(sum(total_price), 0) - COALESCE(sum(amount_paid), 0) AS {TOTAL}) AS balance_owed
FROM uniform_issues""",
    "uniform_item_sales": _with(("uniform_items", "uniform_issues")) + f"""
SELECT uniform_id, item_name,
       CAST((SELECT COALESCE(sum(quantity), 0) FROM uniform_issues x WHERE x.uniform_id = i.uniform_id) AS BIGINT) AS qty_sold,
       CAST((SELECT COALESCE(sum(total_price), 0) FROM uniform_issues x WHERE x.uniform_id = i.uniform_id) AS {TOTAL}) AS revenue
FROM uniform_items i""",
    "dashboard_stats": _with(("students", "classes", "uniform_items")) + """
SELECT total_students, total_boarders, total_day, total_classes, low_stock_items
FROM (SELECT count(*) AS total_students, count(*) FILTER (is_boarder = 1) AS total_boarders,
             count(*) FILTER (is_boarder = 0) AS total_day
      FROM students WHERE status = 'Active'),
     (SELECT count(*) AS total_classes FROM classes),
     (SELECT count(*) AS low_stock_items FROM uniform_items WHERE quantity_in_stock <= 5)""",
    # Every class once as zero, plus one row per active student.
    "class_counts": _with(("students", "classes")) + """
SELECT class_id, any_value(class_name) AS class_name, any_value(section) AS section, CAST(sum(one) AS BIGINT) AS student_count
FROM (SELECT class_id, class_name, section, 0 AS one FROM classes
      UNION ALL SELECT class_id, NULL, NULL, 1 FROM students WHERE status = 'Active' AND class_id IN (SELECT class_id FROM classes))
GROUP BY class_id""",
    "class_counts_total": _with(("students", "classes")) + """
SELECT CAST(count(*) AS BIGINT) AS total_students FROM students
WHERE status = 'Active' AND class_id IN (SELECT class_id FROM classes)""",
    "recent_payments": _with(("fee_payments", "students", "classes", "fee_discounts", "academic_terms",
                              "boarding_fee"), CUR, BOARD) + f""",
enrolled AS (SELECT * FROM students NATURAL JOIN classes),
ranked AS (SELECT *, row_number() OVER (ORDER BY payment_id DESC) AS place
           FROM fee_payments WHERE student_id IN (SELECT student_id FROM enrolled)),
top AS (SELECT r.payment_id, r.student_id, r.amount_paid, r.date_paid, r.receipt_number, e.full_name, e.is_boarder,
               e.class_id, e.class_name, e.term_fee
        FROM ranked r, enrolled e WHERE r.place <= 5 AND e.student_id = r.student_id),
t2 AS (SELECT t.*, {_gross('t', 't')} AS gross_fee,
   COALESCE((SELECT sum(discount_amount) FROM fee_discounts d WHERE d.student_id = t.student_id AND d.term_id = (SELECT term_id FROM cur)), 0) AS disc,
   COALESCE((SELECT sum(amount_paid) FROM fee_payments p WHERE p.student_id = t.student_id AND p.term_id = (SELECT term_id FROM cur)), 0) AS paid
 FROM top t)
SELECT payment_id, student_id, full_name, class_id, class_name, is_boarder, CAST(amount_paid AS {M}) AS amount_paid,
       date_paid, receipt_number, CAST(gross_fee - disc - paid AS {M}) AS balance
FROM t2 ORDER BY class_id, payment_id DESC""",
    "receipts": _with(("fee_payments", "students", "classes", "academic_terms", "fee_discounts",
                       "boarding_fee"), BOARD) + f""",
d AS (SELECT student_id, term_id, sum(discount_amount) AS discount FROM fee_discounts GROUP BY 1, 2),
p AS (SELECT student_id, term_id, sum(amount_paid) AS total_paid FROM fee_payments GROUP BY 1, 2),
r AS (SELECT fp.payment_id, fp.receipt_number, fp.student_id, s.admission_number, s.full_name, c.class_name,
        c.section, fp.term_id, 'Term ' || CAST(t.term_number AS VARCHAR) || ', ' || CAST(t.academic_year AS VARCHAR) AS term_label,
        CAST(fp.amount_paid AS {M}) AS amount_paid, fp.payment_method, fp.received_by, fp.date_paid,
        {_gross()} AS gross_fee, CAST(COALESCE(d.discount, 0) AS {M}) AS discount,
        CAST(COALESCE(p.total_paid, 0) AS {M}) AS total_paid
      FROM fee_payments fp JOIN students s ON fp.student_id = s.student_id
      JOIN classes c ON s.class_id = c.class_id JOIN academic_terms t ON fp.term_id = t.term_id
      LEFT JOIN d ON d.student_id = fp.student_id AND d.term_id = fp.term_id
      LEFT JOIN p ON p.student_id = fp.student_id AND p.term_id = fp.term_id)
SELECT payment_id, receipt_number, student_id, admission_number, full_name, class_name, section, term_id,
       term_label, amount_paid, payment_method, received_by, date_paid, gross_fee, discount,
       CAST(gross_fee - discount AS {M}) AS total_due, total_paid,
       CAST(gross_fee - discount - total_paid AS {M}) AS balance,
       CASE WHEN gross_fee - discount - total_paid > 0 THEN 'owing' ELSE 'paid' END AS payment_state
FROM r""",
    "student_statement": _with(BALANCE_VIEWS, CUR, BOARD) + f""",
d AS (SELECT student_id, sum(discount_amount) AS discount FROM fee_discounts WHERE term_id = (SELECT term_id FROM cur) GROUP BY 1),
p AS (SELECT student_id, sum(amount_paid) AS total_paid FROM fee_payments WHERE term_id = (SELECT term_id FROM cur) GROUP BY 1),
r AS (SELECT s.student_id, s.admission_number, s.full_name, s.status, c.class_id, c.class_name, c.section,
        s.is_boarder, (SELECT term_id FROM cur) IS NULL AS no_term, {_gross()} AS g,
        CAST(COALESCE(d.discount, 0) AS {M}) AS dd, CAST(COALESCE(p.total_paid, 0) AS {M}) AS pp
      FROM students s JOIN classes c ON s.class_id = c.class_id
      LEFT JOIN d ON d.student_id = s.student_id LEFT JOIN p ON p.student_id = s.student_id),
z AS (SELECT *, CASE WHEN no_term THEN 0 ELSE g END AS gross_fee, CASE WHEN no_term THEN 0 ELSE dd END AS discount,
        CASE WHEN no_term THEN 0 ELSE pp END AS total_paid FROM r)
SELECT student_id, admission_number, full_name, status, class_id, class_name, section,
       class_name || ' (' || section || ')' AS class_label, is_boarder,
       CAST(gross_fee AS {M}) AS gross_fee, CAST(discount AS {M}) AS discount, discount > 0 AS has_discount,
       CAST(gross_fee - discount AS {M}) AS total_due, CAST(total_paid AS {M}) AS total_paid,
       CAST(gross_fee - discount - total_paid AS {M}) AS balance,
       CASE WHEN gross_fee - discount - total_paid > 0 THEN 'owing' ELSE 'paid' END AS payment_state
FROM z""",
    "discount_history": _with(("fee_discounts", "academic_terms"), CUR) + f"""
SELECT discount_id, student_id, term_id, CAST(discount_amount AS {M}) AS discount_amount, reason, approved_by, date_given
FROM fee_discounts WHERE term_id = (SELECT term_id FROM cur)""",
    "payment_history": _with(("fee_payments", "academic_terms")) + f"""
SELECT fp.payment_id, fp.student_id, fp.term_id,
       'T' || CAST(t.term_number AS VARCHAR) || ' ' || CAST(t.academic_year AS VARCHAR) AS term_short,
       CAST(fp.amount_paid AS {M}) AS amount_paid, fp.payment_method, fp.received_by, fp.receipt_number, fp.date_paid
FROM fee_payments fp JOIN academic_terms t ON fp.term_id = t.term_id""",
    "uniform_issue_history": _with(("uniform_issues", "uniform_items")) + f"""
SELECT ui.issue_key, ui.student_id, ui.uniform_id, u.item_name, ui.quantity,
       CAST(ui.total_price AS {M}) AS total_price, CAST(ui.amount_paid AS {M}) AS amount_paid,
       CAST(ui.total_price - ui.amount_paid AS {M}) AS line_balance, ui.date_issued
FROM uniform_issues ui JOIN uniform_items u ON ui.uniform_id = u.uniform_id""",
    "uniform_stock": _with(("uniform_items",)) + f"""
SELECT uniform_id, item_name, applicable_section, applicable_gender, CAST(price AS {M}) AS price,
       quantity_in_stock, quantity_in_stock = 0 AS out_of_stock, quantity_in_stock <= 5 AS low_stock
FROM uniform_items""",
    "low_stock_items": _with(("uniform_items",)) + """
SELECT uniform_id, item_name, quantity_in_stock FROM uniform_items WHERE quantity_in_stock <= 5""",
    "uniform_eligibility": _with(("students", "classes", "uniform_items")) + f""",
seg AS (SELECT DISTINCT c.section, s.gender FROM students s JOIN classes c ON s.class_id = c.class_id)
SELECT seg.section, seg.gender, u.uniform_id, u.item_name, u.applicable_section, u.applicable_gender,
       CAST(u.price AS {M}) AS price, u.quantity_in_stock
FROM seg JOIN uniform_items u
  ON (u.applicable_section = seg.section OR u.applicable_section = 'All')
 AND (u.applicable_gender = seg.gender OR u.applicable_gender = 'All')""",
    "uniform_eligibility_counts": _with(("students", "classes", "uniform_items")) + """
SELECT s.student_id, s.admission_number, s.full_name, s.class_id, c.section, s.gender,
       CAST(count(u.uniform_id) AS BIGINT) AS eligible_items
FROM students s JOIN classes c ON s.class_id = c.class_id
LEFT JOIN uniform_items u
  ON (u.applicable_section = c.section OR u.applicable_section = 'All')
 AND (u.applicable_gender = s.gender OR u.applicable_gender = 'All')
GROUP BY s.student_id, s.admission_number, s.full_name, s.class_id, c.section, s.gender""",
    "term_list": _with(("academic_terms",)) + """
SELECT term_id, academic_year, term_number, is_current,
       'Term ' || CAST(term_number AS VARCHAR) || ', ' || CAST(academic_year AS VARCHAR) AS term_label,
       'T' || CAST(term_number AS VARCHAR) || ' ' || CAST(academic_year AS VARCHAR) AS term_short
FROM academic_terms""",
    "fee_default_list": _with(("fee_defaults",)) + "\nSELECT fee_key, label, amount FROM fee_defaults",
    "staff_roster": _with(("users",)) + "\nSELECT user_id, username, full_name, role FROM users",
    "class_list": _with(("classes",)) + "\nSELECT class_id, class_name, section FROM classes",
}

# Parameters of the search queries registered in the catalog.
SEARCH_TERM = " Customer#000000 "
DIRECTORY_SEARCH = "customer#00000"
DIRECTORY_CLASS = 7

_DETAIL = ("s.student_id, s.admission_number, s.full_name, s.gender, s.date_of_birth, s.class_id, "
           "s.is_boarder, s.guardian_name, s.guardian_phone, s.status, c.class_name, c.section, c.term_fee")

ORACLE.update({
    "student_search": _with(("students", "classes")) + f"""
SELECT {_DETAIL} FROM students s JOIN classes c ON s.class_id = c.class_id
WHERE lower(s.admission_number) = lower('{SEARCH_TERM.strip()}') OR s.full_name ILIKE '%{SEARCH_TERM.strip()}%'""",
    "student_search_outcome": _with(("students", "classes")) + f""",
h AS (SELECT count(*) AS n FROM students s JOIN classes c ON s.class_id = c.class_id
      WHERE lower(s.admission_number) = lower('{SEARCH_TERM.strip()}') OR s.full_name ILIKE '%{SEARCH_TERM.strip()}%')
SELECT '{SEARCH_TERM.strip()}' AS search_term, CAST(n AS BIGINT) AS match_count,
       CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS outcome FROM h""",
    "student_directory": _with(("students", "classes")) + f"""
SELECT {_DETAIL} FROM students s JOIN classes c ON s.class_id = c.class_id
WHERE (s.full_name ILIKE '%{DIRECTORY_SEARCH}%' OR s.admission_number ILIKE '%{DIRECTORY_SEARCH}%')
  AND s.class_id = {DIRECTORY_CLASS}""",
})

ORACLE.update({
    "audit_orphan_discounts": _with(("fee_discounts", "students", "academic_terms")) + """
SELECT d.discount_id, d.student_id, d.term_id,
       CASE WHEN NOT EXISTS (SELECT 1 FROM students s WHERE s.student_id = d.student_id) THEN 'unknown_student'
            ELSE 'unknown_term' END AS violation
FROM fee_discounts d
WHERE NOT EXISTS (SELECT 1 FROM students s WHERE s.student_id = d.student_id)
   OR NOT EXISTS (SELECT 1 FROM academic_terms t WHERE t.term_id = d.term_id)""",
    "audit_duplicate_admissions": _with(("students",)) + """
SELECT lower(admission_number) AS admission_key, CAST(count(*) AS BIGINT) AS occurrences FROM students
GROUP BY lower(admission_number) HAVING count(*) > 1""",
    "audit_duplicate_terms": _with(("academic_terms",)) + """
SELECT academic_year, term_number, CAST(count(*) AS BIGINT) AS occurrences FROM academic_terms
GROUP BY academic_year, term_number HAVING count(*) > 1""",
    "audit_current_term": _with(("academic_terms",)) + """
SELECT CAST(count(*) AS BIGINT) AS current_terms, min(term_id) AS term_used, count(*) <= 1 AS ok
FROM academic_terms WHERE is_current = 1""",
    "current_term_label": _with(("academic_terms",)) + """,
c AS (SELECT * FROM academic_terms WHERE is_current = 1 ORDER BY term_id LIMIT 1)
SELECT COALESCE((SELECT 'Term ' || CAST(term_number AS VARCHAR) || ', ' || CAST(academic_year AS VARCHAR) FROM c),
                'No term set') AS term_label""",
})


# One student's, one class's and one payment's pages: the population's result, filtered.
# Keys that the tables have at every generated size.
ONE_STUDENT, ONE_CLASS, ONE_PAYMENT, ONE_ADMISSION = 50, 7, 10, " adm-000050 "
_ADM = ONE_ADMISSION.strip().lower()


def _only(name: str, condition: str) -> str:
    return f"SELECT * FROM ({ORACLE[name]}) WHERE {condition}"


ORACLE.update({
    "student_lookup": _with(("students", "classes")) + f"""
SELECT {_DETAIL} FROM students s JOIN classes c USING (class_id) WHERE lower(s.admission_number) = '{_ADM}'""",
    "student_statement_one": _only("student_statement", f"lower(admission_number) = '{_ADM}'"),
    "receipt_one": _only("receipts", f"payment_id = {ONE_PAYMENT}"),
    "payment_history_one": _only("payment_history", f"student_id = {ONE_STUDENT}"),
    "discount_history_one": _only("discount_history", f"student_id = {ONE_STUDENT}"),
    "uniform_issue_history_one": _only("uniform_issue_history", f"student_id = {ONE_STUDENT}"),
    "class_fee_status_owing_class": _only("class_fee_status_owing", f"class_id = {ONE_CLASS}"),
    "class_fee_status_paid_up_class": _only("class_fee_status_paid_up", f"class_id = {ONE_CLASS}"),
    "eligible_items_for_class": _with(("students", "classes", "uniform_items")) + f"""
SELECT s.student_id, u.uniform_id, u.item_name, u.applicable_section, u.applicable_gender,
       CAST(u.price AS {M}) AS price, u.quantity_in_stock
FROM students s JOIN classes c USING (class_id) JOIN uniform_items u
  ON u.applicable_section IN (c.section, 'All') AND u.applicable_gender IN (s.gender, 'All')
WHERE class_id = {ONE_CLASS}""",
    "statement_display": f"""SELECT st.student_id, split_part(st.full_name, ' ', 1) AS first_name,
       CASE st.is_boarder WHEN 1 THEN 'Yes' ELSE 'No' END AS boarder,
       format('{{:,}}', CAST(round(st.total_due, 0) AS BIGINT)) AS total_due_text,
       format('{{:,}}', CAST(round(st.balance, 0) AS BIGINT)) AS balance_text,
       CASE WHEN g.guardian IS NULL OR g.guardian IN ('', '0') THEN 'N/A' ELSE g.guardian END AS guardian,
       TRY_CAST(regexp_extract(st.admission_number, '[^-]*$') AS INTEGER) AS admission_serial
FROM ({ORACLE["student_statement"]}) st
JOIN (SELECT student_id, guardian_name AS guardian FROM ({_with(("students",))} SELECT * FROM students)) g USING (student_id)""",
    "report_term_label": ORACLE["current_term_label"].replace("'No term set'", "'No current term set'"),
})

#: Admission number and search term of each outcome of a lookup.
OUTCOMES = {"found": (ONE_ADMISSION, ""), "not_found": ("ADM-none", "Customer"), "none": ("", "nobody at all"),
            "one": ("", "customer#000000042")}
for _name, (_number, _term) in OUTCOMES.items():
    _by_number = _number.strip().lower()
    ORACLE[f"student_search_outcome_{_name}"] = _with(("students", "classes")) + f""",
h AS (SELECT count(*) AS n FROM students s JOIN classes c USING (class_id)
      WHERE {f"lower(s.admission_number) = '{_by_number}'" if _by_number else f"s.full_name ILIKE '%{_term}%'"})
SELECT '{_number.strip() or _term.strip()}' AS search_term, CAST(n AS BIGINT) AS match_count,
       CASE WHEN {bool(_by_number)} THEN CASE n WHEN 0 THEN 'not_found' ELSE 'found' END
            ELSE CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END END AS outcome FROM h"""
