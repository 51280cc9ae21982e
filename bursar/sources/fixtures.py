"""Test inputs: the driver's generated tables seen as the school tables (FIXTURES.md).

Each view only renames and types columns of the generated tables into the shape a school table has;
it does none of a job's work. The same SQL text runs in Spark (with DataFrame arguments) and in DuckDB
(as a CTE of an oracle query), so both engines see identical inputs.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from bursar.sources import schemas
from bursar.sources.tables import conform

_TERM_OF = ("CAST((year({d})-1995)*3 + CASE WHEN month({d})<=4 THEN 1 WHEN month({d})<=8 THEN 2 "
            "ELSE 3 END AS INT)")


def _term(col: str) -> str:
    return _TERM_OF.format(d=col)


# Fixture view definitions (FIXTURES.md). ``{name}`` marks a generated base table.
VIEW_SQL: dict[str, str] = {
    "classes": """
SELECT n_nationkey+1 AS class_id, n_name AS class_name,
  CASE WHEN n_regionkey=0 THEN 'Nursery' WHEN n_regionkey<=2 THEN 'Lower Primary' ELSE 'Upper Primary' END AS section,
  CAST(CASE WHEN n_regionkey=0 THEN 80000 ELSE 90000 END AS DECIMAL(12,2)) AS term_fee
FROM {nation}""",
    "students": """
SELECT c_custkey+1 AS student_id,
  concat('ADM-',lpad(CAST(CASE WHEN c_custkey%251=250 THEN c_custkey ELSE c_custkey+1 END AS STRING),6,'0')) AS admission_number, c_name AS full_name,
  CASE WHEN c_custkey%2=0 THEN 'Female' ELSE 'Male' END AS gender, c_nationkey+1 AS class_id,
  CASE WHEN c_mktsegment='HOUSEHOLD' THEN 1 ELSE 0 END AS is_boarder,
  CASE WHEN c_custkey%3=0 THEN '' ELSE concat('Guardian ',CAST(c_custkey AS STRING)) END AS guardian_name,
  CASE WHEN c_nationkey=24 OR c_acctbal>=9500 THEN 'Graduated' WHEN c_acctbal< -500 THEN 'Withdrawn' ELSE 'Active' END AS status
FROM {customer}""",
    "academic_terms": f"""
SELECT DISTINCT {_term('o_orderdate')} AS term_id, CAST(year(o_orderdate) AS INT) AS academic_year,
  CASE WHEN month(o_orderdate)<=4 THEN 1 WHEN month(o_orderdate)<=8 THEN 2 ELSE 3 END AS term_number,
  CASE WHEN year(o_orderdate)=1998 AND month(o_orderdate) BETWEEN 5 AND 8 THEN 1 ELSE 0 END AS is_current
FROM {{orders}}
UNION ALL SELECT DISTINCT 90+month(o_orderdate) AS term_id, 1995 AS academic_year, month(o_orderdate) AS term_number, 0 AS is_current
FROM {{orders}} WHERE month(o_orderdate)<=3""",
    "fee_payments": f"""
SELECT o_orderkey+1 AS payment_id, o_custkey+1 AS student_id, {_term('o_orderdate')} AS term_id,
  CAST(CASE o_orderkey%5 WHEN 0 THEN 90000 WHEN 1 THEN 80000 WHEN 2 THEN 350000 ELSE o_totalprice END AS DECIMAL(12,2)) AS amount_paid,
  CASE o_orderkey%3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Mobile Money' ELSE 'Bank' END AS payment_method,
  concat('Clerk ',CAST(o_orderkey%7 AS STRING)) AS received_by,
  concat('RCT-',CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS STRING),'-',CAST(1000+o_orderkey%9000 AS STRING)) AS receipt_number,
  CAST(o_orderdate AS DATE) AS date_paid
FROM {{orders}}
WHERE o_orderstatus<>'P'""",
    "fee_discounts": f"""
SELECT o_orderkey+1 AS discount_id, CASE WHEN o_orderkey%97=0 THEN -1-o_custkey ELSE o_custkey+1 END AS student_id,
  CASE WHEN o_orderkey%89=0 THEN 99 ELSE {_term('o_orderdate')} END AS term_id,
  CAST(floor(o_totalprice/10) AS DECIMAL(10,2)) AS discount_amount, o_orderpriority AS reason,
  concat('Approver ',CAST(o_orderkey%4 AS STRING)) AS approved_by, CAST(o_orderdate AS DATE) AS date_given
FROM {{orders}}
WHERE o_orderstatus='P'""",
    "boarding_fee": "SELECT CAST(350000 AS DECIMAL(12,2)) AS amount",
    # One row per section fee of the class mapping below Upper Primary: that row and the boarding row are
    # left for the seed to add. A fourth key has no seed.
    "fee_defaults": """
SELECT DISTINCT
  CASE WHEN n_regionkey=0 THEN 'nursery' ELSE 'lower_primary' END AS fee_key,
  CASE WHEN n_regionkey=0 THEN 'Nursery' ELSE 'Lower Primary' END AS label,
  CASE WHEN n_regionkey=0 THEN 80000 ELSE 85000 END AS amount
FROM {nation} WHERE n_regionkey<=2
UNION ALL SELECT 'meals', 'Meals', 40000""",
    "uniform_items": """
SELECT p_partkey+1 AS uniform_id, p_name AS item_name,
  CASE WHEN p_type='ECONOMY' THEN 'Nursery' WHEN p_type IN ('SMALL','MEDIUM') THEN 'Lower Primary' WHEN p_type='LARGE' THEN 'Upper Primary' ELSE 'All' END AS applicable_section,
  CASE p_size%3 WHEN 0 THEN 'All' WHEN 1 THEN 'Male' ELSE 'Female' END AS applicable_gender,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size-1 AS quantity_in_stock
FROM {part}""",
    "uniform_issues": """
SELECT l_orderkey*10+l_linenumber AS issue_key, o_custkey+1 AS student_id, p_partkey+1 AS uniform_id,
  CAST(l_quantity AS INT) AS quantity,
  CAST(CAST(l_quantity AS INT)*CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS total_price,
  CAST(CAST(l_quantity AS INT)*CAST(p_retailprice AS DECIMAL(12,2)) - CASE WHEN l_discount>0.05 THEN 500 ELSE 0 END AS DECIMAL(12,2)) AS amount_paid,
  CAST(l_shipdate AS DATE) AS date_issued
FROM {lineitem}
JOIN {orders} ON l_orderkey=o_orderkey
JOIN {part} ON p_partkey=CASE WHEN l_partkey%10=0 THEN l_partkey+1 ELSE l_partkey END""",
    "users": """
SELECT s_suppkey+1 AS user_id, lower(s_name) AS username, s_name AS full_name,
  CASE s_suppkey%3 WHEN 0 THEN 'Accountant' WHEN 1 THEN 'Teacher' ELSE 'Admin' END AS role
FROM {supplier}""",
    "payment_commands": """
SELECT event_id AS seq, user_id*11+1 AS student_id, CAST(8+event_id%16 AS INT) AS term_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value) END AS DECIMAL(12,2)) AS amount_paid,
  'Cash' AS payment_method, CAST(ts AS DATE) AS date_paid
FROM {events}
WHERE event_type='purchase'""",
    "discount_commands": """
SELECT event_id AS seq, user_id*11+1 AS student_id, CAST(8+event_id%16 AS INT) AS term_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value) END AS DECIMAL(10,2)) AS discount_amount,
  CASE WHEN event_id%4=0 THEN '' ELSE 'Head' END AS approved_by
FROM {events}
WHERE event_type='signup'""",
    "restock_commands": """
SELECT event_id AS seq, user_id*15+1 AS uniform_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value) END AS INT) AS add_quantity
FROM {events}
WHERE event_type='view'""",
    "registration_commands": """
SELECT event_id AS seq,
  CASE WHEN event_id%7=0 THEN '' WHEN event_id%5=0 THEN concat('ADM-',lpad(CAST(user_id*11+1 AS STRING),6,'0')) ELSE concat('ADM-',CAST(900000+user_id AS STRING)) END AS admission_number,
  concat(' New ',CAST(event_id AS STRING),' ') AS full_name, 'Male' AS gender,
  CAST(user_id%25+1 AS INT) AS class_id, 0 AS is_boarder
FROM {events}
WHERE event_type='click'""",
    # Further command views (ours, same style): the 'error' events drive edits and deletes.
    "payment_edit_commands": """
SELECT event_id AS seq, event_id+1 AS payment_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value)*100 END AS DECIMAL(12,2)) AS amount_paid,
  CASE WHEN event_id%2=0 THEN 'Bank' ELSE 'Mobile Money' END AS payment_method,
  concat(' Clerk ',CAST(user_id%5 AS STRING),' ') AS received_by
FROM {events}
WHERE event_type='error'""",
    "payment_delete_commands": """
SELECT event_id AS seq, event_id*2+1 AS payment_id
FROM {events}
WHERE event_type='error'""",
    "student_update_commands": """
SELECT event_id AS seq, user_id*11+1 AS student_id, concat(' Renamed ',CAST(event_id AS STRING)) AS full_name,
  CASE WHEN event_id%2=0 THEN 'Female' ELSE 'Male' END AS gender, CAST(user_id%25+1 AS INT) AS class_id,
  CAST(event_id%2 AS INT) AS is_boarder,
  CASE WHEN event_id%5=0 THEN '' ELSE concat('Guardian ',CAST(user_id AS STRING)) END AS guardian_name,
  CASE event_id%4 WHEN 0 THEN 'Graduated' WHEN 1 THEN 'Withdrawn' ELSE 'Active' END AS status
FROM {events}
WHERE event_type='error'""",
    "student_delete_commands": """
SELECT event_id AS seq, user_id*13+1 AS student_id
FROM {events}
WHERE event_type='error'""",
    "term_commands": """
SELECT event_id AS seq, CAST(1995+event_id%40 AS INT) AS academic_year, CAST(1+event_id%3 AS INT) AS term_number
FROM {events}
WHERE event_type='error'""",
    "fee_default_commands": """
SELECT event_id AS seq,
  CASE event_id%6 WHEN 0 THEN 'boarding' WHEN 1 THEN 'upper_primary' WHEN 2 THEN 'lower_primary' WHEN 3 THEN 'nursery' WHEN 4 THEN '' ELSE 'transport' END AS fee_key,
  CAST(CASE WHEN event_id%13=0 THEN -5 ELSE ceil(value)*1000 END AS INT) AS amount
FROM {events}
WHERE event_type='error'""",
    "item_add_commands": """
SELECT event_id AS seq, CASE WHEN event_id%9=0 THEN '  ' ELSE concat(' Item ',CAST(event_id AS STRING)) END AS item_name,
  CASE event_id%4 WHEN 0 THEN 'Nursery' WHEN 1 THEN 'Lower Primary' WHEN 2 THEN 'Upper Primary' ELSE 'All' END AS applicable_section,
  CASE event_id%3 WHEN 0 THEN 'All' WHEN 1 THEN 'Male' ELSE 'Female' END AS applicable_gender,
  CAST(CASE WHEN event_id%17=0 THEN -1 WHEN event_id%19=0 THEN NULL ELSE ceil(value) END AS DECIMAL(12,2)) AS price,
  CAST(event_id%50-5 AS INT) AS initial_stock
FROM {events}
WHERE event_type='view'""",
    "item_update_commands": """
SELECT event_id AS seq, user_id*15+1 AS uniform_id,
  CASE WHEN event_id%9=0 THEN '' ELSE concat('Renamed item ',CAST(event_id AS STRING)) END AS item_name,
  CASE event_id%4 WHEN 0 THEN 'Nursery' WHEN 1 THEN 'Lower Primary' WHEN 2 THEN 'Upper Primary' ELSE 'All' END AS applicable_section,
  CASE event_id%3 WHEN 0 THEN 'All' WHEN 1 THEN 'Male' ELSE 'Female' END AS applicable_gender,
  CAST(CASE WHEN event_id%17=0 THEN -1 ELSE ceil(value) END AS DECIMAL(12,2)) AS price
FROM {events}
WHERE event_type='click'""",
    # Restocks with a day, spread over the days of the issue requests.
    "dated_restock_commands": """
SELECT event_id AS seq, CASE WHEN event_id%3=0 THEN user_id*15+1 ELSE event_id%50+1 END AS uniform_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value) END AS INT) AS add_quantity,
  DATE '1995-01-02' + CAST(event_id%2400 AS INT) AS date_added
FROM {events}
WHERE event_type='view'""",
    # Payments recorded, edited and deleted in one log; half of the edits and deletes aim near the key that a
    # payment recorded at about that time gets.
    "payment_log": """
SELECT event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'record' WHEN 'error' THEN 'edit' ELSE 'delete' END AS action,
  CASE WHEN event_type='purchase' THEN NULL WHEN event_id%2=0 THEN event_id+1
    ELSE (SELECT max(o_orderkey)+1 FROM {orders} WHERE o_orderstatus<>'P') + CAST(floor(event_id/5) AS BIGINT) - event_id%40 + 15 END AS payment_id,
  user_id*11+1 AS student_id, CAST(8+event_id%16 AS INT) AS term_id,
  CAST(CASE WHEN event_id%10=0 THEN 0 ELSE ceil(value) END AS DECIMAL(12,2)) AS amount_paid,
  CASE WHEN event_id%4=0 THEN 'Bank' ELSE 'Cash' END AS payment_method,
  concat(' Clerk ',CAST(user_id%5 AS STRING),' ') AS received_by, CAST(ts AS DATE) AS date_paid
FROM {events}
WHERE event_type IN ('purchase','error','signup')""",
    # Registrations that want few numbers again and again, and deletions of students of the table and of those
    # that a registration near in time makes.
    "student_log": """
SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'register' ELSE 'delete' END AS action,
  CASE WHEN event_type='click' THEN NULL WHEN event_id%2=0 THEN user_id*11+1
    ELSE (SELECT max(c_custkey)+1 FROM {customer}) + CAST(floor(event_id*2/5) AS BIGINT) - event_id%12 + 4 END AS student_id,
  CASE WHEN event_type<>'click' THEN NULL WHEN event_id%7=0 THEN '' WHEN event_id%5=0 THEN concat('ADM-',lpad(CAST(user_id*11+1 AS STRING),6,'0'))
    WHEN event_id%3=0 THEN 'adm-Hot' ELSE concat('ADM-',CAST(900000+user_id%20 AS STRING)) END AS admission_number,
  concat(' New ',CAST(event_id AS STRING),' ') AS full_name, 'Male' AS gender,
  CAST(user_id%25+1 AS INT) AS class_id, 0 AS is_boarder
FROM {events}
WHERE event_type IN ('click','error')""",
    # What clerks typed: numbers, parts of names, wildcards, nothing.
    "search_terms": """
SELECT event_id AS term_key,
  CASE WHEN event_id%4=0 THEN concat(' adm-',lpad(CAST(user_id*11+1 AS STRING),6,'0')) END AS admission_number,
  CASE event_id%9 WHEN 0 THEN '' WHEN 1 THEN concat('r#0000',CAST(user_id%90+10 AS STRING)) WHEN 2 THEN concat('%',CAST(user_id AS STRING),'%')
    WHEN 3 THEN CAST(user_id%100 AS STRING) WHEN 4 THEN concat('Customer#_0000',CAST(user_id AS STRING)) WHEN 5 THEN concat('ADM-',lpad(CAST(user_id AS STRING),6,'0'))
    ELSE concat('000',CAST(user_id AS STRING)) END AS search
FROM {events}
WHERE event_type='signup' AND event_id%20=6""",
    # Uniform issue requests: the issue lines, in issue order, replayed against opening stock.
    "issue_requests": """
SELECT l_orderkey*10+l_linenumber AS request_id, o_custkey+1 AS student_id, p_partkey+1 AS uniform_id,
  CAST(l_quantity AS INT) AS quantity,
  CAST(CAST(l_quantity AS INT)*CAST(p_retailprice AS DECIMAL(12,2)) - CASE WHEN l_discount>0.05 THEN 500 ELSE 0 END AS DECIMAL(12,2)) AS amount_paid,
  CAST(l_shipdate AS DATE) AS date_issued
FROM {lineitem}
JOIN {orders} ON l_orderkey=o_orderkey
JOIN {part} ON p_partkey=CASE WHEN l_partkey%10=0 THEN l_partkey+1 ELSE l_partkey END""",
}

VIEW_SCHEMA = {
    **schemas.TABLES,
    "payment_commands": schemas.PAYMENT_COMMANDS,
    "discount_commands": schemas.DISCOUNT_COMMANDS,
    "restock_commands": schemas.RESTOCK_COMMANDS,
    "registration_commands": schemas.REGISTRATION_COMMANDS,
    "payment_edit_commands": schemas.PAYMENT_EDIT_COMMANDS,
    "payment_delete_commands": schemas.KEY_COMMANDS_PAYMENT,
    "student_update_commands": schemas.STUDENT_UPDATE_COMMANDS,
    "student_delete_commands": schemas.KEY_COMMANDS_STUDENT,
    "term_commands": schemas.TERM_COMMANDS,
    "fee_default_commands": schemas.FEE_DEFAULT_COMMANDS,
    "item_add_commands": schemas.ITEM_COMMANDS,
    "item_update_commands": schemas.ITEM_COMMANDS,
    "issue_requests": schemas.ISSUE_REQUESTS,
    "dated_restock_commands": schemas.DATED_RESTOCKS,
    "payment_log": schemas.PAYMENT_LOG,
    "student_log": schemas.STUDENT_LOG,
    "search_terms": schemas.SEARCH_TERMS,
}

_HANDLES: dict[tuple[str, str, str], DataFrame] = {}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def base_tables_of(view: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(VIEW_SQL[view])))


class Fixture:
    """The school tables of one generated scale-factor folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
            if key not in _HANDLES:  # one file listing / footer read per table and session
                _HANDLES[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._base[name] = _HANDLES[key]
        return self._base[name]

    def __getitem__(self, view: str) -> DataFrame:
        if view not in self._views:
            key = (self.spark.sparkContext.applicationId, self.sf_dir, "view:" + view)
            if key not in _HANDLES:  # view definitions are analysed once per session, like catalog views
                args = {b: self.base(b) for b in base_tables_of(view)}
                _HANDLES[key] = conform(self.spark.sql(VIEW_SQL[view], **args), VIEW_SCHEMA[view])
            self._views[view] = _HANDLES[key]
        return self._views[view]


def duckdb_view_sql(view: str) -> str:
    """The view text with base tables named as the DuckDB oracle registers them."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEW_SQL[view])


def duckdb_with(*views: str) -> str:
    """``WITH v1 AS (...), v2 AS (...)`` clause defining the given fixture views for DuckDB."""
    return "WITH " + ",\n".join(f"{v} AS ({_typed_duckdb(v)})" for v in views)


_DUCK_TYPES = {
    "LongType()": "BIGINT", "IntegerType()": "INTEGER", "StringType()": "VARCHAR",
    "DateType()": "DATE", "DecimalType(12,2)": "DECIMAL(12,2)", "DecimalType(10,2)": "DECIMAL(10,2)",
}


@lru_cache(maxsize=None)
def _typed_duckdb(view: str) -> str:
    """The view, re-typed to its declared schema the way ``conform`` does on the Spark side."""
    cols = []
    names = _view_columns(view)
    for field in VIEW_SCHEMA[view].fields:
        duck = _DUCK_TYPES[repr(field.dataType)]
        if field.name in names:
            cols.append(f"CAST(v.{field.name} AS {duck}) AS {field.name}")
        else:
            cols.append(f"CAST(NULL AS {duck}) AS {field.name}")
    return f"SELECT {', '.join(cols)} FROM ({duckdb_view_sql(view)}) v"


def _view_columns(view: str) -> set[str]:
    return set(re.findall(r"\bAS\s+([a-z_]+)\b", VIEW_SQL[view], flags=re.IGNORECASE))
