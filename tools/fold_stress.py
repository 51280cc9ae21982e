"""Run the stock fold on real data with settings that force carried runs everywhere (many segments, tiny
composition blocks) and compare each run with the DuckDB oracle.

Usage: python tools/fold_stress.py [sf_dir]   (default /root/testdata/sf0.1)
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from bursar.session import get_session
from bursar.sources.fixtures import Fixture
from bursar.operators.stock_fold import issue_uniforms
from bursar.plans.changes_catalog import CHANGE_ORACLE
spark = get_session("local[8]", 8)
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
fx = Fixture(spark, sf)
con = duckdb.connect()
for t in ["part", "orders", "lineitem"]:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
want = sorted(con.sql(CHANGE_ORACLE["issue_uniforms"]).fetchall())
want_stock = sorted(con.sql(CHANGE_ORACLE["issue_uniforms_stock"]).fetchall())
print("oracle accepted", len(want))
for nseg, block in ((64, 2), (256, 2), (256, 3)):
    t = time.time()
    r = issue_uniforms(fx["uniform_items"], fx["issue_requests"], segments=nseg, block=block)
    got = sorted(tuple(x) for x in r.issued.collect())
    stock = sorted(tuple(x) for x in r.items.collect())
    print(nseg, block, "match", got == want, stock == want_stock, round(time.time() - t, 1), "s")
