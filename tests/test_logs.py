"""Command logs in one time order and tables of search terms, against plain serial versions."""

from __future__ import annotations

import random
import re
from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bursar.operators import stock_ledger as led
from bursar.operators.payment_log import apply_payment_log
from bursar.operators.staging import staged
from bursar.operators.stock_fold import apply_at
from bursar.operators.student_log import apply_student_log, following, reachable
from bursar.operators.student_search_many import search_outcomes
from bursar.sources import schemas
from tests.days import day

EVENTS = st.lists(st.one_of(st.tuples(st.just(0), st.integers(1, 40)), st.tuples(st.just(1), st.integers(0, 12))), max_size=60)


def serial(rise, take, left):
    accepted = []
    for a, q in zip(rise, take):
        left += a
        accepted.append(0 < q <= left)
        left -= q if accepted[-1] else 0
    return accepted, left


def split(events):
    return (np.array([q if k == 0 else 0 for k, q in events], np.int64), np.array([q if k == 1 else 0 for k, q in events], np.int64))


@given(EVENTS, st.integers(-5, 60))
@settings(max_examples=300, deadline=None)
def test_fold_of_events(events, start):
    rise, take = split(events)
    accepted, left = led.fold_events(rise, take, start)
    assert (accepted.tolist(), left) == serial(rise, take, start)


@given(EVENTS, EVENTS, st.integers(0, 60), st.integers(0, 15))
@settings(max_examples=300, deadline=None)
def test_windows_hold_every_stock_and_compose(first, second, start, slack):
    """W stays a lower bound, W + Q an upper one, and a segment's function gives each stock's true slack."""
    widest = max([q for k, q in first + second if k == 1], default=0)
    stock, low = start + min(slack, widest), start
    for events in (first, second):
        rise, take = split(events)
        fall, floor = led.measure(rise, take)
        high = max(floor, low - fall)
        f = led.window_function(rise, take, low, high, widest)
        for s in range(low, low + widest + 1):
            left = serial(rise, take, s)[1]
            assert high <= left <= high + widest
            assert apply_at(f, low + widest - s) == high + widest - left
        stock, low = serial(rise, take, stock)[1], high


def ledger_tables(make, spark, n=1500, seed=3):
    rnd = random.Random(seed)
    items = make("uniform_items", [{"uniform_id": i, "item_name": f"i{i}", "price": D("2.50") if i != 4 else D("9999999999.99"),
                                    "quantity_in_stock": None if i == 3 else rnd.randrange(0, 30)} for i in range(1, 7)])
    ids = [1] * 12 + [2, 3, 4, 5, 99, None]  # item 1 has two thirds of the events
    requests = [(k, rnd.randrange(5), rnd.choice(ids), rnd.choice([None, -1, 0, *range(1, 25)]), D("1.00"), rnd.choice([None, *(day(f"2024-01-{d:02d}") for d in range(1, 29))]))
                for k in range(n)]
    restocks = [(k, rnd.choice(ids), rnd.choice([None, 0, -3, 5, 30, 200]), day(f"2024-01-{rnd.randrange(1, 29):02d}")) for k in range(n // 6)]
    return (items, spark.createDataFrame(requests, schemas.ISSUE_REQUESTS).repartition(3),
            spark.createDataFrame(restocks, schemas.DATED_RESTOCKS), requests, restocks)


@pytest.mark.parametrize("segments,block", [(1, 8), (40, 3), (150, 2)])
def test_ledger_equals_the_serial_fold(spark, make, segments, block):
    items, requests, restocks, r_rows, a_rows = ledger_tables(make, spark)
    got = led.stock_ledger(items, requests, restocks, segments=segments, block=block)
    base = {r.uniform_id: r for r in items.collect()}
    early = day("1900-01-01")
    events = [(d or early, 1, k, u, q, s) for k, s, u, q, _, d in r_rows] + [(d or early, 0, k, u, q, None) for k, u, q, d in a_rows]
    left = {u: r.quantity_in_stock or 0 for u, r in base.items()}
    issued, rejects = set(), set()
    for _, kind, k, u, q, _ in sorted(events, key=lambda e: e[:3]):
        name = ("restock", "issue")[kind]
        if kind == 0 and (q is None or q < 1):
            rejects.add((name, k, u, "invalid_quantity"))
        elif u not in base:
            rejects.add((name, k, u, "unknown_uniform" if kind == 0 else "unknown_item"))
        elif q is None or q < 1:
            rejects.add((name, k, u, "invalid_quantity"))
        elif kind == 0:
            left[u] += q
        elif q * base[u].price >= 10 ** 10:
            rejects.add((name, k, u, "total_too_large"))
        elif q <= left[u]:
            left[u] -= q
            issued.add((k, u, q, q * base[u].price))
        else:
            rejects.add((name, k, u, "insufficient_stock"))
    assert {(r.issue_key, r.uniform_id, r.quantity, r.total_price) for r in got.issued.collect()} == issued
    assert {(r.kind, r.event_id, r.uniform_id, r.reject_reason) for r in got.rejects.collect()} == rejects
    assert len(issued) > 100 and {r[3] for r in rejects} >= {"insufficient_stock", "unknown_item", "unknown_uniform", "total_too_large"}
    want = {u: left[u] if base[u].quantity_in_stock is not None else None for u in base}
    assert {r.uniform_id: r.quantity_in_stock for r in got.items.collect()} == want


def test_ledger_keys_and_empty_tables(spark, make):
    items, requests, restocks, *_ = ledger_tables(make, spark, n=60)
    got = led.stock_ledger(items, requests.limit(0), restocks.limit(0))
    assert got.issued.count() == 0 and got.rejects.count() == 0 and got.items.exceptAll(items).count() == 0
    issues = make("uniform_issues", [{"issue_key": 500}])
    issued = led.stock_ledger(items, requests, restocks).issued
    keys = [r.issue_key for r in led.with_keys(issued, issues).collect()]
    assert sorted(keys) == list(range(501, 501 + issued.count()))


# ------------------------------------------------------------------------------------- payments

def test_payment_log_equals_serial(spark, make):
    rnd = random.Random(5)
    payments = make("fee_payments", [{"payment_id": i, "student_id": i, "term_id": 1, "amount_paid": D("10.00"), "received_by": "old"} for i in range(1, 8)])
    rows = []
    for k in range(400):
        action = rnd.choice(["record", "edit", "edit", "delete", "other", None])
        pid = rnd.choice([3, 3, 3, rnd.randrange(1, 90), None])  # payment 3 has most commands
        rows.append((k // 2, action, pid, k, 2, rnd.choice([None, D("0.00"), D(k + 1)]), "Cash", f" clerk {k} ", None))
    log = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], schemas.PAYMENT_LOG).repartition(4)
    got = apply_payment_log(payments, log, today="2024-02-03")
    state = {r.payment_id: (r.student_id, r.amount_paid, r.received_by) for r in payments.collect()}
    top, rejects = 7, set()
    for i, (_, action, pid, student, _, amount, _, clerk, _) in enumerate(rows):
        bad = amount is None or amount <= 0
        if action not in ("record", "edit", "delete"):
            rejects.add((i, action, pid, "unknown_action"))
        elif action != "delete" and bad:
            rejects.add((i, action, pid, "invalid_amount"))
        elif action == "record":
            top += 1
            state[top] = (student, amount, clerk.strip())
        elif pid not in state:
            rejects.add((i, action, pid, "unknown_payment"))
        elif action == "edit":
            state[pid] = (state[pid][0], amount, clerk.strip())
        else:
            del state[pid]
    assert {r.payment_id: (r.student_id, r.amount_paid, r.received_by) for r in got.table.collect()} == state
    assert {(r.seq, r.action, r.payment_id, r.reject_reason) for r in got.rejects.collect()} == rejects
    assert any(p > 7 for p in state) and 3 not in state


# ------------------------------------------------------------------------------------- students

def test_following_over_many_partitions(spark):
    rnd = random.Random(1)
    offers = [(rnd.choice("aab"), p) for p in rnd.sample(range(2000), 300)]
    asked = [(k, p) for k in "abc" for p in range(0, 2100, 7)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.key, r.at): r.next for r in following(spark.createDataFrame(offers, "key string, at long"),
                                                        spark.createDataFrame(asked, "key string, at long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(k, p): min((q for j, q in offers if j == k and q > p), default=None) for k, p in asked}


def test_reachable_by_doubling(spark):
    steps = [(k, k + 1) for k in range(0, 37)] + [(100, 105), (105, None), (200, 201)]
    got = reachable(spark.createDataFrame(steps, "node long, next long"), spark.createDataFrame([(0,), (100,)], "node long"))
    assert {r.node for r in got.collect()} == {*range(38), 100, 105}


def test_student_log_equals_serial(spark, make):
    rnd = random.Random(6)
    students = make("students", [{"student_id": i, "admission_number": n, "full_name": f"s{i}", "class_id": 1, "status": "Active"}
                                 for i, n in enumerate(["A-1", "a-1", "B-2", "HOT", "D"], 1)])
    rows, there = [], {r.student_id: r.admission_number.lower() for r in students.collect()}
    for k in range(500):
        if rnd.random() < .55:
            number = rnd.choice([" hot ", "Hot", "HOT", "a-1", "b-2", "new", "", "0", None])
            rows.append(("register", None, number, f" n{k} "))
            key = (number or "").strip().lower()
            if key not in ("", "0") and key not in there.values():
                there[5 + k + 1] = key
        else:  # mostly someone who is there
            sid = rnd.choice([*there, *there, 5 + k + 3, 5 + k - 9, None])
            rows.append((rnd.choice(["delete"] * 9 + ["x"]), sid, None, None))
            if rows[-1][0] == "delete":
                there.pop(sid, None)
    log = spark.createDataFrame([(i, a, s, n, f, None, None, 1, None, None, None) for i, (a, s, n, f) in enumerate(rows)], schemas.STUDENT_LOG).repartition(4)
    got = apply_student_log(students, log)
    state = {r.student_id: r.admission_number for r in students.collect()}
    rejects, gone = set(), set()
    for i, (action, sid, number, name) in enumerate(rows):
        trimmed = (number or "").strip()
        if action == "register":
            if trimmed in ("", "0"):
                rejects.add((i, action, "missing_fields"))
            elif trimmed.lower() in {n.lower() for n in state.values()}:
                rejects.add((i, action, "admission_exists"))
            else:
                state[5 + i + 1] = trimmed
        elif action != "delete":
            rejects.add((i, action, "unknown_action"))
        elif sid in state:
            del state[sid]
            gone.add(sid)
        else:
            rejects.add((i, action, "unknown_student"))
    assert {r.student_id: r.admission_number for r in got.table.collect()} == state
    assert {(r.seq, r.action, r.reject_reason) for r in got.rejects.collect()} == rejects
    assert {r.student_id for r in got.deleted.collect()} == gone and len(gone) > 20
    assert {r.student_id for r in got.added.collect()} == {s for s in state if s > 5}


# --------------------------------------------------------------------------------------- search

def like(term, name):
    """MySQL's LIKE '%term%', letter case aside."""
    out, k = "", 0
    while k < len(term):
        c = term[k]
        if c == "\\" and k + 1 < len(term):
            out += re.escape(term[k + 1])
            k += 1
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return name is not None and re.fullmatch(f".*{out}.*", name, re.I | re.S) is not None


def test_search_outcomes_equal_serial(spark, make, school):
    names = ["Amina", "amina", "Bo", "O%car", "O_car", "back\\slash", "x", "", None, "Zoë Éa", "  spaced  "]
    students = make("students", [{"student_id": i, "admission_number": f"UB-{i}", "full_name": n, "class_id": 1 if i != 3 else 77, "status": "Active"}
                                 for i, n in enumerate(names)])
    terms = ["a", "AM", "ami", "amina", "min%a", "a%a", "%", "_", "__", "____________________", "%_%", "O\\%", "O\\_c", "k\\\\s", "k\\s", "s\\l", "\\",
             "ub-1", " UB-2 ", "", "  ", None, "zzz", "ac", "ë É", "ck\\\\", "amina", "o%r", "n_"]
    rows = [(k, None, t) for k, t in enumerate(terms)] + [(100, " ub-4 ", "amina"), (101, "nobody", "amina"), (102, " ", "amina"), (103, "UB-3", None)]
    got = {r.term_key: (r.search_term, r.match_count, r.outcome) for r in search_outcomes(
        students, school["classes"], spark.createDataFrame(rows, schemas.SEARCH_TERMS)).collect()}
    here = [(f"UB-{i}", n) for i, n in enumerate(names) if i != 3]
    for key, number, term in rows:
        number, term = (number or "").strip(), (term or "").strip()
        if number:
            n = sum(a.lower() == number.lower() for a, _ in here)
            assert got[key] == (number, n, "found" if n else "not_found")
        else:
            n = sum(a.lower() == term.lower() or like(term, m) for a, m in here) if term else 0
            assert got[key] == (term, n, ("none", "one", "many")[min(n, 2)]), term


def test_search_has_no_nested_loops(spark, school):
    terms = spark.createDataFrame([(1, None, "ami"), (2, "UB-1", None), (3, None, "%")], schemas.SEARCH_TERMS)
    plan = search_outcomes(school["students"], school["classes"], terms)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_staged_keeps_schema_and_rows(spark, school):
    out = staged(school["payments"])
    assert out.schema.simpleString() == school["payments"].schema.simpleString()
    assert out.exceptAll(school["payments"]).count() == 0 == school["payments"].exceptAll(out).count()
