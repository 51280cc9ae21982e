"""M15 against a brute-force sequential fold, including a hot item spread over many segments."""

from __future__ import annotations

import random
from decimal import Decimal as D

import numpy as np

from bursar.operators.stock_fold import apply_at, compose, fold_segment, issue_uniforms, transition
from bursar.sources import schemas

from tests.days import day


def brute(stock: dict[int, int], reqs: list[dict]) -> tuple[set[int], dict[int, int]]:
    left = dict(stock)
    ok = set()
    for r in sorted(reqs, key=lambda r: (r["date_issued"], r["request_id"], r["student_id"], r["quantity"])):
        u, q = r["uniform_id"], r["quantity"]
        if u not in left or q is None or q < 1 or q > left[u]:
            continue
        left[u] -= q
        ok.add(r["request_id"])
    return ok, left


def test_fold_segment_and_transition_agree_with_loop():
    rng = np.random.default_rng(7)
    for _ in range(200):
        q = rng.integers(1, 12, size=rng.integers(0, 40))
        start = int(rng.integers(-3, 60))
        acc, left = fold_segment(q, start)
        ref_left, ref = start, []
        for x in q:
            ok = 1 <= x <= ref_left
            ref.append(ok)
            ref_left -= x if ok else 0
        assert acc.tolist() == ref and left == ref_left
        dom = int(rng.integers(1, 30))
        f = transition(q, dom)
        assert [apply_at(f, s) for s in range(dom)] == [fold_segment(q, s)[1] for s in range(dom)]
        q2 = rng.integers(1, 12, size=rng.integers(0, 40))
        g = compose(f, transition(q2, dom), dom)
        assert [apply_at(g, s) for s in range(dom)] == \
            [fold_segment(q2, fold_segment(q, s)[1])[1] for s in range(dom)]


def test_skipped_request_then_smaller_fits(make):
    items = make("uniform_items", [{"uniform_id": 1, "item_name": "Sweater", "price": D("10"),
                                    "quantity_in_stock": 5}])
    reqs = make(schemas.ISSUE_REQUESTS, [
        {"request_id": 1, "student_id": 1, "uniform_id": 1, "quantity": 3, "date_issued": day("2024-01-01")},
        {"request_id": 2, "student_id": 2, "uniform_id": 1, "quantity": 4, "date_issued": day("2024-01-02")},
        {"request_id": 3, "student_id": 3, "uniform_id": 1, "quantity": 2, "date_issued": day("2024-01-03")},
        {"request_id": 4, "student_id": 4, "uniform_id": 1, "quantity": 0, "date_issued": day("2024-01-04")},
        {"request_id": 5, "student_id": 5, "uniform_id": 9, "quantity": 1, "date_issued": day("2024-01-04")},
    ])
    res = issue_uniforms(items, reqs, segments=2)
    assert sorted(r["issue_key"] for r in res.issued.collect()) == [1, 3]
    assert {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()} == {
        2: "insufficient_stock", 4: "invalid_quantity", 5: "unknown_item"}
    assert res.items.collect()[0]["quantity_in_stock"] == 0
    assert sorted(r["total_price"] for r in res.issued.collect()) == [D("20.00"), D("30.00")]


def test_hot_item_over_many_segments_matches_brute_force(make):
    rng = random.Random(11)
    stock = {1: 400, 2: 35, 3: 0, 4: -2, 5: 10_000}
    rows = []
    rid = 0
    for u, n in ((1, 1500), (2, 300), (3, 20), (4, 20), (5, 400)):  # item 1 holds most requests
        for _ in range(n):
            rid += 1
            rows.append({"request_id": rid, "student_id": None if rid % 97 == 0 else rng.randint(1, 50),
                         "uniform_id": u, "quantity": rng.choice([0, 1, 1, 2, 3, 5, 8, 13]),
                         "amount_paid": None if rid % 89 == 0 else D(f"{rid % 7}.{rid % 100:02d}"),
                         "date_issued": day(f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}")})
    items = make("uniform_items", [{"uniform_id": u, "item_name": f"I{u}", "price": D("2"),
                                    "quantity_in_stock": s} for u, s in stock.items()])
    reqs = make(schemas.ISSUE_REQUESTS, rows)
    want_ids, want_left = brute(stock, rows)
    # block 2 / 3 force multi-level composition of segment functions
    for nseg, block in ((1, 1024), (7, 1024), (40, 1024), (40, 2), (40, 3)):
        res = issue_uniforms(items, reqs, segments=nseg, block=block)
        issued = res.issued.collect()
        got = {r["issue_key"] for r in issued}
        assert got == want_ids, (nseg, block)
        by_id = {r["request_id"]: r for r in rows}
        for r in issued:  # carried columns come back exactly (money via cents, nulls kept)
            src = by_id[r["issue_key"]]
            assert (r["student_id"], r["amount_paid"], r["date_issued"], r["quantity"]) == \
                (src["student_id"], src["amount_paid"], src["date_issued"], src["quantity"])
            assert r["total_price"] == D("2.00") * src["quantity"]
        left = {r["uniform_id"]: r["quantity_in_stock"] for r in res.items.collect()}
        assert left == want_left
        assert res.issued.count() + res.rejects.count() == len(rows)
        issued_qty = {u: 0 for u in stock}
        for r in issued:
            issued_qty[r["uniform_id"]] += r["quantity"]
        assert all(issued_qty[u] + left[u] == stock[u] for u in stock)  # issued + left = opening


def test_missing_stock_counts_as_zero(make):
    items = make("uniform_items", [{"uniform_id": 1, "item_name": "Cap", "price": D("5"),
                                    "quantity_in_stock": None}])
    reqs = make(schemas.ISSUE_REQUESTS, [
        {"request_id": 1, "student_id": 1, "uniform_id": 1, "quantity": 1, "date_issued": day("2024-01-01")}])
    res = issue_uniforms(items, reqs, segments=1)
    assert res.issued.count() == 0
    assert [r["reject_reason"] for r in res.rejects.collect()] == ["insufficient_stock"]


def test_oversized_line_is_refused_alone(make):
    items = make("uniform_items", [{"uniform_id": 1, "item_name": "Gown", "price": D("9999999999.99"),
                                    "quantity_in_stock": 50}])
    reqs = make(schemas.ISSUE_REQUESTS, [
        {"request_id": k, "student_id": 1, "uniform_id": u, "quantity": q, "date_issued": day("2024-01-01")}
        for k, u, q in ((1, 1, 2), (2, 1, 1), (3, None, 1), (4, 1, None))])
    res = issue_uniforms(items, reqs, segments=3)
    assert [(r["issue_key"], r["total_price"]) for r in res.issued.collect()] == [(2, D("9999999999.99"))]
    assert {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()} == {
        1: "total_too_large", 3: "unknown_item", 4: "invalid_quantity"}
    assert res.items.collect()[0]["quantity_in_stock"] == 49


def test_new_version_of_the_issues_table(make):
    items = make("uniform_items", [{"uniform_id": 1, "item_name": "Cap", "price": D("5"), "quantity_in_stock": 9}])
    old = make("uniform_issues", [{"issue_key": 3, "student_id": 1, "uniform_id": 1, "quantity": 1}])
    reqs = make(schemas.ISSUE_REQUESTS, [
        {"request_id": k, "student_id": k, "uniform_id": 1, "quantity": q, "date_issued": day("2024-01-01")}
        for k, q in ((3, 2), (3, 4), (7, 5), (8, 3))])
    res = issue_uniforms(items, reqs, old, segments=2)
    rows = sorted((r["issue_key"], r["quantity"]) for r in res.table.collect())
    assert [k for k, _ in rows] == [3, 4, 5, 6] and sorted(q for _, q in rows[1:]) == [2, 3, 4]
    assert res.issued.count() + res.rejects.count() == 4
