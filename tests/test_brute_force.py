"""Random small shops, a third of everything on one key, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from statistics import median

import pytest

from tests.shop import Shop, rows
from tillroll.plans import delivery, region, retention, sellers
from tillroll.scope import Scope

START, END = datetime(2017, 1, 1), datetime(2018, 9, 1)


def pct(part, whole, digits):
    return rounded(Fraction(100 * part) / whole, digits)


def rounded(value, digits):
    value = Fraction(value)
    exact = Decimal(value.numerator) / Decimal(value.denominator)
    return exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


@pytest.fixture(scope="module", params=[1, 2])
def shop(request):
    rng = random.Random(request.param)

    def pick(hot, others):
        return hot if rng.random() < 1 / 3 else rng.choice(others)

    s = Shop()
    for i in range(6):
        s.seller(f"s{i}").product(f"x{i}", rng.choice([None, "toys", "books"]))
    s.translate("toys", "toys!")
    for i in range(150):
        order = f"o{i:03}"
        day = START - timedelta(days=60) + timedelta(days=rng.randrange(730), hours=rng.randrange(24))
        s.order(
            order, pick("hot", [f"p{k}" for k in range(60)]), day,
            rng.choice(["delivered"] * 4 + ["shipped"]),
            rng.choice([None, -9, -1, 0, 1, 3, 4, 7, 8]), pick("SP", ["RJ", "MG"]),
        )
        for _ in range(rng.randrange(4)):
            s.item(order, pick("s0", [f"s{k}" for k in range(6)]), pick("x0", [f"x{k}" for k in range(6)]),
                   rng.choice(["5.00", "10.00", "19.99"]), rng.choice(["0.00", "1.01"]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            s.review(order, rng.randrange(1, 6))
    return s


@pytest.fixture
def tables(spark, shop):
    return shop.tables(spark)


def facts(shop):
    """In-scope orders as dicts, all delivered orders per person, items and scores per order."""
    person = {c[0]: (c[1], c[4]) for c in shop.rows["customers"]}
    orders, history = [], defaultdict(list)
    for order, record, status, ts, _, _, done, promised in shop.rows["orders"]:
        if status != "delivered":
            continue
        who, state = person[record]
        history[who].append(ts)
        if START <= ts < END:
            delay = None if done is None else (done.date() - promised.date()).days
            orders.append(dict(id=order, who=who, state=state, ts=ts, delay=delay))
    items, scores = defaultdict(list), defaultdict(list)
    for row in shop.rows["order_items"]:
        items[row[0]].append(row)
    for row in shop.rows["order_reviews"]:
        scores[row[1]].append(row[2])
    return orders, history, items, {k: Fraction(sum(v), len(v)) for k, v in scores.items()}


def by_person(orders):
    people = defaultdict(list)
    for o in sorted(orders, key=lambda o: (o["ts"], o["id"])):
        people[o["who"]].append(o)
    return people


def test_repeat_rate(shop, tables):
    people = by_person(facts(shop)[0])
    n, total = len(people), sum(map(len, people.values()))
    again = sum(len(v) > 1 for v in people.values())
    strict = sum(len({o["ts"].date() for o in v}) > 1 for v in people.values())
    assert rows(retention.repeat_rate(tables, Scope())) == [
        (n, again, pct(again, n, 2), strict, pct(strict, n, 2), rounded(Fraction(total, n), 3))]


def test_second_order_gap(shop, tables):
    gaps = [(v[1]["ts"].date() - v[0]["ts"].date()).days
            for v in by_person(facts(shop)[0]).values() if len(v) > 1]
    n = len(gaps)
    assert rows(retention.second_order_gap(tables, Scope())) == [
        (n, rounded(Fraction(sum(gaps), n), 1), median(gaps),
         pct(gaps.count(0), n, 1), pct(sum(g <= 30 for g in gaps), n, 1))]


def test_late_first_orders(shop, tables):
    people = by_person([o for o in facts(shop)[0] if o["delay"] is not None])
    want = []
    for cutoff in (END, datetime(2018, 3, 1)):
        cells = defaultdict(list)
        for v in people.values():
            if v[0]["ts"] < cutoff:
                cells[v[0]["delay"] > 0].append(len(v) > 1)
        want.append((len(cells[False]), pct(sum(cells[False]), len(cells[False]), 2),
                     len(cells[True]), pct(sum(cells[True]), len(cells[True]), 2)))
    got = rows(retention.late_first_order_test(tables, Scope()))
    assert [r[1:5] for r in got] == want


def test_cohorts(shop, tables):
    active = defaultdict(set)
    for who, times in facts(shop)[1].items():
        months = {t.year * 12 + t.month for t in times}
        first = min(months)
        if START.year * 12 + START.month <= first < END.year * 12 + END.month:
            for month in months:
                active[first, month - first].add(who)
    got = {
        (r.cohort_month.year * 12 + r.cohort_month.month, r.month_number):
            (r.active_customers, r.cohort_size)
        for r in retention.cohort_long(tables, Scope()).collect()
    }
    assert got == {(c, k): (len(v), len(active[c, 0])) for (c, k), v in active.items()}


def test_buckets(shop, tables):
    orders, _, _, scores = facts(shop)
    buckets = defaultdict(list)
    for o in orders:
        if o["delay"] is not None and o["id"] in scores:
            d = o["delay"]
            index = 1 + (d >= 0) + (d >= 1) + (d >= 4) + (d >= 8)
            buckets[index].append(scores[o["id"]])
    n = sum(map(len, buckets.values()))
    want = [
        (str(b), len(v), pct(len(v), n, 2), rounded(sum(v) / len(v), 2),
         pct(sum(x <= 2 for x in v), len(v), 1))
        for b, v in sorted(buckets.items())
    ]
    got = rows(delivery.delay_buckets(tables, Scope()))
    assert [(r[0][0], *r[1:]) for r in got] == want


def _sellers(shop):
    orders, _, items, scores = facts(shop)
    earned, sold = defaultdict(Decimal), defaultdict(set)
    for o in orders:
        for line in items[o["id"]]:
            earned[line[3]] += line[5] + line[6]
            sold[line[3]].add(o["id"])
    return earned, sold, scores


def test_sellers(shop, tables):
    earned, sold, scores = _sellers(shop)
    total = sum(earned.values())
    best = sorted(earned, key=lambda s: (-earned[s], s))
    running, want, within = Decimal(0), [], 0
    for seller in best:
        running += earned[seller]
        within += running <= total * Decimal("0.80")
        want.append((1 + sum(e > earned[seller] for e in earned.values()), seller, len(sold[seller]),
                     earned[seller], pct(Fraction(earned[seller]), Fraction(total), 2),
                     pct(Fraction(running), Fraction(total), 2)))
    got = rows(sellers.top_sellers(tables, Scope(), top_n=4))
    assert [(r[0], r[1], *r[3:]) for r in got] == want[:4]
    assert rows(sellers.pareto(tables, Scope()))[0][:2] == (len(best), within)

    rated = {s: [scores[o] for o in sold[s] if o in scores] for s in sold}
    rating = {s: sum(v) / len(v) for s, v in rated.items() if len(v) >= 12}
    want = sorted(
        (s, earned[s], len(rated[s]), rounded(rating[s], 2),
         1 + sum(earned[t] > earned[s] for t in rating), 1 + sum(rating[t] > rating[s] for t in rating),
         len(rating))
        for s in rating
    )
    assert sorted(rows(sellers.sellers_by_rating(tables, Scope(), min_reviewed=12))) == want
    assert want


def test_state_grid(shop, tables):
    orders, _, items, _ = facts(shop)
    label = {p[0]: {"toys": "toys!", None: "unknown"}.get(p[1], p[1]) for p in shop.rows["products"]}
    money, ids = defaultdict(Decimal), defaultdict(set)
    for o in orders:
        for line in items[o["id"]]:
            cell = o["state"], label[line[2]]
            money[cell] += line[5] + line[6]
            ids[cell].add(o["id"])
    got = rows(region.state_category(tables, Scope()))
    assert sorted(got) == sorted((*cell, len(ids[cell]), money[cell]) for cell in money)
    top = rows(region.top_categories_by_state(tables, Scope(), k=2))
    for state, rank, category, revenue, share in top:
        mine = {c: v for (s, c), v in money.items() if s == state}
        assert rank == 1 + len({v for v in mine.values() if v > mine[category]})
        assert share == pct(Fraction(revenue), Fraction(sum(mine.values())), 1)
