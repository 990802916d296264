from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tests.shop import Shop, rows
from tillroll.plans import delivery, semantic
from tillroll.scope import Scope


def _shop():
    shop = Shop()
    for order_id, delay, scores in [
        ("a", -1, [5, 4]),     # early, mean 4.5
        ("b", 0, [2, 3]),      # on time, mean 2.5: not a 1-2 star order
        ("c", 3, [2]),
        ("d", 4, [1]),
        ("e", 8, [1, 2]),      # mean 1.5
        ("f", 9, []),          # no review: not in the buckets
        ("g", None, [5]),      # no delivery date
    ]:
        shop.order(order_id, delay=delay).item(order_id)
        for score in scores:
            shop.review(order_id, score)
    return shop


def test_buckets(spark):
    got = rows(delivery.delay_buckets(_shop().tables(spark), Scope()))
    assert got == [
        ("1. Early", 1, Decimal("20.00"), Decimal("4.50"), Decimal("0.0")),
        ("2. On time", 1, Decimal("20.00"), Decimal("2.50"), Decimal("0.0")),
        ("3. 1-3 days late", 1, Decimal("20.00"), Decimal("2.00"), Decimal("100.0")),
        ("4. 4-7 days late", 1, Decimal("20.00"), Decimal("1.00"), Decimal("100.0")),
        ("5. 8+ days late", 1, Decimal("20.00"), Decimal("1.50"), Decimal("100.0")),
    ]


def test_correlation_ignores_unreviewed(spark):
    (value,) = rows(delivery.delay_score_correlation(_shop().tables(spark), Scope()))[0]
    assert -1 <= value < -0.7


def test_late_rate_keeps_unreviewed_but_needs_a_date(spark):
    got = rows(delivery.late_rate_by_quarter(_shop().tables(spark), Scope()))
    assert got == [(date(2017, 4, 1), 6, Decimal("66.7"))]


def test_orders_view_keeps_every_order_with_items(spark):
    shop = _shop().order("noitems")
    shop.order("h", ts=datetime(2017, 6, 1), delay=2).item("h", price="1.00", freight="0.25")
    shop.item("h", price="2.00", freight="0.50")
    view = {r.order_id: r for r in semantic.orders_view(shop.tables(spark), Scope()).collect()}
    assert set(view) == set("abcdefgh")
    assert (view["g"].delay_days, view["g"].delay_bucket) == (None, None)
    assert (view["f"].delay_bucket, view["f"].review_score) == ("5. 8+ days late", None)
    h = view["h"]
    assert (h.items, h.product_value, h.freight_value, h.revenue) == (
        2, Decimal("3.00"), Decimal("0.75"), Decimal("3.75"))
    assert (h.purchase_date, h.order_month) == (date(2017, 6, 1), date(2017, 6, 1))
