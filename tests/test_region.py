from __future__ import annotations

from decimal import Decimal

from tests.shop import Shop, rows
from tillroll.plans import findings, quality, region, semantic
from tillroll.scope import Scope


def _shop():
    shop = Shop().seller("s1", "MG")
    shop.translate("brinquedos", "toys")
    shop.product("toy", "brinquedos").product("pc", "pc_gamer").product("misc")
    shop.order("a", state="SP").item("a", product="toy", price="9.00", freight="1.00")
    shop.item("a", product="toy", price="9.00", freight="1.00")
    shop.item("a", product="pc", price="10.00", freight="0.00")
    shop.order("b", state="RJ").item("b", product="misc", price="5.00", freight="5.00")
    shop.order("c", state="SP", status="shipped").item("c", product="toy")
    return shop


def test_labels_fall_back(spark):
    tables = _shop().tables(spark)
    assert rows(region.state_category(tables, Scope())) == [
        ("RJ", "unknown", 1, Decimal("10.00")),
        ("SP", "toys", 1, Decimal("20.00")),
        ("SP", "pc_gamer", 1, Decimal("10.00")),
    ]
    view = semantic.order_items_view(tables, Scope()).collect()
    assert sorted((r.category, r.seller_state, r.revenue) for r in view) == [
        ("pc_gamer", "MG", Decimal("10.00")),
        ("toys", "MG", Decimal("10.00")),
        ("toys", "MG", Decimal("10.00")),
        ("unknown", "MG", Decimal("10.00")),
    ]


def test_top_categories_have_no_scope(spark):
    assert rows(quality.top_categories(_shop().tables(spark), top_n=2)) == [
        ("toys", 3), ("pc_gamer", 1)]


def test_freight_is_per_line(spark):
    assert rows(region.state_revenue(_shop().tables(spark), Scope())) == [
        ("SP", 1, Decimal("30.00"), Decimal("75.00"), Decimal("0.67")),
        ("RJ", 1, Decimal("10.00"), Decimal("25.00"), Decimal("5.00")),
    ]
    assert rows(findings.top_state_share(_shop().tables(spark), Scope(), top_n=1)) == [
        (1, "SP", Decimal("30.00"), Decimal("75.00"))]


def test_ties_share_a_rank(spark):
    shop = Shop()
    shop.order("a")
    for name, price in [("w", "40.00"), ("x", "30.00"), ("y", "10.00"), ("z", "10.00"), ("q", "9.00")]:
        shop.product(name, name).item("a", product=name, price=price)
    got = rows(region.top_categories_by_state(shop.tables(spark), Scope()))
    assert [(r[1], r[2]) for r in got] == [(1, "w"), (2, "x"), (3, "y"), (3, "z")]
    assert rows(findings.leading_category_states(shop.tables(spark), Scope())) == [("w", 1)]
