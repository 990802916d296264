from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tests.shop import T0, Shop, rows
from tillroll.plans import audits, quality
from tillroll.schema import TABLES


def _clean():
    shop = Shop().seller("s1").product("x1", "toys").translate("toys", "toys")
    shop.row("geolocation", "01001", Decimal("1.000000"), Decimal("2.000000"), "sao paulo", "SP")
    shop.order("a").item("a").review("a", 5)
    return shop.row("order_payments", "a", 1, "voucher", 1, Decimal("10.00"))


def _found(df):
    """Rows of an audit that report a violation, without the key columns' names."""
    return [r for r in rows(df) if any(isinstance(v, int) and v for v in r)]


KEY_AUDITS = [audits.primary_keys, audits.unique_columns, audits.foreign_keys]
COLUMN_AUDITS = [audits.required_values, audits.value_domains, audits.text_lengths]


def test_clean_data_passes(spark):
    tables = _clean().tables(spark)
    for audit in KEY_AUDITS + COLUMN_AUDITS + [audits.known_anomalies]:
        assert _found(audit(tables)) == []


def test_every_declared_rule_is_checked(spark):
    tables = _clean().tables(spark)
    assert audits.primary_keys(tables).count() == len(TABLES) == 9
    assert audits.foreign_keys(tables).count() == 6
    assert audits.required_values(tables).count() == sum(len(t.not_null) for t in TABLES.values())
    assert audits.text_lengths(tables).count() == sum(len(t.max_length) for t in TABLES.values())


@pytest.mark.parametrize(
    "audit,break_it,expected",
    [
        (audits.primary_keys, lambda s: s.seller("s1").seller("s1"), [("sellers", "seller_id", 1, 3)]),
        (audits.primary_keys,
         lambda s: s.row("order_items", "a", 1, "x1", "s1", T0, Decimal(1), Decimal(1)),
         [("order_items", "order_id, order_item_id", 1, 2)]),
        (audits.unique_columns,
         lambda s: s.row("orders", "b", "c-a", "delivered", T0, None, None, None, T0),
         [("orders", "customer_id", 1, 2)]),
        (audits.foreign_keys, lambda s: s.item("a", product="gone").item("a", product="gone"),
         [("order_items", "product_id -> products", 1, 2)]),
        (audits.foreign_keys, lambda s: s.review("lost", 3), [("order_reviews", "order_id -> orders", 1, 1)]),
        (audits.required_values, lambda s: s.row("sellers", "s2", None, "x", "SP"),
         [("sellers", "seller_zip_code_prefix", 1)]),
        (audits.value_domains, lambda s: s.review("a", 6).review("a", 0),
         [("order_reviews", "review_score", 2)]),
        (audits.text_lengths, lambda s: s.seller("s2", state="SPX"), [("sellers", "seller_state", 1)]),
        (audits.text_lengths, lambda s: s.translate("x" * 61, "y"),
         [("category_translation", "product_category_name", 1)]),
    ],
)
def test_each_rule_reports_its_violation(spark, audit, break_it, expected):
    assert _found(audit(break_it(_clean()).tables(spark))) == expected


def test_known_anomalies(spark):
    shop = _clean().product("x2").product("x3", "pc_gamer").review("a", 4)
    shop.row("order_reviews", "r0", "b", 3, None, None, T0, T0)
    shop.row("sellers", "s2", "99999", "x", "SP")
    assert rows(audits.known_anomalies(shop.tables(spark))) == [
        ("categories without a translation", 1),
        ("orders with more than one review", 1),
        ("products without a category", 1),
        ("surplus rows of repeated review ids", 1),
        ("zip prefixes without a point", 1),
    ]


def test_first_look(spark):
    shop = _clean().order("b", ts=datetime(2015, 1, 1), status="shipped").order("c")
    shop.review("a", 1).review("b", 1)
    tables = shop.tables(spark)
    assert rows(quality.date_range(tables)) == [(datetime(2015, 1, 1), datetime(2017, 5, 10, 12))]
    assert rows(quality.status_share(tables)) == [
        ("delivered", 2, Decimal("66.67")), ("shipped", 1, Decimal("33.33"))]
    assert rows(quality.score_distribution(tables)) == [
        (1, 2, Decimal("66.67")), (5, 1, Decimal("33.33"))]
    counts = dict(rows(quality.row_counts(tables)))
    assert (counts["orders"], counts["order_reviews"], counts["geolocation"]) == (3, 3, 1)
