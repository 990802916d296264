from __future__ import annotations

from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tests.shop import Shop, rows
from tillroll.plans import findings, sellers, semantic
from tillroll.scope import Scope
from tillroll.sources import store
from tillroll.tables import RetailTables


def _earning(amounts: dict[str, str]):
    shop = Shop()
    for seller, amount in amounts.items():
        shop.seller(seller).order(f"o-{seller}").item(f"o-{seller}", seller=seller, price=amount)
    return shop


def test_top_sellers_with_ties(spark):
    shop = _earning({"a": "50.00", "b": "20.00", "c": "20.00", "d": "10.00"})
    got = rows(sellers.top_sellers(shop.tables(spark), Scope(), top_n=3))
    assert got == [
        (1, "a", "SP", 1, Decimal("50.00"), Decimal("50.00"), Decimal("50.00")),
        (2, "b", "SP", 1, Decimal("20.00"), Decimal("20.00"), Decimal("70.00")),
        (2, "c", "SP", 1, Decimal("20.00"), Decimal("20.00"), Decimal("90.00")),
    ]


def test_orders_of_a_seller_count_once(spark):
    shop = Shop().seller("a").seller("b").order("o")
    shop.item("o", seller="a").item("o", seller="a").item("o", seller="b")
    got = rows(sellers.top_sellers(shop.tables(spark), Scope()))
    assert [(r[1], r[3], r[4]) for r in got] == [("a", 1, Decimal("20.00")), ("b", 1, Decimal("10.00"))]


@pytest.mark.parametrize(
    "amounts,expected",
    [
        (["50.00", "30.00", "20.00"], 2),           # exactly at the line counts
        (["50.00", "31.00", "19.00"], 1),           # the seller that crosses does not
        (["10.00"] * 10, 8),                        # equal sellers, cut inside the tie
        (["40.00", "15.00", "15.00", "15.00", "15.00"], 3),
        (["100.00", "0.00", "0.00"], 0),
        (["10.00"] * 7 + ["0.00"], 5),
    ],
)
def test_pareto(spark, amounts, expected):
    shop = _earning({f"s{i}": a for i, a in enumerate(amounts)})
    n, within, share = rows(sellers.pareto(shop.tables(spark), Scope()))[0]
    assert (n, within) == (len(amounts), expected)
    assert share == (Decimal(100 * expected) / len(amounts)).quantize(Decimal("0.1"))


def test_pareto_agrees_with_full_list(spark):
    shop = _earning({f"s{i:02}": f"{(i * 37) % 23 + 1}.00" for i in range(40)})
    tables = shop.tables(spark)
    full = sellers.top_sellers(tables, Scope(), top_n=1000)
    within = full.filter("cumulative_pct <= 80").count()
    assert rows(sellers.pareto(tables, Scope()))[0][:2] == (40, within)


def _rated():
    """Three sellers with 30, 30 and 29 reviewed orders, one more order unreviewed."""
    shop = Shop().seller("a").seller("b").seller("c")
    for seller, reviewed, score, price in [("a", 30, 4, "10.00"), ("b", 30, 5, "1.00"), ("c", 29, 5, "99.00")]:
        for i in range(reviewed):
            order = f"{seller}{i}"
            shop.order(order).item(order, seller=seller, price=price).review(order, score)
    shop.order("extra").item("extra", seller="a", price="7.00")
    return shop


def test_minimum_reviews_come_before_ranks(spark):
    got = rows(sellers.sellers_by_rating(_rated().tables(spark), Scope()))
    assert got == [
        ("a", Decimal("307.00"), 30, Decimal("4.00"), 1, 2, 2),
        ("b", Decimal("30.00"), 30, Decimal("5.00"), 2, 1, 2),
    ]
    by_rating = sellers.sellers_by_rating(_rated().tables(spark), Scope(), rank_by="rating_rank", top_n=1)
    assert [r[0] for r in rows(by_rating)] == ["b"]


def test_summary_counts_unreviewed_orders(spark):
    view = {r.seller_id: r for r in semantic.seller_summary_view(_rated().tables(spark), Scope()).collect()}
    assert set(view) == {"a", "b"}
    assert (view["a"].orders, view["a"].reviewed_orders) == (31, 30)


def test_every_seller_of_an_order_gets_its_score(spark):
    shop = Shop().seller("longer-than-eight").seller("b").order("o")
    shop.item("o", seller="longer-than-eight").item("o", seller="b").review("o", 2).review("o", 5)
    view = rows(semantic.seller_summary_view(shop.tables(spark), Scope(), min_reviewed=1))
    assert sorted((r[1], r[6], r[7], r[8]) for r in view) == [
        ("b", Decimal("3.50"), 1, 1), ("longer-t", Decimal("3.50"), 1, 1)]


def test_overlap(spark):
    tables = _rated().tables(spark)
    assert rows(findings.top_list_overlap(tables, Scope(), top_n=1)) == [(0,)]
    assert rows(findings.top_list_overlap(tables, Scope(), top_n=2)) == [(2,)]


def test_lists_of_known_sellers_have_no_gaps(spark):
    shop = _earning({"a": "50.00", "b": "20.00", "c": "15.00", "d": "10.00", "e": "5.00"})
    tables = shop.tables(spark)
    known = tables.sellers.filter("seller_id <> 'b'")
    without = RetailTables(lambda t: known if t == "sellers" else getattr(tables, t))
    got = rows(sellers.top_sellers(without, Scope(), top_n=3))
    assert [(r[0], r[1]) for r in got] == [(1, "a"), (2, "c"), (3, "d")]
    assert got[0][5] == Decimal("62.50")  # of 80, without the unknown seller
    view = semantic.seller_summary_view(without, Scope(), min_reviewed=0)
    assert sorted((r.revenue_rank, r.seller_id) for r in view.collect()) == [
        (1, "a"), (2, "c"), (3, "d"), (4, "e")]


def test_views_follow_the_tables(spark, tmp_path):
    tables = _earning({"a": "50.00", "b": "20.00"}).tables(spark)
    root = str(tmp_path)
    stored = store.store_tables(spark, tables, root)
    semantic.register_views(stored, Scope())
    sums = "SELECT sum(revenue) FROM vw_orders"
    assert rows(spark.sql(sums)) == [(Decimal("70.00"),)]
    seller_summary = semantic.seller_summary_view(stored, Scope(), min_reviewed=0)
    seller_summary.createOrReplaceTempView("vw_seller_summary")
    top = "SELECT seller_id, revenue FROM vw_seller_summary WHERE revenue_rank = 1"
    assert rows(spark.sql(top)) == [("a", Decimal("50.00"))]
    more = tables.order_items.filter("seller_id = 'b'").withColumn(
        "order_item_id", F.lit(2).cast("smallint")
    ).withColumn("price", F.lit(Decimal("90.00")).cast("decimal(10,2)"))
    store.append_rows(spark, root, "order_items", more)
    for view in ("vw_orders", "vw_seller_summary"):
        spark.sql(f"REFRESH TABLE {view}")
    assert rows(spark.sql(sums)) == [(Decimal("160.00"),)]
    assert rows(spark.sql(top)) == [("b", Decimal("110.00"))]
