"""Facts laid out by purchase month: which files a scope opens, and that results stay."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from tests.shop import Shop, rows
from tillroll.plans import delivery, findings, region, sellers, semantic, trend
from tillroll.schema import TABLES
from tillroll.scope import MONTH_COLUMN, Scope
from tillroll.sources import store


@pytest.fixture(scope="module")
def shop(spark):
    s = Shop().seller("s1").seller("s2").product("x1", "toys").translate("toys", "toys!")
    for i in range(400):
        order = f"o{i}"
        s.order(order, f"p{i % 90}", datetime(2017, 1, 1) + timedelta(days=2 * i), delay=i % 9 - 4)
        s.item(order, f"s{1 + i % 2}", price=f"{i}.10").review(order, 1 + i % 5)
        s.row("order_payments", order, 1, "card", 1, None)
    s.row("order_items", "no such order", 1, "x1", "s1", datetime(2017, 1, 1), None, None)
    return s.tables(spark)


@pytest.fixture(scope="module")
def by_month(spark, shop, tmp_path_factory):
    """Every month fills a folder."""
    return store.store_tables(spark, shop, str(tmp_path_factory.mktemp("months")), folder_bytes=1)


def opened(df) -> int:
    """Files that a scan of one table opens."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


FACTS = ["orders", "order_items", "order_payments", "order_reviews"]


@pytest.mark.parametrize("table", FACTS)
def test_one_month_opens_few_files(by_month, table):
    def near(*window):
        return by_month.near(table, Scope(*window))

    one = near(date(2018, 3, 1), date(2018, 4, 1))
    n = opened(one)
    assert 0 < n < opened(getattr(by_month, table)) / 10
    assert one.columns == TABLES[table].schema.names
    assert opened(near(date(2018, 3, 5), date(2018, 3, 20))) == n
    assert opened(near(date(2018, 3, 5), date(2018, 4, 2))) == 2 * n
    assert opened(near(date(2030, 1, 1), date(2031, 1, 1))) == 0


def test_plans_prune_orders_items_and_reviews(by_month):
    one = Scope(date(2018, 3, 1), date(2018, 4, 1))
    for plan, scans in ((sellers.seller_orders, 2), (sellers.seller_stats, 3), (delivery.delay_buckets, 2)):
        text = plan(by_month, one)._jdf.queryExecution().executedPlan().toString()
        assert text.count("PartitionFilters: [isnotnull(purchase_month") >= scans, plan


def test_small_months_share_files(spark, shop, tmp_path):
    whole = store.store_tables(spark, shop, str(tmp_path))
    for table in FACTS:
        stored = getattr(whole, table).inputFiles()
        folders = {f.split(f"{MONTH_COLUMN}=")[1].split("/")[0] for f in stored}
        assert store.MIN_FOLDERS - 2 <= len(folders - {"__HIVE_DEFAULT_PARTITION__"}) <= store.MIN_FOLDERS + 2
    months = store.month_folders(shop.orders, folder_bytes=1)
    assert len(months) == 27 and all(a == b for a, b in months)
    assert store.month_folders(shop.orders.limit(0)) == []


@pytest.mark.parametrize("scope", [
    Scope(), Scope(date(2018, 3, 5), date(2018, 4, 2)), Scope(date(2016, 1, 1), date(2017, 1, 1)),
])
def test_results_do_not_depend_on_the_layout(shop, by_month, scope):
    for plan in (
        trend.monthly_revenue, delivery.delay_buckets, sellers.top_sellers, sellers.pareto,
        region.state_category, region.state_revenue, semantic.orders_view,
        semantic.order_items_view, findings.leading_category_states,
    ):
        assert sorted(map(repr, rows(plan(by_month, scope)))) == sorted(map(repr, rows(plan(shop, scope))))


def test_every_row_is_stored(shop, by_month):
    for name, df in shop.items():
        stored = getattr(by_month, name).select(*TABLES[name].schema.names)
        assert sorted(map(repr, rows(stored))) == sorted(map(repr, rows(df)))
    assert {r.status for r in store.reconcile(dict(shop.items()), dict(by_month.items())).collect()} == {"OK"}


def test_appended_rows_lie_in_their_months(spark, shop, tmp_path):
    root = str(tmp_path)
    first = shop.orders.filter("order_purchase_timestamp < TIMESTAMP_NTZ '2018-03-10 00:00:00'")
    rest = shop.orders.join(first.select("order_id"), "order_id", "left_anti")
    ids = first.select("order_id")
    part = type(shop)(
        lambda name: first if name == "orders"
        else getattr(shop, name).join(ids, "order_id", "left_semi") if name in FACTS
        else getattr(shop, name)
    )
    store.store_tables(spark, part, root, folder_bytes=1)
    store.append_rows(spark, root, "orders", rest)
    for name in FACTS[1:]:
        later = getattr(shop, name).join(ids, "order_id", "left_anti")
        store.append_rows(spark, root, name, later)
    store.append_rows(spark, root, "sellers", shop.sellers.limit(0))
    tables = type(shop).read(spark, root)
    assert {r.status for r in store.reconcile(dict(shop.items()), dict(tables.items())).collect()} == {"OK"}
    for window in ((date(2018, 3, 1), date(2018, 4, 1)), (date(2018, 5, 2), date(2018, 6, 1))):
        scope = Scope(*window)
        assert 0 < opened(tables.near("order_items", scope)) < len(tables.order_items.inputFiles()) / 2
        assert rows(trend.monthly_revenue(tables, scope)) == rows(trend.monthly_revenue(shop, scope))
