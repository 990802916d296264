"""Stored views brought up to date month by month."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

from tests.shop import Shop
from tillroll.plans import semantic
from tillroll.scope import Scope

SCOPE = Scope(date(2017, 1, 1), date(2018, 1, 1))


def shop(days=200, sellers=("s1", "s2")):
    s = Shop().product("x1", "toys").translate("toys", "toys!")
    for name in sellers:
        s.seller(name)
    for i in range(days):
        order = f"o{i}"
        s.order(order, f"p{i % 50}", datetime(2017, 1, 1) + timedelta(days=i), delay=i % 9 - 4)
        if i % 30:
            s.item(order, f"s{1 + i % 2}", price=f"{i}.10").review(order, 1 + i % 5)
    return s


def contents(spark, root):
    return {
        name: sorted(repr(sorted(r.asDict().items())) for r in spark.read.parquet(f"{root}/{name}").collect())
        for name in semantic.VIEWS
    }


def files_of(root, name):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in Path(root, name).rglob("*.parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    semantic.write_views(shop().tables(spark), SCOPE, str(tmp_path / "views"))
    return tmp_path / "views"


def check(spark, tmp_path, stored, changed_shop, months):
    """A refresh writes these months alone and equals a full rebuild."""
    before = {name: files_of(stored, name) for name in semantic.BY_MONTH}
    tables = changed_shop.tables(spark)
    written = semantic.refresh_views(tables, SCOPE, str(stored))
    assert written == months
    semantic.write_views(tables, SCOPE, str(tmp_path / "rebuilt"))
    assert contents(spark, stored) == contents(spark, tmp_path / "rebuilt")
    for name in semantic.BY_MONTH:
        after = files_of(stored, name)
        for path, time in before[name].items():
            if not any(f"{m:%Y-%m-%d}" in str(path) for m in months):
                assert after[path] == time
    assert semantic.refresh_views(tables, SCOPE, str(stored)) == []


def test_an_appended_month(spark, tmp_path, stored):
    check(spark, tmp_path, stored, shop(days=235), [date(2017, 7, 1), date(2017, 8, 1)])


def test_a_late_review_and_a_new_line(spark, tmp_path, stored):
    s = shop().review("o40", 1).item("o100", "s2", price="1.00")
    check(spark, tmp_path, stored, s, [date(2017, 2, 1), date(2017, 4, 1)])


def test_a_month_that_loses_its_orders_or_lines(spark, tmp_path, stored):
    s = shop()
    s.rows["orders"] = [r for r in s.rows["orders"] if r[3].month != 3]
    s.rows["order_items"] = [r for r in s.rows["order_items"] if not 120 <= int(r[0][1:]) < 151]
    check(spark, tmp_path, stored, s, [date(2017, 3, 1), date(2017, 5, 1)])


def test_new_sellers_write_everything(spark, tmp_path, stored):
    months = [date(2017, k, 1) for k in range(1, 8)]
    check(spark, tmp_path, stored, shop(sellers=("s1", "s2", "s3")), months)


def test_views_that_were_never_written(spark, tmp_path):
    months = semantic.refresh_views(shop().tables(spark), SCOPE, str(tmp_path / "views"))
    assert months == [date(2017, k, 1) for k in range(1, 8)]
    assert semantic.refresh_views(shop().tables(spark), SCOPE, str(tmp_path / "views")) == []
