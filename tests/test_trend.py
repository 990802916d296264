from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tests.shop import Shop, rows
from tillroll.plans import findings, trend
from tillroll.scope import Scope

# A published month series (orders, revenue) and its growth figures.
SERIES = """
2017-01 750 127482.37 - 127482.37 -
2017-02 1653 271239.32 112.8 199360.85 -
2017-03 2546 414330.95 52.8 271017.55 -
2017-04 2303 390812.40 -5.7 358794.22 -
2017-05 3546 566851.40 45.0 457331.58 -
2017-06 3135 490050.37 -13.5 482571.39 -
2017-07 3872 566299.08 15.6 541066.95 -
2017-08 4193 645832.36 14.0 567393.94 -
2017-09 4150 701077.49 8.6 637736.31 -
2017-10 4478 751117.01 7.1 699342.29 -
2017-11 7289 1153364.20 53.6 868519.57 -
2017-12 5513 843078.29 -26.9 915853.17 -
2018-01 7069 1077887.46 27.9 1024776.65 745.5
2018-02 6555 966168.41 -10.4 962378.05 256.2
2018-03 7003 1120598.24 16.0 1054884.70 170.5
2018-04 6798 1132878.93 1.1 1073215.19 189.9
2018-05 6749 1128774.52 -0.4 1127417.23 99.1
2018-06 6099 1011978.29 -10.3 1091210.58 106.5
2018-07 6159 1027807.28 1.6 1056186.70 81.5
2018-08 6351 985491.64 -4.1 1008425.74 52.6
"""


def _series():
    for line in SERIES.split("\n"):
        if line:
            month, orders, revenue, mom, rolling, yoy = line.split()
            number = [None if x == "-" else Decimal(x) for x in (revenue, mom, rolling, yoy)]
            yield (date.fromisoformat(month + "-01"), int(orders), *number)


def _monthly(spark):
    return spark.createDataFrame(
        [r[:3] for r in _series()], "month date, orders bigint, revenue decimal(20,2)"
    )


def test_growth_of_published_series(spark):
    got = trend.growth(_monthly(spark)).collect()
    want = list(_series())
    assert [(r.month, r.orders, r.revenue, r.mom_growth_pct, r.rolling_3m_avg, r.yoy_growth_pct)
            for r in got] == want
    assert [r.prev_month_revenue for r in got] == [None] + [r[2] for r in want[:-1]]


def test_ytd_growth_of_published_series(spark):
    row = findings.ytd_growth_of(_monthly(spark), Scope()).first()
    assert row.ytd_growth_pct == Decimal("143.4")


def test_window_is_half_open_and_orders_count_once(spark):
    shop = Shop()
    shop.order("first", ts=datetime(2017, 1, 1)).item("first", price="1.00", freight="0.10")
    shop.order("last", ts=datetime(2018, 8, 31, 23, 59, 59, 999999))
    shop.item("last", price="2.00").item("last", price="3.00")
    shop.order("after", ts=datetime(2018, 9, 1)).item("after")
    shop.order("before", ts=datetime(2016, 12, 31, 23, 59)).item("before")
    shop.order("open", status="shipped").item("open")
    shop.order("empty", ts=datetime(2017, 2, 2))
    assert rows(trend.monthly_revenue(shop.tables(spark), Scope())) == [
        (date(2017, 1, 1), 1, Decimal("1.10")),
        (date(2018, 8, 1), 1, Decimal("5.00")),
    ]


def test_neighbours_are_rows_not_calendar_months(spark):
    df = spark.createDataFrame(
        [(date(2017, 1, 1), 1, Decimal(100)), (date(2017, 3, 1), 1, Decimal(150))],
        "month date, orders bigint, revenue decimal(20,2)",
    )
    assert trend.growth(df).collect()[1].mom_growth_pct == Decimal("50.0")


def test_growth_from_zero_is_null(spark):
    df = spark.createDataFrame(
        [(date(2017, 1, 1), 1, Decimal(0)), (date(2017, 2, 1), 1, Decimal(150))],
        "month date, orders bigint, revenue decimal(20,2)",
    )
    assert trend.growth(df).collect()[1].mom_growth_pct is None
