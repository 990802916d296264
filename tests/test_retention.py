from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tests.shop import Shop, rows
from tillroll.operators.firsts import first_rows
from tillroll.plans import findings, retention, semantic
from tillroll.scope import Scope

JAN, FEB, MAR = date(2017, 1, 1), date(2017, 2, 1), date(2017, 3, 1)


def test_repeat_and_strict_repeat(spark):
    shop = Shop()
    shop.order("a1", "a", datetime(2017, 3, 1, 9)).order("a2", "a", datetime(2017, 3, 1, 21))
    shop.order("b1", "b", datetime(2017, 3, 1)).order("b2", "b", datetime(2017, 4, 1))
    shop.order("b3", "b", datetime(2017, 4, 1))
    shop.order("c1", "c")
    shop.order("d1", "d", datetime(2016, 12, 31)).order("d2", "d", datetime(2017, 1, 5))
    assert rows(retention.repeat_rate(shop.tables(spark), Scope())) == [
        (4, 2, Decimal("50.00"), 1, Decimal("25.00"), Decimal("1.750"))
    ]


def _cohorts():
    shop = Shop()
    shop.order("a1", "a", datetime(2017, 1, 5)).order("a2", "a", datetime(2017, 1, 9))
    shop.order("a3", "a", datetime(2017, 3, 9))
    shop.order("b1", "b", datetime(2017, 1, 31))
    # first order before the window: in no cohort of the window
    shop.order("c1", "c", datetime(2016, 12, 31)).order("c2", "c", datetime(2017, 1, 2))
    # last cohort month, and a return after the window
    shop.order("d1", "d", datetime(2018, 8, 2)).order("d2", "d", datetime(2018, 9, 2))
    # cancelled orders start no cohort
    shop.order("e1", "e", datetime(2017, 1, 1), status="canceled")
    shop.order("e2", "e", datetime(2017, 2, 1))
    return shop


def test_long_form_lists_active_months_only(spark):
    got = rows(retention.cohort_long(_cohorts().tables(spark), Scope()))
    hundred = Decimal("100.00")
    assert got == [
        (JAN, 0, 2, 2, hundred),
        (JAN, 2, 1, 2, Decimal("50.00")),
        (FEB, 0, 1, 1, hundred),
        (date(2018, 8, 1), 0, 1, 1, hundred),
        (date(2018, 8, 1), 1, 1, 1, hundred),
    ]


def test_long_form_can_stop_at_the_end_of_the_scope(spark):
    got = retention.cohort_long(_cohorts().tables(spark), Scope(), observable_only=True)
    assert [r[:2] for r in rows(got)][-1] == (date(2018, 8, 1), 0)


def test_matrix_shows_zero_or_null(spark):
    got = rows(retention.cohort_matrix(_cohorts().tables(spark), Scope(), horizon=3))
    zero = Decimal("0.00")
    assert got == [
        (JAN, 2, zero, Decimal("50.00"), zero),
        (FEB, 1, zero, zero, zero),
        (date(2018, 8, 1), 1, None, None, None),
    ]


def test_view_has_every_observable_pair(spark):
    view = semantic.cohort_retention_view(_cohorts().tables(spark), Scope())
    by_cohort = {}
    for r in view.collect():
        by_cohort.setdefault(r.cohort_month, {})[r.month_number] = (r.active_customers, r.cohort_size)
    assert sorted(by_cohort[JAN]) == list(range(13))
    assert by_cohort[JAN][1] == (0, 2) and by_cohort[JAN][2] == (1, 2)
    assert by_cohort[date(2018, 8, 1)] == {0: (1, 1)}


def test_mean_month1_retention(spark):
    shop = Shop()
    shop.order("a1", "a", datetime(2017, 1, 5)).order("a2", "a", datetime(2017, 2, 5))
    for i in range(3):
        shop.order(f"b{i}", f"b{i}", datetime(2017, 3, 5))
    assert rows(findings.mean_month1_retention(shop.tables(spark), Scope())) == [
        (Decimal("50.00"), Decimal("25.00"))
    ]


def test_second_order_gap(spark):
    shop = Shop()
    shop.order("a1", "a", datetime(2017, 3, 1, 9)).order("a2", "a", datetime(2017, 3, 1, 9))
    shop.order("b1", "b", datetime(2017, 3, 1, 23)).order("b2", "b", datetime(2017, 3, 31, 1))
    shop.order("b3", "b", datetime(2018, 3, 31, 1))
    shop.order("c1", "c", datetime(2017, 3, 1)).order("c2", "c", datetime(2017, 4, 1))
    shop.order("d1", "d")
    shop.order("e1", "e", datetime(2016, 12, 1)).order("e2", "e", datetime(2017, 1, 3))
    assert rows(retention.second_order_gap(shop.tables(spark), Scope())) == [
        (3, Decimal("20.3"), 30.0, Decimal("33.3"), Decimal("66.7"))
    ]


def test_median_is_interpolated(spark):
    shop = Shop()
    shop.order("a1", "a", datetime(2017, 3, 1)).order("a2", "a", datetime(2017, 3, 2))
    shop.order("b1", "b", datetime(2017, 3, 1)).order("b2", "b", datetime(2017, 3, 5))
    assert rows(retention.second_order_gap(shop.tables(spark), Scope()))[0][2] == 2.5


def test_late_first_orders(spark):
    shop = Shop()
    for i in range(4):  # late first orders, one of which returns
        shop.order(f"l{i}", f"l{i}", datetime(2017, 3, 1), delay=2)
    shop.order("l0-again", "l0", datetime(2017, 5, 1), delay=-1)
    for i in range(4):  # punctual first orders, two of which return
        shop.order(f"p{i}", f"p{i}", datetime(2017, 3, 1), delay=0)
    shop.order("p0-again", "p0", datetime(2017, 5, 1), delay=9)
    shop.order("p1-again", "p1", datetime(2018, 5, 1), delay=9)
    # a second order without a delivery date is no return, a late starter is in sample 1 only
    shop.order("p2-open", "p2", datetime(2017, 5, 1), delay=None)
    shop.order("q", "q", datetime(2018, 3, 1), delay=0)
    got = retention.late_first_order_test(shop.tables(spark), Scope()).collect()
    assert [tuple(r)[:5] for r in got] == [
        ("1. All first orders", 5, Decimal("40.00"), 4, Decimal("25.00")),
        ("2. First order before Mar 2018", 4, Decimal("50.00"), 4, Decimal("25.00")),
    ]
    assert (got[1].z_score, got[1].p_value) == (0.73, 0.465)


def test_no_late_first_orders(spark):
    got = rows(retention.late_first_order_test(Shop().order("a").tables(spark), Scope()))
    assert got[0] == ("1. All first orders", 1, Decimal("0.00"), 0, None, None, None)


def test_equal_timestamps_resolve_by_order_id(spark):
    shop = Shop().order("z", "a", delay=5).order("b", "a", delay=-5)
    got = rows(retention.late_first_order_test(shop.tables(spark), Scope()))
    assert got[0][1:4:2] == (1, 0)


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, v int")
    assert sorted(rows(first_rows(df, "k", ["v"], 2))) == [("a", 1, 1), ("a", 2, 2), ("b", 9, 1)]
