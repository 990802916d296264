"""Revenue over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.operators.grains import order_totals
from tillroll.scope import Scope
from tillroll.tables import RetailTables


def revenue_by_month(tables: RetailTables, scope: Scope) -> DataFrame:
    """Orders and revenue of each month, in no order."""
    orders = scope.apply(tables.orders).select(
        "order_id", m.month_of(F.col("order_purchase_timestamp")).alias("month")
    )
    return (
        orders.join(order_totals(tables.near("order_items", scope)), "order_id")
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            m.money(F.sum("revenue_cents")).alias("revenue"),
        )
    )


def monthly_revenue(tables: RetailTables, scope: Scope) -> DataFrame:
    return revenue_by_month(tables, scope).orderBy("month")


def growth(monthly: DataFrame) -> DataFrame:
    """Month-on-month and year-on-year change and a three-row mean of (month, orders, revenue).

    Neighbours are rows, not calendar months. The windows are unpartitioned:
    there is one row per month of the scope.
    """
    by_month = Window.orderBy("month")
    revenue = F.col("revenue")
    last_month, last_year = F.lag("revenue", 1).over(by_month), F.lag("revenue", 12).over(by_month)
    return monthly.select(
        "month",
        "orders",
        F.round(revenue, 2).alias("revenue"),
        F.round(last_month, 2).alias("prev_month_revenue"),
        m.pct(revenue - last_month, last_month, 1).alias("mom_growth_pct"),
        F.round(F.avg("revenue").over(by_month.rowsBetween(-2, 0)), 2).alias("rolling_3m_avg"),
        m.pct(revenue - last_year, last_year, 1).alias("yoy_growth_pct"),
    ).orderBy("month")


def revenue_growth(tables: RetailTables, scope: Scope) -> DataFrame:
    return growth(revenue_by_month(tables, scope))
