"""Categories and revenue by the customer's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.operators.grains import order_states, order_totals, product_categories
from tillroll.plans.shares import share_of_all
from tillroll.scope import Scope
from tillroll.tables import RetailTables


def _line_revenue(tables: RetailTables, scope: Scope) -> DataFrame:
    lines = tables.near("order_items", scope)
    return lines.select("order_id", "product_id", m.cents(m.revenue()).alias("cents"))


def state_category(tables: RetailTables, scope: Scope) -> DataFrame:
    """Orders and revenue for every state and category.

    An order counts once in each of its categories, so lines are first brought
    to one row per (order, category). Products are joined first: the join with
    orders then leaves the lines where that grouping needs them.
    """
    return (
        _line_revenue(tables, scope)
        .join(product_categories(tables), "product_id")
        .join(order_states(tables, scope), "order_id")
        .groupBy("customer_state", "category", "order_id")
        .agg(F.sum("cents").alias("cents"))
        .groupBy("customer_state", "category")
        .agg(F.count(F.lit(1)).alias("orders"), m.money(F.sum("cents")).alias("revenue"))
        .orderBy("customer_state", F.desc("revenue"), "category")
    )


def revenue_by_state(tables: RetailTables, scope: Scope) -> DataFrame:
    """Revenue, share and mean freight of each state, in no order."""
    return (
        order_totals(tables.near("order_items", scope))
        .join(order_states(tables, scope), "order_id")
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            m.money(F.sum("revenue_cents")).alias("revenue"),
            m.money(F.sum("freight_cents")).alias("_freight"),
            F.sum("items").alias("_lines"),
        )
        .select(
            "customer_state",
            "orders",
            "revenue",
            share_of_all("revenue").alias("pct_of_revenue"),
            F.round(m.ratio(F.col("_freight"), F.col("_lines")), 2).alias("avg_freight_per_item"),
        )
    )


def state_revenue(tables: RetailTables, scope: Scope) -> DataFrame:
    return revenue_by_state(tables, scope).orderBy(F.desc("revenue"), "customer_state")


def top_categories_by_state(tables: RetailTables, scope: Scope, k: int = 3) -> DataFrame:
    """The k leading categories of each state; equal revenues share a rank.

    Lines are summed per (state, product) before products are joined, so a
    best-seller enters that join as one row per state.
    """
    grid = (
        _line_revenue(tables, scope)
        .join(order_states(tables, scope), "order_id")
        .groupBy("customer_state", "product_id")
        .agg(F.sum("cents").alias("cents"))
        .join(product_categories(tables), "product_id")
        .groupBy("customer_state", "category")
        .agg(m.money(F.sum("cents")).alias("revenue"))
    )
    state = Window.partitionBy("customer_state")
    return (
        grid.select(
            "customer_state",
            F.dense_rank().over(state.orderBy(F.desc("revenue"))).alias("category_rank"),
            "category",
            F.round("revenue", 2).alias("revenue"),
            m.pct(F.col("revenue"), F.sum("revenue").over(state), 1).alias("pct_of_state_revenue"),
        )
        .filter(F.col("category_rank") <= k)
        .orderBy("customer_state", "category_rank", "category")
    )
