"""Facts brought to one row per order (or seller and order) before any join.

Joining raw items or reviews to orders would repeat orders, so each fact table is
aggregated first. The aggregation runs on the join key, so it shares the join's
shuffle, and its map-side half collapses a hot order before any row moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.scope import Scope
from tillroll.tables import RetailTables

SCORE = "decimal(20,14)"


def order_totals(order_items: DataFrame) -> DataFrame:
    """Lines and money, in cents, per order."""
    return (
        order_items.groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(m.cents(F.col("price"))).alias("product_cents"),
            F.sum(m.cents(F.col("freight_value"))).alias("freight_cents"),
        )
        .withColumn("revenue_cents", F.col("product_cents") + F.col("freight_cents"))
    )


def order_scores(order_reviews: DataFrame) -> DataFrame:
    """Mean review score per order, from integer sums so that it is exact."""
    sums = order_reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("_sum"), F.count("review_score").alias("_n")
    )
    mean = F.try_divide(F.col("_sum").cast("decimal(18,0)"), F.col("_n").cast("decimal(18,0)"))
    return sums.select("order_id", mean.cast(SCORE).alias("review_score"))


def delivered_on_record(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_delivered_customer_date").isNotNull())


def with_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Add the person behind each order's customer record.

    Both sides have one row per order; neither is ever small, so no hint."""
    return orders.join(
        customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id"
    )


def order_states(tables: RetailTables, scope: Scope) -> DataFrame:
    orders = scope.apply(tables.orders).select("order_id", "customer_id")
    return with_person(orders, tables.customers).select("order_id", "customer_state")


def seller_orders(tables: RetailTables, scope: Scope) -> DataFrame:
    """One row per seller and in-scope order.

    The semi-join leaves rows partitioned by order_id, which already groups
    (seller, order) pairs: the aggregate adds no shuffle.
    """
    in_scope = scope.apply(tables.orders).select("order_id")
    return (
        tables.near("order_items", scope).join(in_scope, "order_id", "left_semi")
        .groupBy("order_id", "seller_id")
        .agg(F.sum(m.cents(m.revenue())).alias("revenue_cents"))
    )


def product_categories(tables: RetailTables) -> DataFrame:
    return (
        tables.products.select("product_id", "product_category_name")
        .join(tables.category_translation, "product_category_name", "left")
        .select("product_id", m.category_label().alias("category"))
    )
