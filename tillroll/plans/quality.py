"""First look at the data; none of these questions is limited to a scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.grains import product_categories
from tillroll.plans.shares import counted, share_of_all
from tillroll.tables import RetailTables


def row_counts(tables: RetailTables) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(F.desc("row_count"), "table_name")


def date_range(tables: RetailTables) -> DataFrame:
    return tables.orders.agg(
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
    )


def status_share(tables: RetailTables) -> DataFrame:
    return (
        counted(tables.orders, "order_status", "orders")
        .withColumn("pct_of_orders", share_of_all("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )


def score_distribution(tables: RetailTables) -> DataFrame:
    return (
        counted(tables.order_reviews, "review_score", "reviews")
        .withColumn("pct_of_reviews", share_of_all("reviews"))
        .orderBy("review_score")
    )


def top_categories(tables: RetailTables, top_n: int = 10) -> DataFrame:
    """Lines are counted per product before the join, so a best-seller is one row in it."""
    return (
        counted(tables.order_items, "product_id", "lines")
        .join(product_categories(tables), "product_id")
        .groupBy("category")
        .agg(F.sum("lines").alias("items_sold"))
        .orderBy(F.desc("items_sold"), "category")
        .limit(top_n)
    )
