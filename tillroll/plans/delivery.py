"""Delivery delay and what it does to review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.operators.grains import delivered_on_record, order_scores
from tillroll.plans.shares import share_of_all
from tillroll.scope import Scope
from tillroll.tables import RetailTables


def _scored_delays(tables: RetailTables, scope: Scope) -> DataFrame:
    """One row per order that was delivered and reviewed."""
    orders = delivered_on_record(scope.apply(tables.orders))
    return orders.select("order_id", m.delay_days().alias("delay_days")).join(
        order_scores(tables.near("order_reviews", scope)), "order_id"
    )


def delay_buckets(tables: RetailTables, scope: Scope) -> DataFrame:
    low = (F.col("review_score") <= 2).cast("int")
    return (
        _scored_delays(tables, scope)
        .groupBy(m.delay_bucket(F.col("delay_days")).alias("delay_bucket"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(F.avg("review_score"), 2).alias("avg_review_score"),
            F.sum(low).alias("_low"),
        )
        .select(
            "delay_bucket",
            "orders",
            share_of_all("orders").alias("pct_of_orders"),
            "avg_review_score",
            m.pct(F.col("_low"), F.col("orders"), 1).alias("pct_1_2_star"),
        )
        .orderBy("delay_bucket")
    )


def delay_score_correlation(tables: RetailTables, scope: Scope) -> DataFrame:
    return _scored_delays(tables, scope).agg(
        F.round(F.corr(F.col("delay_days").cast("double"), F.col("review_score").cast("double")), 3)
        .alias("corr_delay_vs_score")
    )


def late_rate_by_quarter(tables: RetailTables, scope: Scope) -> DataFrame:
    return (
        delivered_on_record(scope.apply(tables.orders))
        .groupBy(m.quarter_of(F.col("order_purchase_timestamp")).alias("quarter"))
        .agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            F.sum((m.delay_days() > 0).cast("int")).alias("_late"),
        )
        .select(
            "quarter",
            "delivered_orders",
            m.pct(F.col("_late"), F.col("delivered_orders"), 1).alias("late_pct"),
        )
        .orderBy("quarter")
    )
