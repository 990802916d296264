"""Sellers by revenue and by rating."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.operators.grains import SCORE, order_scores, seller_orders
from tillroll.operators.ranking import add_ranks, running_totals
from tillroll.scope import Scope
from tillroll.tables import RetailTables


def _rating_units() -> Column:
    """The exact rating as an integer, for whole-table ranks order 64-bit keys."""
    return (F.col("avg_rating") * F.lit(10**14)).cast("bigint")


def top_sellers(tables: RetailTables, scope: Scope, top_n: int = 20) -> DataFrame:
    """The best known sellers with their share and cumulative share of all their revenue.

    Everything that outranks a top seller is a top seller, so ranks and running
    sums over the top rows equal those over the whole table. The grand total is
    one more row, from the same per-seller sums.
    """
    per_seller = (
        seller_orders(tables, scope)
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue_cents").alias("revenue_cents"))
        .join(tables.sellers.select("seller_id", "seller_state"), "seller_id")
        .withColumn("_is_total", F.lit(0))
    )
    total = per_seller.agg(F.sum("revenue_cents").alias("revenue_cents")).withColumn(
        "_is_total", F.lit(1)
    )
    best = per_seller.orderBy(F.desc("revenue_cents"), "seller_id").limit(top_n)
    revenue = F.col("revenue_cents")
    best_first = Window.orderBy("_is_total", F.desc("revenue_cents"), "seller_id")
    by_value = Window.orderBy("_is_total", F.desc("revenue_cents"))
    grand_total = F.max(F.when(F.col("_is_total") == 1, revenue)).over(Window.partitionBy())
    running = F.sum(revenue).over(best_first.rowsBetween(Window.unboundedPreceding, 0))
    return (
        best.unionByName(total, allowMissingColumns=True)
        .select(
            "_is_total",
            F.rank().over(by_value).cast("bigint").alias("revenue_rank"),
            "seller_id",
            "seller_state",
            "orders",
            m.money(revenue).alias("revenue"),
            m.pct(revenue, grand_total, 2).alias("pct_of_revenue"),
            m.pct(running, grand_total, 2).alias("cumulative_pct"),
        )
        .filter(F.col("_is_total") == 0)
        .drop("_is_total")
        .orderBy("revenue_rank", "seller_id")
    )


def pareto(tables: RetailTables, scope: Scope, share: Decimal = Decimal("0.80")) -> DataFrame:
    """How many sellers, best first, stay within `share` of all revenue.

    The seller that crosses the line is not counted. Among sellers of equal
    revenue any order gives the same count, so it is worked out per distinct
    revenue: with A earned above it and room for `share * total - A` more, that
    many whole sellers fit.
    """
    per_seller = (
        seller_orders(tables, scope)
        .groupBy("seller_id")
        .agg(F.sum("revenue_cents").alias("cents"))
    )
    distinct = (
        per_seller.groupBy("cents")
        .agg(F.count(F.lit(1)).alias("sellers"))
        .withColumn("earned", F.col("cents") * F.col("sellers"))
    )
    totals = running_totals(distinct, "cents", ["earned"])
    room = (
        F.floor(F.col("total_earned").cast("decimal(20,0)") * F.lit(share)).cast("bigint")
        - F.col("above_earned")
    )
    fitting = (
        F.when(room < 0, F.lit(0))
        .when(F.col("cents") == 0, F.col("sellers"))
        .otherwise(F.least(F.col("sellers"), F.call_function("div", room, F.col("cents"))))
    )
    return totals.agg(
        F.sum("sellers").alias("total_sellers"), F.sum(fitting).alias("sellers_for_80pct")
    ).withColumn(
        "pct_of_sellers", m.pct(F.col("sellers_for_80pct"), F.col("total_sellers"), 1)
    )


def seller_stats(tables: RetailTables, scope: Scope) -> DataFrame:
    """Orders, revenue, reviewed orders and mean order score per seller.

    A review belongs to an order; each seller in the order gets its score.
    """
    return (
        seller_orders(tables, scope)
        .join(order_scores(tables.near("order_reviews", scope)), "order_id", "left")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue_cents").alias("revenue_cents"),
            F.count("review_score").alias("reviewed_orders"),
            F.avg("review_score").cast(SCORE).alias("avg_rating"),
        )
    )


def with_ranks(qualified: DataFrame) -> DataFrame:
    """Sellers ranked among themselves by revenue and by rating, on exact values."""
    return add_ranks(
        qualified,
        {"revenue_rank": F.col("revenue_cents"), "rating_rank": _rating_units()},
        total="qualified_sellers",
    )


def ranked_sellers(tables: RetailTables, scope: Scope, min_reviewed: int = 30) -> DataFrame:
    """All sellers with enough reviewed orders, ranked."""
    return with_ranks(seller_stats(tables, scope).filter(F.col("reviewed_orders") >= min_reviewed))


def sellers_by_rating(
    tables: RetailTables,
    scope: Scope,
    min_reviewed: int = 30,
    top_n: int = 20,
    rank_by: str = "revenue_rank",
) -> DataFrame:
    """The leading sellers by `rank_by` (or "rating_rank"); ties at the end all stay."""
    return (
        ranked_sellers(tables, scope, min_reviewed)
        .filter(F.col(rank_by) <= top_n)
        .select(
            "seller_id",
            m.money(F.col("revenue_cents")).alias("revenue"),
            "reviewed_orders",
            F.round("avg_rating", 2).alias("avg_rating"),
            "revenue_rank",
            "rating_rank",
            "qualified_sellers",
        )
        .orderBy(rank_by, "seller_id")
    )
