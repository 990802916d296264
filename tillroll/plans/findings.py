"""Headline figures built on the other plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.plans import region, sellers, trend
from tillroll.plans.semantic import cohort_retention_view
from tillroll.scope import Scope
from tillroll.tables import RetailTables


def ytd_growth_of(monthly: DataFrame, scope: Scope) -> DataFrame:
    """Revenue of the scope's last calendar year against the same months a year before.

    `monthly` has one row per month. The months are those of the last year that
    lie before the scope's end.
    """
    this_year = scope.end.year if scope.end.month > 1 else scope.end.year - 1
    months = scope.end.month - 1 or 12
    year, month = F.year("month"), F.month("month")
    in_months = month <= months
    totals = monthly.agg(
        F.sum(F.when(in_months & (year == this_year), F.col("revenue"))).alias("revenue_this_year"),
        F.sum(F.when(in_months & (year == this_year - 1), F.col("revenue"))).alias(
            "revenue_last_year"
        ),
    )
    change = F.col("revenue_this_year") - F.col("revenue_last_year")
    return totals.withColumn("ytd_growth_pct", m.pct(change, F.col("revenue_last_year"), 1))


def ytd_growth(tables: RetailTables, scope: Scope) -> DataFrame:
    return ytd_growth_of(trend.revenue_by_month(tables, scope), scope)


def top_list_overlap(
    tables: RetailTables, scope: Scope, min_reviewed: int = 30, top_n: int = 20
) -> DataFrame:
    """How many of the top sellers by revenue are also top by rating."""
    in_both = (F.col("revenue_rank") <= top_n) & (F.col("rating_rank") <= top_n)
    return sellers.ranked_sellers(tables, scope, min_reviewed).agg(
        F.count_if(in_both).alias("in_both_lists")
    )


def leading_category_states(tables: RetailTables, scope: Scope) -> DataFrame:
    """In how many states each category comes first."""
    return (
        region.top_categories_by_state(tables, scope, k=1)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("states_led"))
        .orderBy(F.desc("states_led"), "category")
    )


def mean_month1_retention(tables: RetailTables, scope: Scope) -> DataFrame:
    """Plain mean over cohorts of the exact month-1 retention; weighting by size as well."""
    exact = F.col("active_customers") * F.lit(100.0) / F.col("cohort_size")
    month1 = cohort_retention_view(tables, scope, horizon=1).filter(F.col("month_number") == 1)
    return month1.agg(
        F.round(F.avg(exact), 2).alias("mean_retention_pct"),
        m.pct(F.sum("active_customers"), F.sum("cohort_size"), 2).alias("pooled_retention_pct"),
    )


def top_state_share(tables: RetailTables, scope: Scope, top_n: int = 3) -> DataFrame:
    """Leading states with their cumulative share of revenue (one row per state before)."""
    best_first = Window.orderBy(F.desc("revenue"), "customer_state")
    running = F.sum("revenue").over(best_first.rowsBetween(Window.unboundedPreceding, 0))
    return (
        region.revenue_by_state(tables, scope)
        .select(
            F.row_number().over(best_first).alias("state_rank"),
            "customer_state",
            "revenue",
            m.pct(running, F.sum("revenue").over(Window.partitionBy()), 2).alias("cumulative_pct"),
        )
        .filter(F.col("state_rank") <= top_n)
        .orderBy("state_rank")
    )
