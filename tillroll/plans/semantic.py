"""Reusable order, item, seller and cohort tables for dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.operators.grains import (
    order_scores,
    order_totals,
    product_categories,
    with_person,
)
from tillroll.plans.retention import cohort_counts
from tillroll.plans.sellers import seller_stats, with_ranks
from tillroll.scope import Scope
from tillroll.sources import files
from tillroll.tables import RetailTables


def orders_view(tables: RetailTables, scope: Scope) -> DataFrame:
    """One row per in-scope order that has items."""
    bought = F.col("order_purchase_timestamp")
    orders = with_person(scope.apply(tables.orders), tables.customers).select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        F.to_date(bought).alias("purchase_date"),
        m.month_of(bought).alias("order_month"),
        m.delay_days().alias("delay_days"),
    )
    return (
        orders.join(order_totals(tables.near("order_items", scope)), "order_id")
        .join(order_scores(tables.near("order_reviews", scope)), "order_id", "left")
        .select(
            "order_id",
            "customer_unique_id",
            "customer_state",
            "purchase_date",
            "order_month",
            "items",
            m.money(F.col("product_cents")).alias("product_value"),
            m.money(F.col("freight_cents")).alias("freight_value"),
            m.money(F.col("revenue_cents")).alias("revenue"),
            "delay_days",
            m.delay_bucket(F.col("delay_days")).alias("delay_bucket"),
            F.round("review_score", 2).alias("review_score"),
        )
    )


def order_items_view(tables: RetailTables, scope: Scope) -> DataFrame:
    """One row per in-scope item line."""
    in_scope = scope.apply(tables.orders).select("order_id")
    return (
        tables.near("order_items", scope).join(in_scope, "order_id", "left_semi")
        .join(tables.sellers.select("seller_id", "seller_state"), "seller_id")
        .join(product_categories(tables), "product_id")
        .select(
            "order_id",
            "order_item_id",
            "seller_id",
            "seller_state",
            "category",
            "price",
            "freight_value",
            m.revenue().alias("revenue"),
        )
    )


def seller_summary_view(
    tables: RetailTables, scope: Scope, min_reviewed: int = 30
) -> DataFrame:
    """Known sellers with enough reviewed orders, ranked among themselves."""
    qualified = (
        seller_stats(tables, scope)
        .filter(F.col("reviewed_orders") >= min_reviewed)
        .join(tables.sellers.select("seller_id", "seller_state"), "seller_id")
    )
    return with_ranks(qualified).select(
        "seller_id",
        F.substring("seller_id", 1, 8).alias("seller_short_id"),
        "seller_state",
        "orders",
        m.money(F.col("revenue_cents")).alias("revenue"),
        "reviewed_orders",
        F.round("avg_rating", 2).alias("avg_rating"),
        "revenue_rank",
        "rating_rank",
    )


def cohort_retention_view(tables: RetailTables, scope: Scope, horizon: int = 12) -> DataFrame:
    """Every observable (cohort, month) pair up to the horizon, zeros included."""
    return (
        cohort_counts(tables, scope, horizon)
        .select(
            "cohort_month",
            "cohort_size",
            F.posexplode("active").alias("month_number", "active_customers"),
        )
        .filter(scope.observable(F.col("cohort_month"), F.col("month_number")))
        .select(
            "cohort_month",
            "month_number",
            "active_customers",
            "cohort_size",
            m.pct(F.col("active_customers"), F.col("cohort_size"), 2).alias("retention_pct"),
        )
    )


VIEWS = {
    "vw_orders": orders_view,
    "vw_order_items": order_items_view,
    "vw_seller_summary": seller_summary_view,
    "vw_cohort_retention": cohort_retention_view,
}


def register_views(tables: RetailTables, scope: Scope, min_reviewed: int = 30) -> None:
    """Make the views queryable by name. `min_reviewed` is the sellers' least number of
    reviewed orders."""
    for name, build in VIEWS.items():
        more = {"min_reviewed": min_reviewed} if build is seller_summary_view else {}
        build(tables, scope, **more).createOrReplaceTempView(name)


# Views stored by month, so that a refresh replaces only some of their folders.
BY_MONTH = ("vw_orders", "vw_order_items")
MONTH = "order_month"
PRINTS = "vw_source_prints"


def _dated(name: str, tables: RetailTables, scope: Scope) -> DataFrame:
    """A view of single orders or lines with the month of the order."""
    df = VIEWS[name](tables, scope)
    if MONTH in df.columns:
        return df
    bought = m.month_of(F.col("order_purchase_timestamp")).alias(MONTH)
    return df.join(scope.apply(tables.orders).select("order_id", bought), "order_id")


def _write_by_month(df: DataFrame, path: str) -> None:
    """The rebalance hint gives even files per month: big months are split over several
    tasks, small ones share a task. Folders of months that `df` lacks stay as they are."""
    (
        df.hint("rebalance", MONTH)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def source_prints(tables: RetailTables, scope: Scope) -> DataFrame:
    """(order_month, print) for what the rows of each month are made of: orders, customers,
    lines and reviews; and one row without a month for sellers and product categories."""
    month = m.month_of(F.col("order_purchase_timestamp")).alias(MONTH)
    orders = with_person(scope.apply(tables.orders), tables.customers)

    def per_order(name: str) -> DataFrame:
        df = tables.near(name, scope)
        row = F.xxhash64(*df.columns).cast("decimal(20,0)")
        return df.groupBy("order_id").agg(F.sum(row).alias(f"_{name}"))

    children = ["order_items", "order_reviews"]
    whole = orders.select("order_id", month, F.xxhash64(*orders.columns).alias("_order"))
    for name in children:
        whole = whole.join(per_order(name), "order_id", "left")
    row = F.xxhash64("_order", *[f"_{name}" for name in children])
    months = whole.groupBy(MONTH).agg(F.sum(row.cast("decimal(20,0)")).alias("print"))
    for name, df in (("sellers", tables.sellers), ("categories", product_categories(tables))):
        row = F.xxhash64(F.lit(name), *df.columns).cast("decimal(20,0)")
        months = months.unionByName(
            df.agg(F.sum(row).alias("print")).withColumn(MONTH, F.lit(None).cast("date"))
        )
    return months.groupBy(MONTH).agg(F.sum("print").alias("print"))


def _write_rows(tables: RetailTables, window: Scope, root: str) -> None:
    for name in BY_MONTH:
        _write_by_month(_dated(name, tables, window), f"{root}/{name}")


def _write_rest(tables: RetailTables, scope: Scope, root: str, prints: DataFrame) -> None:
    """The views over all months, and last what all of them were made of."""
    for name, build in VIEWS.items():
        if name not in BY_MONTH:
            build(tables, scope).write.mode("overwrite").parquet(f"{root}/{name}")
    prints.write.mode("overwrite").parquet(f"{root}/{PRINTS}")


def write_views(tables: RetailTables, scope: Scope, root: str) -> None:
    """Store the views for many readers; orders and lines are laid out by month."""
    spark = tables.orders.sparkSession
    for name in (*BY_MONTH, PRINTS):
        files.remove(spark, f"{root}/{name}")
    _write_rows(tables, scope, root)
    _write_rest(tables, scope, root, source_prints(tables, scope).coalesce(1))


def refresh_views(tables: RetailTables, scope: Scope, root: str) -> list[date]:
    """Bring the stored views up to date, writing only the months whose sources have changed.

    Sources are read once for their prints; after that only the changed months, each in a
    scan of its own, which opens few files where tables are laid out by month. Changed
    sellers or categories, or views that a failed run has left without prints, mean writing
    everything. The prints are written last, so a refresh that fails is done again by the
    next one. Returns the months written or removed."""
    spark = tables.orders.sparkSession
    if not files.exists(spark, f"{root}/{PRINTS}/_SUCCESS"):
        write_views(tables, scope, root)
        return sorted(r[MONTH] for r in spark.read.parquet(f"{root}/{PRINTS}").collect() if r[MONTH])
    # one row for each month of the scope
    rows = source_prints(tables, scope).collect()
    new = {r[MONTH]: r["print"] for r in rows}
    old = {r[MONTH]: r["print"] for r in spark.read.parquet(f"{root}/{PRINTS}").collect()}
    if new.get(None) != old.get(None):
        write_views(tables, scope, root)
        return sorted(k for k in {*new, *old} if k)
    changed = sorted(k for k in {*new, *old} if k and new.get(k) != old.get(k))
    for month in changed:
        if month in new:
            _write_rows(tables, scope.within_month(month), root)
        # what had rows and has none, as a whole or in the view of lines
        for name in BY_MONTH:
            if month not in new or _dated(name, tables, scope.within_month(month)).isEmpty():
                files.remove(spark, f"{root}/{name}/{MONTH}={month:%Y-%m-%d}")
    if changed:
        prints = spark.createDataFrame(rows, f"{MONTH} date, print decimal(38,0)")
        _write_rest(tables, scope, root, prints.coalesce(1))
    return changed
