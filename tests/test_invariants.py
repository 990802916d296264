"""Totals that must agree across plans, and limits on what a plan may do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tillroll.plans import delivery, findings, region, retention, sellers, semantic, trend
from tillroll.schema import TABLES
from tillroll.sources import store, synthetic

SCOPE = synthetic.SCOPE


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    return store.store_tables(spark, synthetic.bind(spark, "/root/testdata/sf0.001"), root)


def _sum(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_revenue_totals_agree(tables):
    totals = {
        _sum(plan(tables, SCOPE), "revenue")
        for plan in (
            trend.monthly_revenue,
            region.state_category,
            region.state_revenue,
            semantic.orders_view,
            semantic.order_items_view,
        )
    }
    assert len(totals) == 1 and None not in totals


def test_order_totals_agree(tables):
    orders = semantic.orders_view(tables, SCOPE).count()
    assert _sum(trend.monthly_revenue(tables, SCOPE), "orders") == orders
    assert _sum(region.state_revenue(tables, SCOPE), "orders") == orders


def test_buckets_add_up(tables):
    view = semantic.orders_view(tables, SCOPE).filter(
        "delay_days IS NOT NULL AND review_score IS NOT NULL"
    )
    assert _sum(delivery.delay_buckets(tables, SCOPE), "orders") == view.count()


def test_cohorts_start_whole(tables):
    view = semantic.cohort_retention_view(tables, SCOPE).filter("month_number = 0")
    assert {float(r.retention_pct) for r in view.collect()} == {100.0}


def test_rating_list_is_the_view_cut_at_the_rank(tables):
    listed = sellers.sellers_by_rating(tables, SCOPE, min_reviewed=2, top_n=3)
    view = semantic.seller_summary_view(tables, SCOPE, min_reviewed=2).filter("revenue_rank <= 3")
    columns = ["seller_id", "revenue", "avg_rating", "revenue_rank", "rating_rank"]
    assert sorted(listed.select(*columns).collect()) == sorted(view.select(*columns).collect())


def test_views_are_queryable_and_stored(spark, tables, tmp_path):
    semantic.register_views(tables, SCOPE)
    tables.register()
    n = spark.sql("SELECT count(*) FROM vw_orders v JOIN orders o ON o.order_id = v.order_id").first()[0]
    semantic.write_views(tables, SCOPE, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/vw_orders")
    assert stored.count() == n > 0
    assert stored.filter("order_month = DATE '1997-03-01'").inputFiles()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scope_reaches_the_scan(tables):
    plan = plan_of(delivery.late_rate_by_quarter(tables, SCOPE))
    assert "GreaterThanOrEqual(order_purchase_timestamp,1997-01-01T00:00)" in plan
    assert "LessThan(order_purchase_timestamp,1998-09-01T00:00)" in plan
    assert "EqualTo(order_status,F)" in plan


def test_only_needed_columns_are_read(tables):
    plan = plan_of(trend.monthly_revenue(tables, SCOPE))
    assert "ReadSchema: struct<order_id:string,price:decimal(10,2),freight_value:decimal(10,2)>" in plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_person_is_cut_before_the_shuffle(tables, no_broadcast):
    for plan in (retention.second_order_gap, retention.late_first_order_test):
        text = plan_of(plan(tables, SCOPE))
        assert "Partial" in text and text.count("WindowGroupLimit") == 2


def test_seller_orders_share_the_join_shuffle(tables, no_broadcast):
    df = sellers.top_sellers(tables, SCOPE)
    df.collect()
    plan = plan_of(df).split("Initial Plan")[0]
    assert "Exchange hashpartitioning(order_id, seller_id" not in plan
    assert "Expand" not in plan
    assert "ReusedExchange" in plan  # the total comes from the sums of the list


def test_cohorts_take_one_shuffle_per_person(tables, no_broadcast):
    plan = plan_of(retention.cohort_activity(tables, SCOPE))
    assert plan.count("Exchange hashpartitioning(customer_unique_id") == 1
    assert "Window" not in plan


def test_category_lines_are_shuffled_twice(tables, no_broadcast):
    plan = plan_of(region.state_category(tables, SCOPE))
    assert "hashpartitioning(customer_state" in plan  # of the grid, after both joins
    assert "Exchange hashpartitioning(customer_state#" in plan
    for keys in plan.split("Exchange hashpartitioning(")[1:]:
        assert "order_id" not in keys.split(")")[0] or keys.startswith("order_id")


def test_one_sort_for_growth_and_state_shares(tables):
    for plan in (trend.revenue_growth, findings.top_state_share):
        text = plan_of(plan(tables, SCOPE))
        below = text[text.index("SinglePartition"):]
        assert "rangepartitioning" not in below


def test_building_a_plan_starts_no_job(spark, tables):
    spark.sparkContext.setJobGroup("building", "")
    for plan in (sellers.pareto, sellers.sellers_by_rating, semantic.seller_summary_view):
        plan(tables, SCOPE)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_money_and_days_keep_their_types(tables):
    """Every plan, before the registered queries turn decimals and dates into plain values."""
    decimals = {"revenue", "price", "freight_value", "product_value", "prev_month_revenue",
                "rolling_3m_avg", "revenue_this_year", "revenue_last_year"}
    days = {"purchase_date", "order_month", "cohort_month", "month", "quarter"}
    seen = set()
    for name, plan in entry_module.ON_TABLES.items():
        for column, kind in plan(tables).dtypes:
            if column in decimals or column.startswith("pct_") or column.endswith("_pct"):
                exact = name == "d4_mean_month1_retention" and column == "mean_retention_pct"
                assert kind.startswith("double" if exact else "decimal"), (name, column, kind)
                seen.add(column)
            elif column in days:
                assert kind == "date", (name, column, kind)
                seen.add(column)
    assert decimals | days <= seen


def test_scope_filter_reads_fewer_files(tables):
    def scanned(df):
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numFiles").value()

    inside = scanned(SCOPE.apply(tables.orders).select("order_id"))
    everything = scanned(tables.orders.select("order_id"))
    assert 0 < inside < everything / 2


def test_buckets_spare_the_order_shuffles(spark, tables, no_broadcast, tmp_path):
    bucketed = store.store_bucketed(spark, tables, str(tmp_path), "default", 4)
    try:
        for plan in (trend.monthly_revenue, sellers.top_sellers, sellers.seller_stats):
            assert "Exchange hashpartitioning(order_id" not in plan_of(plan(bucketed, SCOPE))
        assert (
            trend.monthly_revenue(bucketed, SCOPE).collect()
            == trend.monthly_revenue(tables, SCOPE).collect()
        )
    finally:
        for name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS default.{name}")


def test_hot_order_is_split_at_run_time(spark, tables, no_broadcast, tmp_path):
    """A third of all lines in one order: its join partition is split over tasks,
    although the aggregate after the join builds on the join's partitioning."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.shuffle.partitions": "16",
    }
    hot = SCOPE.apply(tables.orders).orderBy("order_id").first().order_id
    third = F.xxhash64("order_id", "order_item_id", "product_id") % 3 == 0
    lines = tables.order_items
    lines.withColumn("order_id", F.when(third, hot).otherwise(F.col("order_id"))).repartition(
        8
    ).write.parquet(str(tmp_path / "lines"))
    crowded = spark.read.schema(lines.schema).parquet(str(tmp_path / "lines"))
    skewed = type(tables)(
        lambda name: crowded if name == "order_items" else getattr(tables, name)
    )
    expected = _sum(semantic.order_items_view(skewed, SCOPE), "revenue")

    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = sellers.seller_orders(skewed, SCOPE)
        got = df.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(df)
        assert sum(r.revenue_cents for r in got) == 100 * expected
        assert len({(r.order_id, r.seller_id) for r in got}) == len(got)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
