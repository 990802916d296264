"""Repeat customers and cohorts. A customer is the person, not the order's record."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m
from tillroll.functions.stats import erfc, two_proportion_z
from tillroll.operators.firsts import first_rows
from tillroll.operators.grains import delivered_on_record, with_person
from tillroll.scope import Scope
from tillroll.tables import RetailTables

_BOUGHT = "order_purchase_timestamp"


def repeat_rate(tables: RetailTables, scope: Scope) -> DataFrame:
    """Customers with two or more orders; strictly: on two or more days.

    An order is one row, so a plain count serves; two different days exist
    exactly when the first and last day differ.
    """
    people = (
        with_person(scope.apply(tables.orders), tables.customers)
        .groupBy("customer_unique_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min(F.to_date(_BOUGHT)).alias("first_day"),
            F.max(F.to_date(_BOUGHT)).alias("last_day"),
        )
    )
    totals = people.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        F.count_if(F.col("first_day") < F.col("last_day")).alias("repeat_customers_strict"),
        F.sum("orders").alias("_orders"),
    )
    everyone = F.col("customers")
    return totals.select(
        "customers",
        "repeat_customers",
        m.pct(F.col("repeat_customers"), everyone, 2).alias("repeat_rate_pct"),
        "repeat_customers_strict",
        m.pct(F.col("repeat_customers_strict"), everyone, 2).alias("repeat_rate_strict_pct"),
        F.round(m.ratio(F.col("_orders"), everyone), 3).alias("avg_orders_per_customer"),
    )


# A customer's active months are bits, counted from the scope's first month.
MONTHS_PER_WORD = 60
CALENDAR_WORDS = 10  # fifty years


def _active_months(tables: RetailTables, scope: Scope) -> DataFrame:
    """(cohort_month, cohort, words) of the customers of cohorts in the window.

    The first month is looked for in all orders of the status, before the window is applied.
    One aggregate per person finds it together with the months as bits of `CALENDAR_WORDS`
    longs, fixed-size buffers that tasks reduce before the shuffle. `cohort` numbers the first
    month from the scope's. Months before the scope only tell that a person is not in a
    cohort; one beyond the calendar is an error.
    """
    bought = m.month_of(F.col(_BOUGHT))
    first = F.lit(scope.start.replace(day=1))
    month = m.months_between(bought, first)
    beyond = F.raise_error(F.lit("an order is over fifty years younger than the scope"))
    number = F.when(month < MONTHS_PER_WORD * CALENDAR_WORDS, month).otherwise(beyond)
    orders = with_person(scope.has_status(tables.orders), tables.customers).select(
        "customer_unique_id",
        bought.alias("month"),
        F.floor(number / MONTHS_PER_WORD).cast("int").alias("word"),
        F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(MONTHS_PER_WORD)).cast("int")
        ).alias("bit"),
    )
    words = [
        F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0)).alias(f"w{i}")
        for i in range(CALENDAR_WORDS)
    ]
    people = orders.groupBy("customer_unique_id").agg(F.min("month").alias("cohort_month"), *words)
    return people.filter(scope.holds_month(F.col("cohort_month"))).select(
        "cohort_month",
        m.months_between(F.col("cohort_month"), first).cast("int").alias("cohort"),
        F.array(*[f"w{i}" for i in range(CALENDAR_WORDS)]).alias("words"),
    )


def cohort_activity(tables: RetailTables, scope: Scope) -> DataFrame:
    """Active customers per (first month, months since), for cohorts in the window."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(MONTHS_PER_WORD - 1)),
        lambda i: F.bit_get(F.col("bits"), i) == 1,
    )
    number = F.col("word") * MONTHS_PER_WORD + F.col("bit") - F.col("cohort")
    return (
        _active_months(tables, scope)
        .select("cohort_month", "cohort", F.posexplode("words").alias("word", "bits"))
        .filter(F.col("bits") != 0)
        .select("cohort_month", "cohort", "word", F.explode(bits).alias("bit"))
        .groupBy("cohort_month", number.alias("month_number"))
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )


def cohort_long(
    tables: RetailTables, scope: Scope, observable_only: bool = False
) -> DataFrame:
    """Retention for every month in which a cohort was active at all.

    Activity after the scope's end counts too, unless `observable_only` is set;
    it makes no difference where the data end with the scope.
    """
    by_month = Window.partitionBy("cohort_month").orderBy("month_number")
    activity = cohort_activity(tables, scope)
    if observable_only:
        activity = activity.filter(
            scope.observable(F.col("cohort_month"), F.col("month_number"))
        )
    return (
        activity.withColumn("cohort_size", F.first("active_customers").over(by_month))
        .withColumn("retention_pct", m.pct(F.col("active_customers"), F.col("cohort_size"), 2))
        .orderBy("cohort_month", "month_number")
    )


def cohort_counts(tables: RetailTables, scope: Scope, horizon: int) -> DataFrame:
    """One row per cohort with the active customers of months 0..horizon in an array."""

    def active(k: int) -> Column:
        month = F.col("cohort") + k
        word = F.get("words", F.floor(month / MONTHS_PER_WORD).cast("int"))
        return F.coalesce(F.bit_get(word, F.pmod(month, F.lit(MONTHS_PER_WORD))), F.lit(0))

    return (
        _active_months(tables, scope)
        .groupBy("cohort_month")
        .agg(F.array(*[F.sum(active(k)) for k in range(horizon + 1)]).alias("active"))
        .withColumn("cohort_size", F.col("active")[0])
    )


def cohort_matrix(tables: RetailTables, scope: Scope, horizon: int = 6) -> DataFrame:
    """Months as columns: NULL where the month is not observable yet, 0 where nobody came."""
    month = F.col("cohort_month")
    return (
        cohort_counts(tables, scope, horizon)
        .select(
            "cohort_month",
            "cohort_size",
            *[
                F.when(
                    scope.observable(month, k), m.pct(F.col("active")[k], F.col("cohort_size"), 2)
                ).alias(f"m{k}")
                for k in range(1, horizon + 1)
            ],
        )
        .orderBy("cohort_month")
    )


def second_order_gap(tables: RetailTables, scope: Scope) -> DataFrame:
    """Days from a customer's first order to the second."""
    orders = with_person(scope.apply(tables.orders), tables.customers).select(
        "customer_unique_id", "order_id", _BOUGHT
    )
    gaps = (
        first_rows(orders, "customer_unique_id", [_BOUGHT, "order_id"], 2)
        .groupBy("customer_unique_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.datediff(F.max(F.to_date(_BOUGHT)), F.min(F.to_date(_BOUGHT))).alias("days"),
        )
        .filter(F.col("orders") == 2)
    )
    # The exact percentile keeps one entry per distinct gap: the window's days at most.
    totals = gaps.agg(
        F.count(F.lit(1)).alias("repeat_customers"),
        F.sum("days").alias("_days"),
        F.percentile("days", F.lit(0.5)).alias("median_days"),
        F.count_if(F.col("days") == 0).alias("_same_day"),
        F.count_if(F.col("days") <= 30).alias("_within_30d"),
    )
    n = F.col("repeat_customers")
    return totals.select(
        "repeat_customers",
        F.round(m.ratio(F.col("_days"), n), 1).alias("avg_days"),
        "median_days",
        m.pct(F.col("_same_day"), n, 1).alias("pct_same_day"),
        m.pct(F.col("_within_30d"), n, 1).alias("pct_within_30d"),
    )


def late_first_order_test(
    tables: RetailTables, scope: Scope, bias_cutoff: date = date(2018, 3, 1)
) -> DataFrame:
    """Does a late first delivery make a second order less likely?

    The second sample keeps first orders before `bias_cutoff`, whose customers
    all had time to return. Only orders with a delivery date count.
    """
    orders = with_person(
        delivered_on_record(scope.apply(tables.orders)), tables.customers
    ).select(
        "customer_unique_id", "order_id", _BOUGHT, (m.delay_days() > 0).alias("is_late")
    )
    first = F.col("sequence") == 1
    first_orders = (
        first_rows(orders, "customer_unique_id", [_BOUGHT, "order_id"], 2)
        .groupBy("customer_unique_id")
        .agg(
            F.max(F.when(first, F.col("is_late"))).alias("is_late"),
            F.min(F.to_date(_BOUGHT)).alias("first_day"),
            F.count_if(F.col("sequence") == 2).alias("repeated"),
        )
    )
    # At most four rows reach the explode that puts early orders in both samples.
    cells = first_orders.groupBy(
        "is_late", (F.col("first_day") < F.lit(bias_cutoff)).alias("is_early")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("repeated").alias("repeated"))
    early_label = f"2. First order before {bias_cutoff:%b %Y}"
    samples = F.when(
        F.col("is_early"), F.array(F.lit("1. All first orders"), F.lit(early_label))
    ).otherwise(F.array(F.lit("1. All first orders")))
    late = F.col("is_late")

    def over(cell, column):
        return F.coalesce(F.sum(F.when(cell, F.col(column))), F.lit(0))

    rates = (
        cells.withColumn("sample", F.explode(samples))
        .groupBy("sample")
        .agg(
            over(~late, "n").alias("n_on_time"),
            over(~late, "repeated").alias("_on_time"),
            over(late, "n").alias("n_late"),
            over(late, "repeated").alias("_late"),
        )
    )
    # z and its argument are columns of their own: the error function names its
    # argument dozens of times, and would otherwise repeat the whole test in each.
    z = two_proportion_z(F.col("_on_time"), F.col("n_on_time"), F.col("_late"), F.col("n_late"))
    tested = rates.withColumn("_z", z).withColumn("_x", F.abs("_z") / F.sqrt(F.lit(2.0)))
    return tested.select(
        "sample",
        "n_on_time",
        m.pct(F.col("_on_time"), F.col("n_on_time"), 2).alias("on_time_repeat_pct"),
        "n_late",
        m.pct(F.col("_late"), F.col("n_late"), 2).alias("late_repeat_pct"),
        F.round("_z", 2).alias("z_score"),
        F.round(erfc(F.col("_x")), 3).alias("p_value"),
    ).orderBy("sample")
