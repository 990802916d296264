"""Business definitions, each in exactly one place."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for any total, narrow enough that a quotient keeps 14 decimals.
EXACT = "decimal(20,2)"

# Labels start with a digit so that they sort in order of delay.
EARLY = "1. Early"
ON_TIME = "2. On time"
LATE_1_3 = "3. 1-3 days late"
LATE_4_7 = "4. 4-7 days late"
LATE_8_UP = "5. 8+ days late"


def revenue() -> Column:
    return F.col("price") + F.col("freight_value")


def cents(amount: Column) -> Column:
    """Money to be summed: long additions are exact too, and far cheaper than sums of
    decimals, whose buffers leave the range of a long. An overflow is an error."""
    return (amount * F.lit(100)).cast("bigint")


def money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(EXACT)


def ratio(part: Column, whole: Column) -> Column:
    """Exact quotient; NULL where there is nothing to divide by."""
    return F.try_divide(part.cast(EXACT), whole.cast(EXACT))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole in decimals, halves rounded away from zero."""
    return F.round(F.try_divide(part.cast(EXACT) * F.lit(100), whole.cast(EXACT)), digits)


def month_of(timestamp: Column) -> Column:
    return F.trunc(timestamp, "month")


def quarter_of(timestamp: Column) -> Column:
    return F.trunc(timestamp, "quarter")


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months between two first-of-month dates."""
    return F.months_between(later, earlier).cast("int")


def delay_days() -> Column:
    """Delivered minus promised, in whole days; negative means early."""
    return F.datediff(
        F.to_date("order_delivered_customer_date"), F.to_date("order_estimated_delivery_date")
    )


def delay_bucket(days: Column) -> Column:
    return (
        F.when(days < 0, EARLY)
        .when(days == 0, ON_TIME)
        .when(days <= 3, LATE_1_3)
        .when(days <= 7, LATE_4_7)
        .when(days > 7, LATE_8_UP)
    )


def category_label() -> Column:
    return F.coalesce(
        F.col("product_category_name_english"), F.col("product_category_name"), F.lit("unknown")
    )
