"""Which orders an analysis looks at."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Stored facts are laid out by this column: first and last purchase month of their folder.
MONTH_COLUMN = "purchase_month"
MONTH_SEPARATOR = ".."  # 2017-01..2017-03


@dataclass(frozen=True)
class Scope:
    """Orders of one status bought in the half-open window [start, end)."""

    start: date = date(2017, 1, 1)
    end: date = date(2018, 9, 1)
    status: str = "delivered"

    def within_month(self, month: date) -> Scope:
        """The part of the window that lies in the month of that first day."""
        after = (month.replace(day=28) + timedelta(days=4)).replace(day=1)
        return replace(self, start=max(self.start, month), end=min(self.end, after))

    def has_status(self, orders: DataFrame) -> DataFrame:
        return orders.filter(F.col("order_status") == self.status)

    def apply(self, orders: DataFrame) -> DataFrame:
        """Status and window on the raw columns, so both reach the file scan; where orders
        are laid out by month, files of other months are not opened."""
        bought = F.col("order_purchase_timestamp")
        return self.near(
            self.has_status(orders).filter(
                (bought >= timestamp_literal(self.start)) & (bought < timestamp_literal(self.end))
            )
        )

    def near(self, facts: DataFrame) -> DataFrame:
        """Without the folders of rows whose orders were bought in other months. What is left
        is still to be joined to the orders in scope."""
        if MONTH_COLUMN not in facts.columns:
            return facts
        months = F.col(MONTH_COLUMN)
        last_day = self.end - timedelta(days=1)
        return facts.filter(
            (F.substring(months, -7, 7) >= f"{self.start:%Y-%m}")
            & (F.substring(months, 1, 7) <= f"{last_day:%Y-%m}")
        ).drop(MONTH_COLUMN)

    def holds_month(self, month: Column) -> Column:
        return (month >= F.lit(self.start)) & (month < F.lit(self.end))

    def observable(self, month: Column, months_later: Column | int) -> Column:
        """Has the month `months_later` after `month` begun before the data ends?"""
        return F.add_months(month, months_later) < F.lit(self.end)


def timestamp_literal(day: date) -> Column:
    # A zone-less literal: comparing with a zoned one would wrap the column in a
    # cast and keep the filter out of the scan.
    return F.expr(f"TIMESTAMP_NTZ '{day.isoformat()} 00:00:00'")
