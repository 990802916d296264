"""First rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: str, order_by: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered 1..k in `sequence`.

    Spark puts a group limit before the shuffle for this filter, so every task
    sends at most k rows per key however many rows a hot key has.
    """
    w = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn("sequence", F.row_number().over(w)).filter(F.col("sequence") <= k)
