"""Share of a grand total for results with a fixed small number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import measures as m


def share_of_all(value: str, digits: int = 2) -> Column:
    """For fully aggregated rows whose keys come from a closed list only (status,
    score, delay bucket, two-letter state): the window sees those few rows."""
    return m.pct(F.col(value), F.sum(value).over(Window.partitionBy()), digits)


def counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
