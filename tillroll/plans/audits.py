"""Declared rules as jobs that list or count violations. Spark enforces no keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.schema import TABLES
from tillroll.tables import RetailTables


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent, with their number of rows.

    Children are counted per value first, so a popular parent is one row in the join.
    """
    values = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return values.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tally(violations: DataFrame, **tags: str) -> DataFrame:
    return violations.agg(
        F.count(F.lit(1)).alias("violating_keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("violating_rows"),
    ).select(*[F.lit(v).alias(k) for k, v in tags.items()], "violating_keys", "violating_rows")


def _key_audit(tables: RetailTables, keys_of) -> DataFrame:
    parts = [
        _tally(duplicate_keys(df, list(key)), table_name=name, rule=", ".join(key))
        for name, df in tables.items()
        for key in keys_of(TABLES[name])
    ]
    return _union(parts).orderBy("table_name", "rule")


def primary_keys(tables: RetailTables) -> DataFrame:
    return _key_audit(tables, lambda rules: [rules.primary_key])


def unique_columns(tables: RetailTables) -> DataFrame:
    return _key_audit(tables, lambda rules: rules.unique)


def foreign_keys(tables: RetailTables) -> DataFrame:
    parts = []
    for name, df in tables.items():
        for fk in TABLES[name].foreign_keys:
            lost = orphans(df, fk.column, getattr(tables, fk.parent), fk.parent_column)
            rule = f"{fk.column} -> {fk.parent}"
            parts.append(_tally(lost, table_name=name, rule=rule))
    return _union(parts).orderBy("table_name", "rule")


def _column_audit(tables: RetailTables, checks_of) -> DataFrame:
    """One pass per table counts the rows that break each column's rule."""
    parts = []
    for name, df in tables.items():
        checks = checks_of(TABLES[name])
        if not checks:
            continue
        counts = df.agg(*[F.count_if(broken).alias(column) for column, broken in checks.items()])
        parts.append(
            counts.unpivot([], list(checks), "column_name", "violating_rows").select(
                F.lit(name).alias("table_name"), "column_name", "violating_rows"
            )
        )
    return _union(parts).orderBy("table_name", "column_name")


def required_values(tables: RetailTables) -> DataFrame:
    return _column_audit(tables, lambda r: {c: F.col(c).isNull() for c in r.not_null})


def value_domains(tables: RetailTables) -> DataFrame:
    return _column_audit(
        tables, lambda r: {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in r.between.items()}
    )


def text_lengths(tables: RetailTables) -> DataFrame:
    return _column_audit(
        tables, lambda r: {c: F.length(c) > n for c, n in r.max_length.items()}
    )


def known_anomalies(tables: RetailTables) -> DataFrame:
    """Counts of oddities that are expected in the data and handled by the plans."""
    reviews, products = tables.order_reviews, tables.products
    labels = products.select(F.col("product_category_name").alias("value")).filter("value IS NOT NULL")
    translated = tables.category_translation.select(F.col("product_category_name").alias("value"))
    zips = tables.customers.select(F.col("customer_zip_code_prefix").alias("value")).unionByName(
        tables.sellers.select(F.col("seller_zip_code_prefix").alias("value"))
    )
    points = tables.geolocation.select(F.col("zip_code_prefix").alias("value"))
    repeated = duplicate_keys(reviews, ["review_id"])
    found = {
        "surplus rows of repeated review ids": repeated.agg(F.sum(F.col("rows") - 1)),
        "orders with more than one review": duplicate_keys(reviews, ["order_id"]).agg(
            F.count(F.lit(1))
        ),
        "products without a category": products.agg(
            F.count_if(F.col("product_category_name").isNull())
        ),
        "categories without a translation": labels.distinct()
        .join(translated, "value", "left_anti")
        .agg(F.count(F.lit(1))),
        "zip prefixes without a point": zips.distinct()
        .join(points, "value", "left_anti")
        .agg(F.count(F.lit(1))),
    }
    parts = [
        df.toDF("found").select(
            F.lit(anomaly).alias("anomaly"), F.coalesce("found", F.lit(0)).alias("found")
        )
        for anomaly, df in found.items()
    ]
    return _union(parts).orderBy("anomaly")
