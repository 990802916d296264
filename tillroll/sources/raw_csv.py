"""Raw CSV files to typed tables.

Every column is read as text, so a zip prefix keeps its leading zeros; the
declared types are applied afterwards, and a value that does not fit fails the
load rather than turning into NULL.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import POINT, TABLES

# File of each raw table, unless the caller names others.
RAW_FILES = {table: f"{table}.csv" for table in TABLES}

# Texts that mean "no value" in the raw files.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Column names misspelled in the raw products file.
PRODUCT_RENAMES = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}

# Free-text comments hold line breaks. Such a file cannot be split, so only these
# tables are read this way unless the caller says otherwise; a row broken over
# lines in another table fails the read.
MULTILINE_TABLES = frozenset({"order_reviews"})


def read_text_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text under their header names; null tokens become NULL.

    The files of a folder or pattern must agree in their header: one with other names,
    or the same in another order, fails the read (`enforceSchema` off).
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline,
        mode="FAILFAST", enforceSchema=False,
    )
    return nulls_from_tokens(raw)


def nulls_from_tokens(text: DataFrame) -> DataFrame:
    return text.select(
        *[F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)).alias(c) for c in text.columns]
    )


def whole_number(column: str) -> Column:
    """"40.0" as 40; a fraction is an error, not something to cut off."""
    value = F.col(column).cast("double")
    complaint = F.concat(F.lit(f"{column} is not a whole number: "), F.col(column))
    return (
        F.when(value == F.floor(value), value.cast("int"))
        .when(value.isNotNull(), F.raise_error(complaint))
        .alias(column)
    )


def clean_products(text: DataFrame) -> DataFrame:
    renamed = text.withColumnsRenamed(PRODUCT_RENAMES)
    labels = ["product_id", "product_category_name"]
    return renamed.select(*labels, *[whole_number(c) for c in renamed.columns if c not in labels])


def rollup_geolocation(points: DataFrame) -> DataFrame:
    """One mean point per zip prefix with its most frequent city and state.

    Equally frequent names resolve to the smallest. Points are counted per name
    first, map-side, so a prefix with very many points moves as one row per name
    and task, and no buffer holds the names of a prefix. The means are taken in
    decimals: their last digit must not depend on the order in which tasks finish.
    """
    zip_code, city, state = (
        f"geolocation_{c}" for c in ("zip_code_prefix", "city", "state")
    )
    by_city = F.grouping(city) == 0

    def total(axis: str) -> Column:
        return F.sum(F.col(f"geolocation_{axis}").cast("decimal(18,14)")).alias(axis)

    names = (
        points.filter(F.col(zip_code).isNotNull())
        .groupingSets([[zip_code, city], [zip_code, state]], zip_code, city, state)
        .agg(
            by_city.alias("by_city"),
            F.count(F.lit(1)).alias("n"),
            *[total(axis) for axis in ("lat", "lng")],
            *[F.count(f"geolocation_{axis}").alias(f"{axis}_n") for axis in ("lat", "lng")],
        )
    )

    def most_frequent(name: str) -> Column:
        return F.min(F.when(F.col(name).isNotNull(), F.struct(-F.col("n"), name)))[name]

    def mean(axis: str) -> Column:
        # every point once: from the rows by city
        points_of, n = (F.sum(F.when(F.col("by_city"), F.col(c))) for c in (axis, f"{axis}_n"))
        exact = F.try_divide(points_of.cast("decimal(38,14)"), n.cast("decimal(20,0)"))
        return F.round(exact, 6).cast(POINT).alias(axis)

    return names.groupBy(F.col(zip_code).alias("zip_code_prefix")).agg(
        mean("lat"),
        mean("lng"),
        most_frequent(city).alias("city"),
        most_frequent(state).alias("state"),
    )


def apply_types(text: DataFrame, table: str) -> DataFrame:
    """The table's declared columns, by name and in order, in their declared types."""
    return text.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema.fields]
    )


def convert(text: DataFrame, table: str) -> DataFrame:
    if table == "products":
        text = clean_products(text)
    elif table == "geolocation":
        text = rollup_geolocation(text)
    return apply_types(text, table)


def read_table(
    spark: SparkSession, table: str, path: str, multiline: Collection[str] = MULTILINE_TABLES
) -> DataFrame:
    return convert(read_text_csv(spark, path, multiline=table in multiline), table)
