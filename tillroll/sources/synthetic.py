"""The nine retail tables derived from a generic star schema, for tests and timing.

Nothing in the plans depends on this module. Every column is a fixed formula of
the source rows, so an independent SQL engine can derive the same tables.
"""

from __future__ import annotations

from collections.abc import Collection
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import TABLES
from tillroll.scope import Scope
from tillroll.sources.raw_csv import RAW_FILES, rollup_geolocation
from tillroll.tables import RetailTables

SCOPE = Scope(start=date(1997, 1, 1), end=date(1998, 9, 1), status="F")
BIAS_CUTOFF = date(1998, 3, 1)
MIN_REVIEWED = 45


# Compressed files cannot be split, so none may hold more rows than one task reads well.
ROWS_PER_FILE = 1_000_000

_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def source(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A source table; its schema is read from the file once per process."""
    path = f"{root}/{name}.parquet"
    if (root, name) not in _SCHEMAS:
        _SCHEMAS[root, name] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[root, name]).parquet(path)


def bind(spark: SparkSession, root: str) -> RetailTables:
    def src(name: str) -> DataFrame:
        return source(spark, root, name)

    build = {
        "customers": lambda: _customers(src("orders"), src("customer"), src("nation")),
        "sellers": lambda: _sellers(src("supplier"), src("nation")),
        "category_translation": lambda: _translation(src("part")),
        "products": lambda: _products(src("part")),
        "geolocation": lambda: rollup_geolocation(raw_points(src("events"))),
        "orders": lambda: _orders(src("orders"), src("lineitem")),
        "order_items": lambda: _items(src("lineitem")),
        "order_payments": lambda: _payments(src("orders")),
        "order_reviews": lambda: _reviews(src("lineitem")),
    }
    return RetailTables(
        lambda name: build[name]().select(
            *[F.col(f.name).cast(f.dataType) for f in TABLES[name].schema.fields]
        )
    )


def _zip(key: str) -> Column:
    return F.lpad((F.col(key) % 100000).cast("string"), 5, "0")


def _customers(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        _zip("o_custkey").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        _zip("s_suppkey").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def _translation(parts: DataFrame) -> DataFrame:
    return (
        parts.filter(~F.col("p_type").isin("PROMO", "STANDARD"))
        .select(F.col("p_type").alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", F.lower("product_category_name"))
    )


def _products(parts: DataFrame) -> DataFrame:
    return parts.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 53 != 0, F.col("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        (F.col("p_size") * 10).alias("product_description_length"),
        (F.col("p_partkey") % 7).alias("product_photos_qty"),
        F.floor("p_retailprice").alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        F.col("p_size").alias("product_height_cm"),
        F.col("p_size").alias("product_width_cm"),
    )


def raw_points(events: DataFrame) -> DataFrame:
    """Raw points, many per zip prefix; latitude and longitude as text."""
    return events.select(
        _zip("user_id").alias("geolocation_zip_code_prefix"),
        F.col("value").cast("string").alias("geolocation_lat"),
        (-F.col("value")).cast("string").alias("geolocation_lng"),
        F.col("event_type").alias("geolocation_city"),
        F.upper(F.substring("event_type", 1, 2)).alias("geolocation_state"),
    )


def _orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    shipped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last_ship")
    )
    bought = F.col("o_orderdate")
    gap = F.pmod(F.datediff(F.col("last_ship"), bought), F.lit(45))
    return orders.join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        F.when(F.col("o_orderkey") % 89 != 0, bought).alias("order_approved_at"),
        F.when(F.col("o_orderkey") % 83 != 0, F.date_add(bought, 1)).alias(
            "order_delivered_carrier_date"
        ),
        F.when(F.col("o_orderkey") % 97 != 0, F.date_add(bought, gap + 1)).alias(
            "order_delivered_customer_date"
        ),
        F.date_add(bought, 37).alias("order_estimated_delivery_date"),
    )


def _items(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).alias("freight_value"),
    )


def _payments(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.col("o_orderpriority").alias("payment_type"),
        (F.col("o_orderkey") % 10 + 1).alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
    )


def _reviews(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("l_linestatus") == "F").select(
        F.col("l_partkey").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_partkey") % 5 + 1).alias("review_score"),
        F.when(F.col("l_partkey") % 11 == 0, F.col("l_returnflag")).alias("review_comment_title"),
        F.when(
            F.col("l_partkey") % 13 == 0,
            F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(' is "fine",\nsaid the buyer, twice')),
        ).alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        F.date_add("l_shipdate", 1).alias("review_answer_timestamp"),
    )


def raw_products(spark: SparkSession, root: str) -> DataFrame:
    """Products as a raw file has them: all text, misspelled columns, "40.0" for 40."""
    products = _products(source(spark, root, "part"))
    labels = products.columns[:2]
    return products.select(
        *[F.col(c).cast("string") for c in labels],
        *[
            F.col(c).cast("double").cast("string").alias(c.replace("length", "lenght", 1) if i < 2 else c)
            for i, c in enumerate(products.columns[2:])
        ],
    )


def write_raw_csv(
    spark: SparkSession, root: str, target: str, tables: Collection[str] = tuple(TABLES)
) -> None:
    """The tables as raw CSV files, points and products in their raw form, and reviews
    with a word for a missing title. Text takes several times the bytes of its source, so the
    files are compressed."""
    raw = {name: df for name, df in bind(spark, root).items() if name in tables}
    if "products" in raw:
        raw["products"] = raw_products(spark, root)
    if "geolocation" in raw:
        raw["geolocation"] = raw_points(source(spark, root, "events"))
    if "order_reviews" in raw:
        raw["order_reviews"] = raw["order_reviews"].fillna("NULL", "review_comment_title")
    for name, df in raw.items():
        text = df.select(*[F.col(c).cast("string") for c in df.columns])
        writer = text.write.option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.csv(
            f"{target}/{RAW_FILES[name]}", header=True, quote='"', escape='"', compression="gzip"
        )
