"""Building the stored tables from raw files and checking the result."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import TABLES
from tillroll.scope import MONTH_COLUMN, MONTH_SEPARATOR
from tillroll.sources import manifest
from tillroll.sources.raw_csv import MULTILINE_TABLES, RAW_FILES, read_table
from tillroll.tables import RetailTables


def raw_tables(
    spark: SparkSession,
    root: str,
    files: Mapping[str, str] = RAW_FILES,
    multiline: Collection[str] = MULTILINE_TABLES,
) -> RetailTables:
    """The raw files as typed tables. A path may be a file, a folder or a pattern."""
    return RetailTables(
        lambda table: read_table(spark, table, f"{root}/{files[table]}", multiline)
    )


def load_tables(
    spark: SparkSession, raw_root: str, target_root: str, files: Mapping[str, str] = RAW_FILES
) -> RetailTables:
    """Rebuild every table from its raw file, parents before children."""
    return store_tables(spark, raw_tables(spark, raw_root, files), target_root)


# Facts lie in folders of consecutive purchase months.
FACTS = ("orders", "order_items", "order_payments", "order_reviews")
FOLDER_BYTES = 256 << 20  # of values of orders, before encoding
MIN_FOLDERS = 12
WRITERS = 4  # tables written at once
COMPRESSION = "zstd"  # of stored files


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    size = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            size = size + 8
    return size


def month_folders(
    orders: DataFrame, folder_bytes: int = FOLDER_BYTES, min_folders: int = MIN_FOLDERS
) -> list[tuple[date, date]]:
    """First and last month of each folder: consecutive months until they fill one.

    Months are as many as the calendar has. Where all orders are few, folders are smaller,
    so that there are about `min_folders`."""
    month = F.trunc("order_purchase_timestamp", "month").alias("month")
    sizes = (
        orders.groupBy(month).agg(F.sum(_row_bytes(orders)).alias("bytes")).orderBy("month").collect()
    )
    full = min(folder_bytes, sum(r["bytes"] for r in sizes) / min_folders)
    folders: list[list] = []
    filled = full
    for row in sizes:
        if filled >= full or filled + row["bytes"] > 1.25 * full:
            folders.append([row["month"], row["month"]])
            filled = 0
        folders[-1][1] = row["month"]
        filled += row["bytes"]
    return [tuple(f) for f in folders]


def _folder_of(month: Column, folders: list[tuple[date, date]]) -> Column:
    """The name of the folder that a month lies in."""
    name = F.lit(None).cast("string")
    for first, last in reversed(folders):
        name = F.when(month <= F.lit(last), f"{first:%Y-%m}{MONTH_SEPARATOR}{last:%Y-%m}").otherwise(name)
    return F.when(month.isNotNull(), name)


def _write(df: DataFrame, path: str, files: int | None) -> None:
    """Dated tables in a folder for some purchase months each, so that a scan of some months
    opens only their files; the rebalance splits big folders into even files and samples
    nothing. Other tables keep the partitions they are read in, or get `files` even ones."""
    if MONTH_COLUMN in df.columns:
        by_month = df.hint("rebalance", MONTH_COLUMN)
        by_month.write.partitionBy(MONTH_COLUMN).parquet(path, compression=COMPRESSION)
    else:
        (df.repartition(files) if files else df).write.parquet(path, compression=COMPRESSION)


def _by_order_month(spark: SparkSession, df: DataFrame, orders_path: str) -> DataFrame:
    """Rows with the folder of their order; none for rows without an order."""
    orders = RetailTables.open(spark, "orders", orders_path, laid_out=True)
    return df.join(orders.select("order_id", MONTH_COLUMN), "order_id", "left").select(
        *df.columns, MONTH_COLUMN
    )


def append_rows(spark: SparkSession, root: str, table: str, rows: DataFrame) -> None:
    """Add rows to a stored table, facts to the folders of the months they belong to.

    Append orders before their items, payments and reviews. A folder that is new may overlap
    older ones in its months; scopes open all that may hold theirs."""
    folders = manifest.published(spark, root)
    rows = rows.select(*TABLES[table].schema.names)
    if folders[table].endswith(manifest.DATED):
        if table == "orders":
            bought = F.trunc("order_purchase_timestamp", "month")
            rows = rows.withColumn(MONTH_COLUMN, _folder_of(bought, month_folders(rows)))
        else:
            rows = _by_order_month(spark, rows, f"{root}/{folders['orders']}")
        writer = rows.hint("rebalance", MONTH_COLUMN).write.partitionBy(MONTH_COLUMN)
    else:
        writer = rows.write
    writer.mode("append").parquet(f"{root}/{folders[table]}", compression=COMPRESSION)


def store_tables(
    spark: SparkSession,
    tables: RetailTables,
    root: str,
    files: int | None = None,
    only: Collection[str] = tuple(TABLES),
    folder_bytes: int = FOLDER_BYTES,
) -> RetailTables:
    """Write every table, or `only` some, aside, and publish them together at the end.

    Orders come first; the other facts are laid out by the month of their order, those
    without one in a folder of their own. Independent tables are written side by side.
    `files` spreads each other table over that many files. Left out, a table keeps the
    partitions it was read in, without a shuffle. Facts written without their orders have no
    months.
    """
    version = manifest.new_version()
    dated = set(FACTS) & set(only) if "orders" in only else set()
    folders = {t: f"{version}/{t}{manifest.DATED if t in dated else ''}" for t in only}
    if "orders" in only:
        months = month_folders(tables.orders, folder_bytes)
        bought = F.trunc("order_purchase_timestamp", "month")
        orders = tables.orders.withColumn(MONTH_COLUMN, _folder_of(bought, months))
        _write(orders, f"{root}/{folders['orders']}", files)

    def layout(table: str) -> DataFrame:
        df = getattr(tables, table)
        if table not in dated:
            return df
        return _by_order_month(spark, df, f"{root}/{folders['orders']}")

    def write(table: str) -> None:
        _write(layout(table), f"{root}/{folders[table]}", files)

    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(write, table) for table in only if table != "orders"]:
            done.result()
    manifest.publish(spark, root, folders)
    return RetailTables.read(spark, root)


def load_and_reconcile(
    spark: SparkSession, raw_root: str, target_root: str, files: Mapping[str, str] = RAW_FILES
) -> DataFrame:
    """Load, and compare the rows in the raw files with the rows stored."""
    load_tables(spark, raw_root, target_root, files)
    return reconcile_load(spark, raw_root, target_root, files)


# Tables joined on a key again and again, and that key.
BUCKET_KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "order_reviews": "order_id",
}


def store_bucketed(
    spark: SparkSession, tables: RetailTables, root: str, database: str, buckets: int
) -> RetailTables:
    """Write the tables to the catalog with the fact tables bucketed on their order.

    Joins and aggregates on order_id then read co-located buckets and shuffle
    nothing. One bucket is one task, so this layout is for data without a hot
    order; on plain files a hot key is split at run time instead.
    """
    for table, df in tables.items():
        df = df.drop(MONTH_COLUMN)
        key = BUCKET_KEYS.get(table)
        if key:
            # the same hash as the buckets: one file per bucket, not one per task and bucket
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = df.write
        writer.mode("overwrite").option("path", f"{root}/{table}").saveAsTable(f"{database}.{table}")
    return RetailTables(lambda table: spark.table(f"{database}.{table}"))


def fingerprints(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of each table, and a sum and an exclusive-or over hashes of its rows: whatever
    the order of the rows, other values or other rows give others. Layout columns are left
    out. Both come from one query, in which a task that runs again counts once."""
    sides = []
    for table, df in tables.items():
        row = F.xxhash64(*[c for c in df.columns if c != MONTH_COLUMN])
        print_ = F.struct(F.sum(row.cast("decimal(20,0)")), F.bit_xor(row)).alias(f"{name}_print")
        counts = df.agg(F.count(F.lit(1)).alias(name), print_)
        sides.append(counts.select(F.lit(table).alias("table_name"), name, f"{name}_print"))
    return reduce(DataFrame.unionByName, sides)


def reconcile(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """Row counts of both sides per table. A table missing on one side is a mismatch, and so
    are equal counts of rows that do not hold the same values."""
    both = fingerprints(expected, "expected").join(
        fingerprints(actual, "actual"), "table_name", "full_outer"
    )
    agrees = F.col("expected").eqNullSafe(F.col("actual")) & F.col("expected_print").eqNullSafe(
        F.col("actual_print")
    )
    return both.select(
        "table_name",
        "expected",
        "actual",
        F.when(agrees, "OK").otherwise("MISMATCH").alias("status"),
    ).orderBy("table_name")


def reconcile_load(
    spark: SparkSession, raw_root: str, target_root: str, files: Mapping[str, str] = RAW_FILES
) -> DataFrame:
    """What the raw files hold now against what was stored, read anew on both sides."""
    raw = raw_tables(spark, raw_root, files)
    stored = RetailTables.read(spark, target_root)
    return reconcile(dict(raw.items()), dict(stored.items()))
