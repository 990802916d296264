"""The nine related tables every plan reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.schema import TABLES
from tillroll.scope import MONTH_COLUMN, Scope
from tillroll.sources import manifest


class RetailTables:
    """The tables as attributes (`tables.orders`); each is opened on first use."""

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open_table = open_table

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self._open_table(name)
        if name != "orders":  # whose months `Scope.apply` uses
            df = df.drop(MONTH_COLUMN)
        setattr(self, name, df)
        return df

    def near(self, name: str, scope: Scope) -> DataFrame:
        """A fact table without the folders of rows whose orders `scope` leaves out by their
        month. What is left is still to be joined to the orders in scope."""
        return scope.near(self._open_table(name))

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in TABLES]

    @staticmethod
    def open(spark: SparkSession, name: str, path: str, laid_out: bool) -> DataFrame:
        """A stored table, with the purchase months of its folders if it is laid out by them."""
        schema = TABLES[name].schema
        if laid_out:
            schema = StructType([*schema.fields, StructField(MONTH_COLUMN, StringType())])
        return spark.read.schema(schema).parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> RetailTables:
        """Open the tables last published by `sources.store.store_tables`; facts come with
        the purchase months that they are laid out by."""
        folders = manifest.published(spark, root)

        def open_table(name: str) -> DataFrame:
            if name not in folders:
                raise FileNotFoundError(f"no table {name} has been published in {root}")
            folder = folders[name]
            return cls.open(spark, name, f"{root}/{folder}", folder.endswith(manifest.DATED))

        return cls(open_table)

    def register(self, prefix: str = "") -> None:
        """Make the tables queryable by name through `spark.sql`."""
        for name, df in self.items():
            df.createOrReplaceTempView(f"{prefix}{name}")
