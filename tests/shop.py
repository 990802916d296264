"""Builds small hand-made retail tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tillroll.schema import TABLES
from tillroll.tables import RetailTables

T0 = datetime(2017, 1, 1)


class Shop:
    def __init__(self):
        self.rows = {name: [] for name in TABLES}

    def order(self, order_id, person="p1", ts=datetime(2017, 5, 10, 12), status="delivered",
              delay=-3, state="SP"):
        promised = ts + timedelta(days=20)
        delivered = None if delay is None else promised + timedelta(days=delay)
        record = f"c-{order_id}"
        self.rows["customers"].append((record, person, "01001", "sao paulo", state))
        self.rows["orders"].append((order_id, record, status, ts, ts, ts, delivered, promised))
        return self

    def item(self, order_id, seller="s1", product="x1", price="10.00", freight="0.00"):
        line = 1 + sum(r[0] == order_id for r in self.rows["order_items"])
        self.rows["order_items"].append(
            (order_id, line, product, seller, T0, Decimal(price), Decimal(freight))
        )
        return self

    def review(self, order_id, score):
        n = len(self.rows["order_reviews"])
        self.rows["order_reviews"].append((f"r{n}", order_id, score, None, None, T0, T0))
        return self

    def seller(self, seller_id, state="SP"):
        self.rows["sellers"].append((seller_id, "01001", "sao paulo", state))
        return self

    def product(self, product_id, category=None):
        self.rows["products"].append((product_id, category) + (None,) * 7)
        return self

    def translate(self, name, english):
        self.rows["category_translation"].append((name, english))
        return self

    def row(self, table, *values):
        self.rows[table].append(values)
        return self

    def tables(self, spark) -> RetailTables:
        def table(name):
            schema = StructType([StructField(f.name, f.dataType) for f in TABLES[name].schema])
            records = [dict(zip(schema.names, row)) for row in self.rows[name]]
            arrow = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
            return spark.createDataFrame(arrow, schema)

        return RetailTables(table)


def rows(df):
    return [tuple(r) for r in df.collect()]
