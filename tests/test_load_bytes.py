"""What the load writes: compressed files of a bounded number of rows, with all rows in them."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tests.shop import rows
from tillroll.sources import store, synthetic


@pytest.fixture
def star(spark, tmp_path):
    """A small star schema: what raw payments and points are made from."""
    root = str(tmp_path / "star")
    spark.range(500).selectExpr(
        "id AS o_orderkey", "id % 40 AS o_custkey", "'F' AS o_orderstatus",
        "CAST(id * 1.25 AS decimal(10,2)) AS o_totalprice",
        "DATE '1997-01-01' + CAST(id AS int) AS o_orderdate",
        "CASE WHEN id % 7 > 0 THEN '1-\"URGENT\", please' END AS o_orderpriority",
    ).write.parquet(f"{root}/orders.parquet")
    return root


def test_raw_files_are_compressed_and_bounded(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr(synthetic, "ROWS_PER_FILE", 30, raising=False)
    raw = tmp_path / "raw"
    bound = synthetic.bind
    monkeypatch.setattr(
        synthetic, "bind", lambda s, root: type(
            "Only", (), {"items": lambda self: [("order_payments", bound(s, root).order_payments)]}
        )(),
    )
    synthetic.write_raw_csv(spark, star, str(raw), ["order_payments"])
    files = list((raw / "order_payments.csv").glob("part-*"))
    assert len(files) >= 500 // 30 and all(f.name.endswith(".csv.gz") for f in files)
    read = store.raw_tables(spark, str(raw)).order_payments
    expected = bound(spark, star).order_payments
    assert sorted(map(repr, rows(read))) == sorted(map(repr, rows(expected)))
    assert read.count() == 500

    target = tmp_path / "tables"
    stored = store.store_tables(spark, store.raw_tables(spark, str(raw)), str(target), only=["order_payments"])
    assert sorted(map(repr, rows(stored.order_payments))) == sorted(map(repr, rows(expected)))
    (some, *_) = Path(target).glob("versions/*/order_payments*/*.parquet")
    assert pq.read_metadata(some).row_group(0).column(0).compression == "ZSTD"
