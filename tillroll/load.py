"""Load job: raw CSV files to stored tables, then the row-count check.

    python -m tillroll.load RAW_ROOT TARGET_ROOT [--file TABLE=NAME ...] [--partitions N]

Only orders and the zip prefixes are shuffled. Name the partitions for large data:
bytes of raw orders / 200 MB, so 1 TB of orders takes --partitions 5000.

Ends with status 1 if any table's rows differ from its raw file's.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tillroll.session import tune
from tillroll.sources import store
from tillroll.sources.raw_csv import RAW_FILES


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("raw_root")
    parser.add_argument("target_root")
    parser.add_argument("--file", action="append", default=[], metavar="TABLE=NAME")
    parser.add_argument("--partitions", type=int, help="partitions that shuffles start with")
    options = parser.parse_args(arguments)
    files = {**RAW_FILES, **dict(pair.split("=", 1) for pair in options.file)}
    if set(files) != set(RAW_FILES):
        parser.error(f"unknown tables: {sorted(set(files) - set(RAW_FILES))}")

    session = SparkSession.builder.appName("load retail tables").getOrCreate()
    spark = tune(session, initial_partitions=options.partitions)
    report = store.load_and_reconcile(
        spark, options.raw_root, options.target_root, files
    ).collect()
    for row in report:
        print(f"{row.table_name:<22} {row.expected:>15,} {row.actual:>15,}  {row.status}")
    return int(any(row.status != "OK" for row in report))


if __name__ == "__main__":
    sys.exit(main())
