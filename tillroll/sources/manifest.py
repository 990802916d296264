"""Which folders hold the current tables of a store.

Every load writes into a folder of its own under `versions`. One small file names the current
folder of each table; replacing it, in a single rename, publishes a load. Until then readers
see the tables of the load before, and a load that fails leaves them as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tillroll.sources import files

MANIFEST = "_manifest.json"
DATED = "-by-month"  # ends the name of a folder laid out by purchase month


def new_version() -> str:
    return f"versions/{uuid.uuid4().hex}"


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each table, relative to `root`; empty if nothing has been published."""
    path = f"{root}/{MANIFEST}"
    return json.loads(files.read_text(spark, path)) if files.exists(spark, path) else {}


def publish(spark: SparkSession, root: str, folders: dict[str, str]) -> None:
    """Make `folders` the current ones of their tables; other tables keep theirs."""
    current = {**published(spark, root), **folders}
    files.replace_text(spark, f"{root}/{MANIFEST}", json.dumps(current, indent=1, sort_keys=True))


def remove_unpublished(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of loads that failed or were replaced; returns their names.

    For a time when no load is running and no reader uses an older version."""
    kept = {folder.split("/")[1] for folder in published(spark, root).values()}
    gone = [name for name in files.names(spark, f"{root}/versions") if name not in kept]
    for name in gone:
        files.remove(spark, f"{root}/versions/{name}")
    return gone
