"""Small files and folders, in whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it, if it is there."""
    system, place = _place(spark, path)
    system.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    system, place = _place(spark, folder)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file aside and rename it over the old one, so that a reader finds either."""
    jvm = spark.sparkContext._jvm
    system, place = _place(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
    stream = system.create(aside, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(system.makeQualified(aside), system.makeQualified(place), how)
