"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

FLUSH_LINKS = 1 << 20


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These links as stars: each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes, at most one for each node of some FLUSH_LINKS links
    that a task reads: the rounds move fewer rows, and paths within a task are gone."""

    def contract(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            n += batch.num_rows
            if n >= FLUSH_LINKS:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    def stars(held):
        u, v = local_stars(*(np.concatenate(column) for column in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    known = links.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    return known.mapInArrow(contract, "u long, v long")


def _to_least(pairs: DataFrame, with_self: bool) -> DataFrame:
    """Every neighbour v of u, tied to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_self:
        tied = tied.unionByName(least.withColumnRenamed("m", "v"))
    return tied


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (u, v) that are not alone; a component
    is named by its least node. Links may come in any direction, repeated, or to oneself.

    Large and small stars take turns until every node but the roots has one link, to a
    root. Each round is written to the shared folder, so a lost executor costs one round.
    Before the first, each task ties the links it reads to stars. The number of rounds grows
    with the logarithm of the longest path; links that are stars already take none."""
    down = F.col("u") > F.col("v")
    stars = written(_contracted(links).distinct(), "stars")
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, with_self=False).where(down).distinct()
        small = _to_least(large, with_self=True).where(down).distinct()
        stars = written(small, "stars")
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return named.unionByName(roots)


def _settled(stars: DataFrame) -> bool:
    """Has every node one link down, or links from above, but not both?"""
    down = stars.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = stars.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = down.unionByName(up).groupBy("node").agg(F.sum("down").alias("n"), F.max("up").alias("up"))
    return ends.where("n > 1 OR (n = 1 AND up = 1)").isEmpty()
