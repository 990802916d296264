"""What the Jaccard join moves and how many jobs it starts, beside its results."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import components
from tillroll.llm import bloom, jaccard_join
from tillroll.llm.components import local_stars


@contextmanager
def settings(spark, **values):
    old = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_a_filter_takes_few_jobs_however_many_partitions_there_are(spark):
    group = uuid.uuid4().hex
    many = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    ids = spark.range(0, 5000, 7)
    with settings(spark, **many):
        spark.sparkContext.setJobGroup(group, "filter")
        try:
            maybe = bloom.among(ids)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10
    found = {r.id for r in spark.range(5000).where(maybe(F.col("id"))).collect()}
    assert set(range(0, 5000, 7)) <= found and len(found) < 1000


@pytest.mark.parametrize("seed", range(5))
def test_stars_of_some_links(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, 60, (2, 10 * seed))
    least = list(range(60))
    for _ in range(60):
        for a, b in zip(u, v):
            least[a] = least[b] = min(least[a], least[b])
    nodes, roots = local_stars(u, v)
    assert dict(zip(nodes, roots)) == {i: least[i] for i in range(60) if least[i] != i}
    chain = np.arange(1000)
    nodes, roots = local_stars(chain[1:], chain[:-1])
    assert list(nodes) == list(chain[1:]) and not roots.any()


def _link(spark, monkeypatch, texts):
    """Plans of the tables that the join writes, by name, and its components."""
    plans: dict[str, str] = {}
    plain = jaccard_join.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(jaccard_join, "written", noted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    return plans, found


def test_sets_are_not_moved_for_what_is_known_before(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 120, 6)] + ["alone"]
    plans, found = _link(spark, monkeypatch, texts)
    assert found == components(list(enumerate(texts)), 4, 85)
    # groups are known before the sets are made: no join above them
    sets = plans["token-sets"]
    assert "MapInArrow" in sets and "Join" not in sets[: sets.index("MapInArrow")]
    # no key has more than one task's bytes, so no set is moved to blocks
    assert "blocks" not in plans
    monkeypatch.setattr(jaccard_join, "KEY_BYTES", 64)
    plans, found = _link(spark, monkeypatch, texts)
    assert found == components(list(enumerate(texts)), 4, 85)
