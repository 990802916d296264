from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import ranking


@pytest.fixture(params=["many cuts", "few cuts"])
def way(request, monkeypatch):
    if request.param == "few cuts":
        monkeypatch.setattr(ranking, "CUTS", 5)
    return request.param


def _values(kind):
    rng = random.Random(kind)
    return {
        "spread": [rng.randrange(-(2**62), 2**62) for _ in range(300)],
        "clustered": [rng.choice([5, 6, 7, 2**21, 2**21 + 1, 2**42, -1]) for _ in range(300)],
        "a third tied": [1000] * 100 + [rng.randrange(5000) for _ in range(200)],
        "one": [42],
        "none": [],
    }[kind]


KINDS = ["spread", "clustered", "a third tied", "one", "none"]


@pytest.mark.parametrize("kind", KINDS)
def test_rank_equals_one_window(spark, way, kind):
    df = spark.createDataFrame(list(enumerate(_values(kind))), "id bigint, v bigint")
    got = ranking.add_ranks(df, {"place": F.col("v")}, "n").select("id", "v", "place", "n")
    want = df.select(
        "id", "v",
        F.rank().over(Window.orderBy(F.desc("v"))).cast("bigint"),
        F.count(F.lit(1)).over(Window.partitionBy()),
    )
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_totals_equal_plain_sums(spark, way, kind):
    # small enough for the sums to fit
    values = sorted({v // 2**20 for v in _values(kind)}, reverse=True)
    df = spark.createDataFrame([(v, abs(v) % 97) for v in values], "v bigint, w bigint")
    got = ranking.running_totals(df, "v", ["w"]).select("v", "above_w", "total_w")
    weights = [abs(v) % 97 for v in values]
    want = {(v, sum(weights[:i]), sum(weights)) for i, v in enumerate(values)}
    assert {tuple(r) for r in got.collect()} == want


def test_several_ranks_and_missing_values(spark, way):
    rows = [(i, i % 7 if i % 5 else None, -i % 4 if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, a bigint, b bigint")
    got = ranking.add_ranks(df, {"ra": F.col("a"), "rb": F.col("b")}, "n")

    def rank(i, value):
        values = [r[i] for r in rows if r[i] is not None]
        return None if value is None else 1 + sum(v > value for v in values)

    n = max(sum(r[i] is not None for r in rows) for i in (1, 2))
    want = {
        (k, a, b, n if None not in (a, b) else None, rank(1, a), rank(2, b))
        for k, a, b in rows if (a, b) != (None, None)
    }
    found = {tuple(r) for r in got.select("id", "a", "b", "n", "ra", "rb").collect()}
    assert {(*w[:3], *w[4:]) for w in want} == {(*f[:3], *f[4:]) for f in found}


def test_no_job_runs_and_no_window_holds_the_table(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans only", "")
    ranked = ranking.add_ranks(df, {"place": F.col("v"), "other": -F.col("v")}, "n")
    totals = ranking.running_totals(df.groupBy("v").count(), "v", ["count"])
    assert not tracker.getJobIdsForGroup("plans only")
    for df in (ranked, totals):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        # rows of one block, or the table with one row for each block
        assert windows
        assert all("windowspecdefinition(_block" in w or "windowspecdefinition(_which" in w for w in windows)
        assert "Sort" not in plan.split("Exchange SinglePartition")[0].split("Window")[0]


def test_a_hot_tie_is_spread_and_the_table_of_blocks_not_shuffled(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id")).alias("v"))
    ranked = ranking.add_ranks(rows, {"place": F.col("v")}, "n")
    found, _ = ranking._above(rows.withColumn("k", F.col("v")), ["k"], {"n": F.lit(1)})
    hot = found.where("v = 3").select(F.countDistinct("_salt_0"), F.countDistinct("_block_0")).first()
    assert tuple(hot) == (1000, 1)
    assert ranked.where("v = 3").select("place", "n").distinct().collect() == [
        (1 + rows.where("v > 3").count(), 3000)
    ]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "Window [" in line]
    assert not any("_offsets" in line.split("windowspec")[0] for line in lines)
