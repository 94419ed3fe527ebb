"""Bootstrap in one pass: as refits one by one, draws in the cluster, hot levels."""

import time

import numpy as np
import pandas as pd
import pytest

from quadrat.operators import resample
from quadrat.operators.resample import bootstrap, draws


def panel(n=300):
    g = np.random.default_rng(11)
    i = np.arange(n)
    # levels of one row among others, and units that cross levels
    level = np.where(i < 6, 1000 + i, i % 23)
    x, z, v = g.normal(size=(3, n))
    return pd.DataFrame({"unit": i // 4, "level": level, "x": x + level % 5, "z": z + 0.4 * x + 100, "v": v - 0.2 * x, "y": x - z + 0.5 * v + level % 7 + g.normal(size=n), "w": 1.0 + i % 3})


@pytest.mark.parametrize("options", [{}, {"weights": "w"}, {"fes": ["level"]}, {"fes": ["level"], "weights": "w"}, {"common_fes": ["level"]}])
def test_one_pass_is_the_loop(spark, options):
    df = spark.createDataFrame(panel())
    asked = {"reps": 2, "seed": 5, "y": "y", "x1": ["x"], "groups": {"z": ["z"], "v": ["v"]}, "kind": "basic"} | options
    want = bootstrap(df, "unit", one_pass=False, **asked)
    got = bootstrap(df, "unit", hot_cells=8, **asked)
    assert [r["group"] for r in got] == [r["group"] for r in want] == ["z", "v", *options.get("fes", [])]
    for a, b in zip(got, want, strict=True):
        assert a["valid"] == b["valid"] == 2
        assert np.allclose([a["delta"], a["se"], a["low"], a["high"]], [b["delta"], b["se"], b["low"], b["high"]], rtol=1e-7, atol=1e-9)


def test_many_replicates(spark):
    df, jobs = spark.createDataFrame(panel()), spark.sparkContext.statusTracker()
    asked = {"y": "y", "x1": ["x"], "groups": {"z": ["z"], "v": ["v"]}, "fes": ["level"]}
    used = []
    for reps in (20, 999):
        spark.sparkContext.setJobGroup(f"reps{reps}", "")
        got = bootstrap(df, "unit", reps=reps, seed=2, hot_cells=8, **asked)
        used.append(len(jobs.getJobIdsForGroup(f"reps{reps}")))
    assert got[0]["valid"] == 999 and used[1] <= used[0] + 5
    assert all(r["low"] < r["delta"] < r["high"] for r in got)
    # lots of a level add up to the level
    whole = bootstrap(df, "unit", reps=20, seed=2, **asked)
    lots = bootstrap(df, "unit", reps=20, seed=2, hot_cells=8, **asked)
    assert np.allclose([r["se"] for r in whole], [r["se"] for r in lots], rtol=1e-9)


def counts_of(d):
    rows = d.orderBy("unit").collect()
    return np.stack([np.frombuffer(r["__draws"], ">u2") for r in rows]).astype(int)


def test_draws_in_the_cluster(spark):
    units = spark.range(5000).withColumnRenamed("id", "unit")
    got = counts_of(draws(units, 40, 3, most_counts=0))
    assert got.shape == (5000, 40) and (got.sum(0) == 5000).all()
    # as multinomial counts: variance 1, no draws shared between replicates, and the share of units never drawn
    assert abs(got.var() - 1) < 0.02 and abs((got == 0).mean() - np.exp(-1)) < 0.005
    assert np.abs(np.corrcoef(got.T) - np.eye(40)).max() < 0.08
    assert (got == counts_of(draws(units.repartition(7), 40, 3, most_counts=0))).all()
    assert not (got == counts_of(draws(units, 40, 4, most_counts=0))).all()
    here = counts_of(draws(units, 2, 3))
    stream = np.random.Generator(np.random.PCG64(np.random.SeedSequence(3).spawn(2)[1]))
    assert (here[:, 1] == np.bincount(stream.integers(0, 5000, 5000), minlength=5000)).all()


def test_odd_input(spark):
    p = panel(60)
    df = spark.createDataFrame(p)
    asked = {"reps": 3, "y": "y", "x1": ["x"], "groups": {"z": ["z"]}}
    with pytest.raises(ValueError, match="one pass"):
        bootstrap(df, "unit", one_pass=True, fes=["level", "w"], **asked)
    gone = df.selectExpr("nullif(unit, 3) AS unit", "level", "x", "z", "y")
    with pytest.raises(ValueError, match="no unit"):
        bootstrap(gone, "unit", **asked)
    assert bootstrap(gone, "unit", na_action="drop", **asked)[0]["delta"] == pytest.approx(bootstrap(df.where("unit <> 3"), "unit", **asked)[0]["delta"])
    with pytest.raises(ValueError):
        bootstrap(df.where("false"), "unit", **asked)
    # a column that draws make constant is a replicate that fails
    rare = df.withColumn("z", (df.unit == 3).cast("double"))
    with pytest.raises(RuntimeError, match="valid"):
        bootstrap(rare, "unit", seed=1, **(asked | {"reps": 60}))


def shuffled(spark):
    """Bytes that this application has shuffled so far."""
    time.sleep(1)
    spark.range(1).count()
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_counts_stay_out_of_the_cells(spark):
    """Cells of units and levels are shuffled without a count for each replicate, which took hundreds of bytes; with counts drawn in the cluster they are joined."""
    n = 20_000
    p = panel(n)
    i = np.arange(n)
    df = spark.createDataFrame(p.assign(unit=i % 200, level=i // 200 % 50 * 2 + i // 10_000)).cache()
    asked = {"reps": 400, "seed": 5, "y": "y", "x1": ["x"], "groups": {"z": ["z"]}, "fes": ["level"]}
    df.count()
    before = shuffled(spark)
    bootstrap(df, "unit", **asked)
    assert shuffled(spark) - before < 150 * n
    df.unpersist()


def test_sent_and_joined_counts_agree(spark, monkeypatch):
    df = spark.createDataFrame(panel())
    asked = {"reps": 20, "seed": 5, "y": "y", "x1": ["x"], "groups": {"z": ["z"]}, "fes": ["level"], "hot_cells": 8, "most_counts": 0}
    joined = bootstrap(df, "unit", **asked)
    send = resample._sent_draws
    monkeypatch.setattr(resample, "_sent_draws", lambda counts, unit, reps, most: send(counts, unit, reps, 10**6))
    for a, b in zip(bootstrap(df, "unit", **asked), joined, strict=True):
        assert np.allclose([a["delta"], a["se"], a["low"], a["high"]], [b["delta"], b["se"], b["low"], b["high"]], rtol=1e-9)
