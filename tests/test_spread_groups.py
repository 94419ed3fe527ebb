"""Members' effects projected in the cluster, with small blocks and buckets, against the driver's."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import spread_akm, spread_groups
from quadrat.operators.groups import fit_groups, shared_singletons


@pytest.mark.parametrize(("aggregation", "weights", "fes", "clusters"), [("sum", "w", ["team"], ["team"])])
def test_same_fit(spark, monkeypatch, aggregation, weights, fes, clusters):
    g = np.random.default_rng(8)
    effect, rows = g.normal(size=12), []
    for group in range(90):
        members = g.choice(12, size=g.integers(1, 5), replace=False)
        x, team = g.normal(), group % 7
        y = effect[members].mean() + 0.7 * x + 0.2 * team + g.normal() * 0.1
        rows += [(f"g{group}", f"m{m}", team, float(y), float(x), 1.0 + group % 3) for m in members]
    df = spark.createDataFrame(rows, "group string, member string, team int, y double, x double, w double").repartition(3)
    monkeypatch.setattr(spread_akm, "BLOCK_MATCHES", 80)
    monkeypatch.setattr(spread_akm, "BUCKET_NODES", 6)
    a, b = (fit_groups(df, "y", ["x"], "group", fes, individual="member", aggregation=aggregation, weights=weights, clusters=clusters, se_type="cluster" if clusters else "unadjusted", spread=s) for s in (False, True))
    assert np.allclose(a.coef, b.coef, rtol=1e-8) and np.allclose(a.vcov[0, 0], b.vcov[0, 0], rtol=1e-8) and a.n == b.n and np.isclose(a.tss, b.tss)
    both = a.absorption["individual"].join(b.absorption["individual"].withColumnRenamed("effect", "other"), "member").toPandas()
    assert len(both) == 12 and np.allclose(both.effect - both.effect.mean(), both.other - both.other.mean(), atol=1e-6)


def shuffled(spark):
    """Bytes that this application has shuffled so far."""
    time.sleep(1)
    spark.range(1).count()
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def bridge(spark, groups, members):
    """Groups of three members, each with x and what it and its members give y."""
    df = spark.range(groups).selectExpr("id AS g", "cast(xxhash64(id) % 1000 AS double) / 100 AS x", f"explode(array(id % {members}, {members} + id * 7 % {members}, 2 * {members} + xxhash64(id, 1) % 5 + 5)) AS m")
    return df.withColumn("y", F.expr("x * 2 + (xxhash64(g, 2) % 100) / 100.0"))


def test_rounds_move_no_group(spark):
    """What is shuffled doesn't hold the bridge once for each round of the gradients; the blocks did, at 20 bytes an entry."""
    df = bridge(spark, 40_000, 50).cache()
    df.count()
    before = shuffled(spark)
    r = fit_groups(df, "y", ["x"], "g", individual="m", spread=True)
    assert r.absorption["iterations"] > 5 and shuffled(spark) - before < 60 * df.count()
    df.unpersist()


def test_levels_in_buckets_as_in_the_driver(spark, monkeypatch):
    df = bridge(spark, 300, 10)
    few = fit_groups(df, "y", ["x"], "g", individual="m", spread=True)
    monkeypatch.setattr(spread_groups, "LEVELS_SENT", 7)
    slices = fit_groups(df, "y", ["x"], "g", individual="m", spread=True)
    monkeypatch.setattr(spread_groups, "MOST_VALUES", 0)
    many = fit_groups(df, "y", ["x"], "g", individual="m", spread=True)
    for r in (slices, many):
        assert np.allclose(few.coef, r.coef, rtol=1e-8) and np.isclose(few.se[0], r.se[0], rtol=1e-8) and few.n == r.n


def test_groups_that_vary_and_lone_members(spark):
    rows = [(g, m, float(g), float(g * g % 5)) for g in range(12) for m in (g % 3, 3 + g % 2)]
    chain = [(20, 0, 1.0, 1.0), (20, 90, 1.0, 1.0), (21, 90, 1.0, 2.0), (21, 91, 1.0, 2.0)]
    df = spark.createDataFrame(rows + chain, "g int, m int, y double, x double")
    # 91 is alone in 21, and then 90 in 20
    assert shared_singletons(df, "g", "m", []).select("g").distinct().count() == 12
    assert fit_groups(df, "y", ["x"], "g", individual="m").n == 12
    # a column that varies raises, but not in a group that goes
    assert fit_groups(df.union(spark.createDataFrame([(21, 91, 7.0, 2.0)], df.schema)), "y", ["x"], "g", individual="m").n == 12
    with pytest.raises(ValueError, match="varies"):
        fit_groups(df.union(spark.createDataFrame([(1, 1, 7.0, 1.0)], df.schema)), "y", ["x"], "g", individual="m")


def test_stalled_gradients_begin_anew(spark, monkeypatch):
    """With a goal below what carried residuals reach, the true residual is made anew until it helps no more."""
    monkeypatch.setattr(spread_akm, "STALLED", 2)
    rows = [(f"w{i // 2}", (i + 1) // 2 % 6, 1.0, float(i % 5), float(i % 5) ** 2) for i in range(16)]
    system = spread_akm.SpreadSystem(spark.createDataFrame(rows, "worker string, firm int, t double, s double, ss double"))
    sums = lambda b, low, high: (b.s[low:high, None], b.s[low:high, None])
    with pytest.raises(RuntimeError):
        system.solve(sums, 1, tol=1e-40)
    assert system.solve(sums, 1, tol=1e-9).count() == 1
