"""Keys of few levels, long chains, and what is done beyond the bounds of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import absorb as absorb_module
from quadrat.operators import graph, sample
from quadrat.operators.absorb import absorb, normalise, within
from quadrat.operators.graph import components, joined_nodes, mobility_groups
from quadrat.operators.sample import drop_singletons


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_singletons_of_a_path(spark):
    """100,000 edges, of which each is alone only when the one before has gone."""
    path = spark.range(100_000).select((F.col("id") / 2).cast("long").alias("a"), ((F.col("id") + 1) / 2).cast("long").alias("b"))
    assert drop_singletons(path, ["a", "b"]).count() == 0


def test_singletons_in_the_cluster(spark):
    chain = spark.range(3000).select((F.col("id") / 2).cast("long").alias("a"), ((F.col("id") + 1) / 2).cast("long").alias("b"))
    ring = spark.range(40).select((F.col("id") / 2).cast("long").alias("a"), (F.expr("(id + 1) % 40") / 2).cast("long").alias("b")).select((F.col("a") + 10_000).alias("a"), (F.col("b") + 10_000).alias("b"))
    tail = spark.createDataFrame([(10_000, 5000), (5001, 5000), (5001, None)], "a long, b long")
    got = drop_singletons(chain.unionByName(ring).unionByName(tail), ["a", "b"], most_cells=0)
    assert got.count() == 40 and got.where("a < 10000").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_singletons_by_force(spark, seed):
    g = np.random.default_rng(seed)
    rows = [tuple(int(x) for x in g.integers(0, [9, 12, 7])) + (int(g.integers(1, 3)) if g.random() < 0.2 else 1,) for _ in range(25)]
    rows = [(None if r[0] == 0 else r[0], *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "a long, b long, c long, n long")
    left = rows
    while True:
        count = {}
        for r in left:
            for k in range(3):
                count[k, r[k]] = count.get((k, r[k]), 0) + r[3]
        keep = [r for r in left if all(count[k, r[k]] > 1 for k in range(3))]
        if len(keep) == len(left):
            break
        left = keep
    for most in (None, 0):
        got = drop_singletons(df, ["a", "b", "c"], "n", most_cells=most).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, left))


def test_components(spark):
    g = np.random.default_rng(3)
    for rows in ([(i, i + 1) for i in range(600)], [(int(a), int(b)) for a, b in g.integers(-60, 60, (70, 2))], [(0, i) for i in range(1, 40)]):
        u, v = (np.array(x) for x in zip(*[r for r in rows if r[0] != r[1]], strict=True))
        want = sorted(zip(*(x.tolist() for x in joined_nodes(u, v)), strict=True))
        for most in (None, 0):
            assert sorted(map(tuple, components(spark.createDataFrame(rows, "u long, v long"), most).collect())) == want


def test_mobility_groups_beyond_one_task(spark, monkeypatch):
    g = np.random.default_rng(6)
    df = spark.createDataFrame([(f"a{x}", int(y)) for x, y in g.integers(0, 40, (45, 2))], "a string, b int")
    want = sorted(map(tuple, mobility_groups(df, "a", "b").collect()))
    monkeypatch.setattr(graph, "MOST_EDGES", 0)
    assert sorted(map(tuple, mobility_groups(df, "a", "b").collect())) == want


def test_no_level_in_one_task(spark):
    """Means and shifts are joined from small tables: no exchange of rows by a key of few levels or by a mobility group."""
    df = spark.range(5000).select((F.col("id") % 3).alias("year"), (F.col("id") % 50).alias("firm"), F.rand(1).alias("y"), F.rand(2).alias("w"), F.when(F.col("id") % 3 == 0, None).otherwise(1).alias("odd"))
    out = within(df, ["y"], "year", "w")
    assert "Window" not in plan(out) and "Exchange hashpartitioning(year" not in plan(out)
    assert out.groupBy("year").agg(F.abs(F.sum(F.col("y_tilde") * F.col("w"))).alias("s")).where("s > 1e-9").count() == 0
    assert within(df, ["y"], "odd").where("y_tilde IS NULL").count() == 0
    own = normalise(df.withColumn("f1", F.col("y")).withColumn("f2", F.col("w")), ["f1", "f2"], ["firm", "year"])
    assert "Window" not in plan(own) and "__group" not in plan(own) and abs(own.agg(F.avg("f2")).first()[0]) < 1e-9


def test_hot_levels_in_the_iterations(spark, monkeypatch):
    """A level with many edges is dealt out by lots, and the result is the driver's."""
    df = spark.range(900).select((F.col("id") % 2).alias("year"), F.expr("id * 7919 % 61").alias("firm"), F.rand(1).alias("y"))
    want, _ = absorb(df, ["y"], ["year", "firm"])
    monkeypatch.setattr(absorb_module, "MOST_CELLS", 1)
    monkeypatch.setattr(absorb_module, "HOT_EDGES", 20)
    got, how = absorb(df, ["y"], ["year", "firm"])
    assert how["method"] == "spread levels"
    a, b = (np.sort([r[0] for r in x.select("y_tilde").collect()]) for x in (want, got))
    assert np.allclose(a, b, atol=1e-9)


def test_pair_in_blocks(spark, monkeypatch):
    """Two effects beyond what the driver takes are solved on blocks, also with weights of zero and recovered effects, and a chain still ends."""
    from quadrat.operators import absorb as m

    g = np.random.default_rng(21)
    rows = [(int(a), f"s{b}", float(y), float(w)) for a, b, y, w in zip(g.integers(0, 60, 500), g.integers(0, 12, 500), g.normal(size=500), g.integers(1, 4, 500), strict=True)] + [(99, "s99", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "part long, supplier string, y double, w double").withColumn("row", F.monotonically_increasing_id())
    want, _ = m.absorb(df, ["y"], ["supplier", "part"], "w", effects=True)
    want = {r.row: r for r in want.collect()}
    monkeypatch.setattr(m, "MOST_PAIR_CELLS", 0)
    monkeypatch.setattr(m, "PAIR_MATCHES", 100)
    monkeypatch.setattr(m, "_spread", None)
    monkeypatch.setattr(m, "_solve", None)
    got, how = m.absorb(df, ["y"], ["supplier", "part"], "w", effects=True)
    got = got.collect()
    assert len(got) == 501 and how["certified"] and 0 < how["iterations"] < 60
    assert all(abs(r.y_tilde - want[r.row].y_tilde) < 1e-9 for r in got)
    assert {r["part"] for r in how["terms"][1].collect()} == {x[0] for x in rows}
