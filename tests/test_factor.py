"""The incomplete factorisation, and absorptions of levels that hang together by few others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import absorb as absorb_module
from quadrat.operators import coarse as coarse_module
from quadrat.operators.absorb import FEW_ROUNDS, absorb
from quadrat.operators.coarse import Coarse
from quadrat.operators.factor import LaplacianFactor


def laplacian(n, u, v, w):
    out = np.zeros((n, n))
    np.add.at(out, (np.r_[u, v, u, v], np.r_[u, v, v, u]), np.r_[w, w, -w, -w])
    return out


@pytest.mark.parametrize("shape", ["tree", "ring", "chains"])
def test_exact_without_branches(shape):
    g = np.random.default_rng(4)
    n = 3000
    v = np.arange(1, n)
    u = {"tree": g.integers(0, v), "ring": v - 1, "chains": v - 1}[shape]
    if shape == "ring":
        u, v = np.append(u, 0), np.append(v, n - 1)
    if shape == "chains":
        u, v = u[v % 700 > 0], v[v % 700 > 0]
    w = g.uniform(0.5, 2, len(u))
    e = g.normal(size=len(u))
    b = np.bincount(u, e, n) - np.bincount(v, e, n)
    z = LaplacianFactor(n, u, v, w).solve(b)
    assert np.allclose(laplacian(n, u, v, w) @ z, b, atol=1e-8)


@pytest.mark.parametrize("edges", [0, 1, 30, 4000, 40_000])
def test_symmetric_and_not_negative(edges):
    """Also of loops, repeated edges, edges of no weight, nodes without edges and cores that are left to their diagonal."""
    g = np.random.default_rng(edges)
    n = 2000
    u, v = g.integers(0, n, (2, edges))
    w = np.where(g.random(edges) < 0.1, 0.0, g.uniform(0.1, 3, edges))
    f, again = LaplacianFactor(n, u, v, w), LaplacianFactor(n, u, v, w)
    a, b = g.normal(size=(2, n))
    assert np.isclose(a @ f.solve(b), b @ f.solve(a)) and np.array_equal(f.solve(a), again.solve(a))
    fit = a @ laplacian(n, u, v, w)
    assert fit @ f.solve(fit) >= 0


def test_grid_in_few_rounds():
    """The spectrum of the preconditioned Laplacian is narrow, where the diagonal's isn't."""
    m = 40
    at = np.arange(m * m).reshape(m, m)
    u, v = np.r_[at[:, :-1].ravel(), at[:-1].ravel()], np.r_[at[:, 1:].ravel(), at[1:].ravel()]
    whole = laplacian(m * m, u, v, np.ones(len(u)))
    f = LaplacianFactor(m * m, u, v, np.ones(len(u)))
    values = np.sort(np.linalg.eigvals(np.stack([f.solve(x) for x in whole.T], 1)).real)
    assert values[0] > -1e-9 and values[1] > 0.05 and values[-1] < 20


def chain(spark, levels=10_000):
    """Rows of two effects whose graph is one path of so many levels."""
    rows = spark.range(levels - 1).select((F.expr("id div 2")).alias("a"), F.expr("(id + 1) div 2").alias("b"), F.rand(3).alias("e"))
    again = rows.withColumn("e", F.rand(4))
    return rows.unionByName(again).withColumn("y", F.col("e") + 0.001 * F.col("a"))


def test_a_long_chain(spark):
    out, how = absorb(chain(spark), ["y", "e"], ["a", "b"])
    assert how["certified"] and FEW_ROUNDS < how["iterations"] < 100
    # a tree of pairs of rows: each pair's mean is explained, so residuals are half of its difference
    odd = out.groupBy("a", "b").agg(F.max(F.abs(F.col("e_tilde"))).alias("got"), ((F.max("e") - F.min("e")) / 2).alias("want"))
    assert odd.where("abs(got - want) > 1e-6").count() == 0


def test_a_chain_and_a_third_effect(spark):
    df = chain(spark, 4000).withColumn("c", F.expr("pmod(xxhash64(e), 5)")).withColumn("w", F.lit(1.0) + F.col("e"))
    _, how = absorb(df, ["y"], ["c", "a", "b"], "w")
    assert how["certified"] and how["iterations"] < 150


def test_clusters(spark, monkeypatch):
    """Clusters are joined by edges, no more than asked for, and their edges add up to those that cross."""
    g = np.random.default_rng(8)
    edges = [(int(a), 1000 + int(b), float(w)) for a, b, w in zip(g.integers(0, 300, 900), g.integers(0, 60, 900), g.integers(1, 4, 900), strict=True)] + [(5000, 5001, 1.0)]
    monkeypatch.setattr(coarse_module, "MOST_CLUSTERS", 20)
    made = Coarse(spark.createDataFrame(edges, "u long, v long, w double"))
    place = {r["node"]: r["place"] for r in made.places.collect()}
    assert made.size <= 20 and made.rounds and set(place.values()) == set(range(made.size)) and 5000 not in place
    whole = laplacian(made.size, *(np.array(x) for x in zip(*[(place[a], place[b], w) for a, b, w in edges if a in place], strict=True)))
    b = whole @ g.normal(size=made.size)
    assert np.allclose(whole @ made.factor.solve(b), b)


def test_a_chain_in_the_cluster(spark, monkeypatch):
    """Clusters of about three levels; the rows' residuals are the driver's."""
    df = chain(spark, 60).withColumn("n", F.monotonically_increasing_id())
    want, _ = absorb(df, ["y"], ["a", "b"])
    monkeypatch.setattr(absorb_module, "MOST_CELLS", 1)
    monkeypatch.setattr(absorb_module, "FEW_ROUNDS", 3)
    monkeypatch.setattr(coarse_module, "MOST_CLUSTERS", 30)
    got, how = absorb(df, ["y"], ["a", "b"])
    assert how["method"] == "spread levels" and how["certified"] and how["iterations"] < 50
    a, b = (np.array([r[0] for r in x.orderBy("n").select("y_tilde").collect()]) for x in (want, got))
    assert np.allclose(a, b, atol=1e-8)
