"""Worker-firm components solved in the cluster, with small blocks and buckets, against the driver's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import akm, spread_akm
from quadrat.operators.akm import akm_kss


@pytest.fixture(scope="module")
def jobs(spark):
    g = np.random.default_rng(3)
    a, psi, rows = g.normal(size=50), g.normal(size=9), []
    for w in range(50):
        for f in g.choice(9, size=g.integers(1, 9 if w < 3 else 4), replace=False):
            rows += [(f"w{w}", int(f), float(a[w] + psi[f] + g.normal() * 0.5)) for _ in range(g.integers(1, 4))]
    return spark.createDataFrame(rows, "worker string, firm int, y double").withColumn("z", F.expr("firm % 5 + 0.1 * firm")).repartition(3)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK_MATCHES": 50, "BUCKET_NODES": 5, "HOT_MATCHES": 5, "CHUNK": 16}.items():
        monkeypatch.setattr(spread_akm, name, value)
    monkeypatch.setattr(akm, "MOST_MATCHES", 20_000_000)


@pytest.mark.parametrize(("level", "dense"), [("match", 0), ("obs", 1000)])
def test_exact(spark, jobs, small, monkeypatch, level, dense):
    """Several blocks and buckets, workers that are nodes (without the inverse), and a projection."""
    monkeypatch.setattr(spread_akm, "DENSE_FIRMS", dense)
    if dense:
        monkeypatch.setattr(spread_akm, "HOT_MATCHES", 1000)
    a, b = (akm_kss(jobs, "y", "worker", "firm", z=["z"], level=level, leverages="exact", spread=s) for s in (False, True))
    for kind in ("plugin", "kss", "agsu"):
        assert np.allclose(list(getattr(a, kind).values()), list(getattr(b, kind).values()), rtol=1e-8), kind
    assert (a.n, a.workers, a.firms, a.matches) == (b.n, b.workers, b.firms, b.matches)
    assert all(np.isclose(a.lincom[0][k], b.lincom[0][k], rtol=1e-7) for k in ("coef", "se", "se_white"))
    both = a.effects.join(b.effects.withColumnRenamed("effect", "other"), ["kind", "id"]).toPandas()
    assert len(both) == a.workers + a.firms and np.allclose(both.effect, both.other, atol=1e-8)


def test_sketched(spark, jobs, small, monkeypatch):
    """No match table for the driver: leverages by signs are near the exact ones, and don't depend on how rows are dealt out."""
    exact = akm_kss(jobs, "y", "worker", "firm", leverages="exact")
    monkeypatch.setattr(akm, "MOST_MATCHES", 0)
    monkeypatch.setattr(akm, "_arrow", lambda df: (_ for _ in ()).throw(AssertionError("to the driver")))
    kept = exact.rows.select("worker", "firm", "y")
    runs = [akm_kss(kept.repartition(k), "y", "worker", "firm", leverages="jla", draws=20, seed=4, prune=False) for k in (2, 5)]
    assert all(abs(runs[0].kss[k] - v) < 0.06 for k, v in exact.kss.items()) and runs[0].leverages == "jla"
    assert np.allclose(list(runs[0].kss.values()), list(runs[1].kss.values()), rtol=1e-9)
    with pytest.raises(ValueError):
        akm_kss(kept, "y", "worker", "firm", prune=False, errors=True)


def _refused(*args, **kwargs):
    raise AssertionError("blocks are moved")


@pytest.mark.parametrize("level", ["match", "obs"])
def test_few_firms_move_no_block(spark, jobs, small, monkeypatch, level):
    """Where the driver holds the firms' values no round moves blocks; by buckets the results are the same."""
    monkeypatch.setattr(spread_akm, "HOT_MATCHES", 1000)
    asked = lambda: akm_kss(jobs, "y", "worker", "firm", z=["z"], level=level, leverages="exact", spread=True)
    monkeypatch.setattr(spread_akm, "MOST_VALUES", 0)
    a = asked()
    monkeypatch.setattr(spread_akm, "MOST_VALUES", 1_000_000)
    monkeypatch.setattr(spread_akm, "NODES_SENT", 4)
    monkeypatch.setattr(spread_akm.SpreadSystem, "_to_blocks", _refused)
    b = asked()
    for kind in ("plugin", "kss", "agsu"):
        assert np.allclose(list(getattr(a, kind).values()), list(getattr(b, kind).values()), rtol=1e-8), kind
    assert all(np.isclose(a.lincom[0][k], b.lincom[0][k], rtol=1e-7) for k in ("coef", "se", "se_white"))
