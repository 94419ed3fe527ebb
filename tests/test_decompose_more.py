"""Absorbed targets, sample hashes, weighted bootstraps, caches and options of a fit."""

import numpy as np
import pandas as pd
import pytest

from quadrat.functions.tables import records
from quadrat.operators.absorb import absorb, absorb_cached
from quadrat.operators.decompose import decompose, sample_hash
from quadrat.operators.resample import bootstrap
from quadrat.operators.model import fit


def panel(n=400):
    g = np.random.default_rng(7)
    i = np.arange(n)
    worker = i % 50
    group = (worker < 20) * 1.0
    x, z = g.normal(size=(2, n))
    return pd.DataFrame({"at": i, "worker": worker, "group": group, "x": x + group, "z": z + 0.3 * x, "y": 2 * group + x - z + worker / 10 + g.normal(size=n), "w": 1.0 + i % 3})


def test_absorbed_target(spark):
    p = panel()
    df = spark.createDataFrame(p)
    with pytest.raises(ValueError, match="not identified"):
        decompose(df, "y", ["group", "x"], {"z": ["z"]}, fes=["worker"])
    r = decompose(df, "y", ["group", "x"], {"z": ["z"]}, fes=["worker"], vce="cluster", clusters=["worker"], absorbed_targets=["group"])
    base = np.linalg.lstsq(np.column_stack([p.group, p.x, np.ones(len(p))]), p.y, rcond=None)[0]
    d = pd.get_dummies(p.worker).to_numpy(float)
    b = np.linalg.lstsq(np.column_stack([p.x, p.z, d]), p.y, rcond=None)[0]
    side = lambda v: np.linalg.lstsq(np.column_stack([p.group, p.x, np.ones(len(p))]), v, rcond=None)[0][:2]
    assert np.allclose(r.base, base[:2]) and r.full[0] == 0 and np.isclose(r.full[1], b[0])
    assert np.allclose(r.delta[0], side(b[1] * p.z)) and np.allclose(r.delta[1], side(d @ b[2:])) and r.identity_gap < 1e-8
    assert np.isclose(r.total_cov[0, 0], r.base_cov[0, 0]) and r.diagnostics["imposed_zero"] == ["group"]
    told = decompose(df, "y", ["group", "x"], {"z": ["z"]}, fes=["worker"], absorbed_targets=["group"])
    assert np.isnan(told.cov[0, 0]) and not np.isnan(told.cov[1, 1]) and records(told)[0]["se"] is None
    for bad in (["x"], ["none"]):
        with pytest.raises(ValueError):
            decompose(df, "y", ["group", "x"], {"z": ["z"]}, fes=["worker"], absorbed_targets=bad)


def test_sample_hash(spark):
    def plain(data):
        h = 14695981039346656037
        for b in data:
            h = ((h ^ b) * 1099511628211) % 2**64
        return f"{h:016x}"

    df = spark.createDataFrame([(3,), (1,), (300,)], "at long")
    wanted = plain(b"mine" + b"".join(x.to_bytes(8, "little") for x in (9, 3, 1, 3, 300)))
    assert sample_hash(9, df, "mine") == wanted
    r = decompose(spark.createDataFrame(panel()), "y", ["x"], {"z": ["z"]}, position="at")
    assert r.diagnostics["sample_hash"] == plain(b"quadrat-sample-v1" + b"".join(x.to_bytes(8, "little") for x in (400, 400, *range(400))))


def test_weighted_bootstrap(spark):
    got = bootstrap(spark.createDataFrame(panel(120)), "worker", reps=10, y="y", x1=["x"], groups={"z": ["z"]}, weights="w")
    assert got[0]["valid"] == 10 and got[0]["low"] <= got[0]["delta"] + 0.5 and got[0]["se"] > 0


def test_cached_absorption(spark, tmp_path):
    df = spark.createDataFrame(panel())
    want, _ = absorb(df, ["y"], ["worker", "w"])
    with pytest.raises(FileNotFoundError):
        absorb_cached(df, ["y"], ["worker", "w"], folder=str(tmp_path), mode="read")
    one, how = absorb_cached(df, ["y"], ["worker", "w"], folder=str(tmp_path))
    two, again = absorb_cached(df.repartition(3), ["y"], ["worker", "w"], folder=str(tmp_path), mode="read")
    assert how["method"] == "levels" and again["method"] == "cache"
    values = lambda d: sorted(round(r.y_tilde, 9) for r in d.collect())
    assert values(one) == values(two) == values(want)
    assert absorb_cached(df, ["x"], ["worker"], folder=str(tmp_path))[1]["method"] != "cache"


def test_options_of_a_fit(spark):
    df, said = spark.createDataFrame(panel()), []
    fit(df, "y", ["x"], ["worker"], progress=said.append, threads=4, convergence="both")
    assert len(said) == 2
    with pytest.raises(ValueError):
        fit(df, "y", ["x"], backend="cuda")
