"""Inference options, identification checks, graph profiles and grammar, on small panels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.operators.resample import bootstrap
from quadrat.operators.graph import largest_pair, mobility_profile
from quadrat.operators.model import UNAVAILABLE, clamped, feols, fit, small_sample
from quadrat.plans.formula import Effect, parse


def panel(n=240):
    i = np.arange(n)
    g = np.random.default_rng(1)
    x, z = g.normal(size=(2, n))
    return pd.DataFrame({"firm": i % 24, "year": i // 24, "x": x, "z": z, "y": 1e6 + x - z + i % 24 + g.normal(size=n), "w": i % 3 + 1})


def test_constant_matches_a_regression_with_dummies(spark):
    """The recovered constant is the mean prediction, so its variance is that of the dummies' weighted mean and the slopes."""
    p = panel()
    r = fit(spark.createDataFrame(p), "y", ["x", "z"], ["firm"])
    d = pd.get_dummies(p.firm).to_numpy(float)
    full = np.column_stack([p[["x", "z"]], d])
    b, *_ = np.linalg.lstsq(full, p.y, rcond=None)
    u = p.y - full @ b
    v = u @ u / (len(p) - full.shape[1]) * np.linalg.inv(full.T @ full)
    c = np.append([0, 0], d.mean(0))
    assert math.isclose(r.coef[2], c @ b, rel_tol=1e-9) and math.isclose(r.se[2], math.sqrt(c @ v @ c), rel_tol=1e-6)
    assert math.isclose(r.r2, 1 - u @ u / ((p.y - p.y.mean()) ** 2).sum(), rel_tol=1e-9)  # a large mean cancels nothing


@pytest.mark.parametrize("text", ["K.adj=1 K.fixef=nonnested G.df=min", "K.exact=no, t.df=12"])
def test_small_sample_text(text):
    told = small_sample(text)
    assert told["g_adj"] and told["k_fixef"] in (None, "nonnested") and (told["t_df"] == 12) == ("t.df" in text)
    for bad in ("K.fixef=some", "X.y=1", "K.adj=perhaps"):
        with pytest.raises(ValueError):
            small_sample(bad)


def test_unavailable_inference(spark):
    p = panel(24).assign(one=1)
    df = spark.createDataFrame(p)
    for r in (fit(df, "y", ["x"], ["firm"], drop_singletons_=False), fit(df, "y", ["x"], clusters=["one"], se_type="cluster")):
        assert not r.available and np.isnan(r.se).all() and (np.diag(r.vcov) == UNAVAILABLE).all()
        assert all(math.isnan(t["p"]) for t in r.tidy())


def test_omitted_and_priority(spark):
    df = spark.createDataFrame(panel().assign(twice=lambda p: 2 * p.x))
    r = fit(df, "y", ["x", "twice", "z"], ["firm"])
    assert r.omitted == {"twice": "collinear"} and r.coef[1] == 0 and np.isnan(r.se[1]) and (r.vcov[1] == 0).all()
    r = fit(df, "y", ["x", "twice", "z"], ["firm"], collinear_priority=["twice"])
    assert r.omitted == {"x": "collinear"} and r.supported_stats() and r.stat("N") == 240 and r.fixef_string == "firm" and r.depvar == "y"


def test_identification(spark):
    df = spark.createDataFrame(panel().assign(v=lambda p: p.x + 0.1 * p.z, flat=lambda p: p.firm * 1.0, dull=lambda p: 2 * p.w))
    assert feols("y ~ w | firm | x ~ z + v", df).iv["overidentified"] == 1
    for formula in ("y ~ 1 | firm | x ~ flat", "y ~ w | firm | x ~ dull"):
        with pytest.raises(ValueError, match="under-identified"):
            feols(formula, df)


def test_weights_by_kind(spark):
    df = spark.createDataFrame(panel())
    a, p, i = (fit(df, "y", ["x"], ["firm"], weights="w", weight_kind=k) for k in "api")
    assert np.allclose(a.coef, p.coef) and p.vce == "robust" and a.vce == "unadjusted" and i.n == 480 and a.n == 240
    with pytest.raises(ValueError):
        fit(df, "y", ["x"], weight_kind="p")


def test_tolerance_modes(spark):
    df = spark.createDataFrame(panel())
    for mode in ("comparable", "fast", "strict-residual"):
        assert fit(df, "y", ["x"], ["firm", "year"], tolerance_mode=mode).absorption["certified"]
    with pytest.raises(ValueError):
        fit(df, "y", ["x"], [Effect(("firm",), ("z",))], tolerance_mode="strict-residual")
    with pytest.raises(ValueError):
        fit(df, "y", ["x"], ["firm", "year"], tolerance_mode="some")


def test_clamp():
    v = np.array([[1.0, 2.0], [2.0, 1.0]])
    fixed = clamped(v, np.array([1.0, 1.0]))
    assert np.allclose(fixed, 1.5) and clamped(np.eye(2), np.ones(2)) is None
    assert not np.allclose(clamped(v, np.array([1.0, 3.0])), fixed)


def test_profile_and_pair(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (3, 3)], "a int, b int").withColumn("c", F.lit(0))
    assert mobility_profile(df, "a", "b") == {"components": 2, "largest_share": 0.6, "largest_weight_share": 0.6, "class": "moderate"}
    assert largest_pair(df, ["c", "a", "b"]) == ("a", "b")


def test_effect_grammar():
    assert parse("y ~ x | a#b + f##c.z + g#c.(u v)").effects == (Effect(("a", "b")), Effect(("f",), ("z",)), Effect(("g",), ("u", "v"), False))


def test_aliases(spark):
    r = fit(spark.createDataFrame(panel()), "y", ["x"], ["firm", "year"], retain_fes=True, aliases=["of_firm"])
    assert {"of_firm", "fe2"} <= set(r.fixef().columns)
    with pytest.raises(ValueError):
        bootstrap(spark.createDataFrame(panel()), "firm", vce="robust", y="y", x1=["x"], groups={"z": ["z"]})


def test_powers_and_category_products(spark):
    assert parse("y ~ (a + b + c)**2").x == ("a", "b", "c", "a:b", "a:c", "b:c") and parse("y ~ x**2 + i.g + c.z:x").x == ("x", "C(g)", "z:x")
    p = panel().assign(g=lambda p: (p.firm % 3).astype(str))
    df = spark.createDataFrame(p)
    r = feols("y ~ x + C(g) + C(g):x", df)
    assert r.terms == ["x", "g[1]", "g[2]", "g[1]:x", "g[2]:x", "_cons"]
    d = pd.get_dummies(p.g).to_numpy(float)
    z = np.column_stack([p.x, d[:, 1], d[:, 2], d[:, 1] * p.x, d[:, 2] * p.x, np.ones(len(p))])
    assert np.allclose(r.coef, np.linalg.lstsq(z, p.y, rcond=None)[0])
    full = feols("y ~ i.g:x", df)  # without x by itself all levels get a slope
    assert full.terms == ["g[0]:x", "g[1]:x", "g[2]:x", "_cons"] and not full.omitted


def test_shared_work(spark, monkeypatch):
    """Fits that differ in their inference absorb once and give what each gives alone; other columns or effects are absorbed anew."""
    from quadrat.operators import model

    g = np.random.default_rng(12)
    df = spark.createDataFrame([(int(a), int(b), float(x), float(y)) for a, b, x, y in zip(g.integers(0, 9, 90), g.integers(0, 6, 90), g.normal(size=90), g.normal(size=90), strict=True)], "firm long, year long, x double, y double")
    calls, plain = [], model.absorb
    monkeypatch.setattr(model, "absorb", lambda *a, **k: calls.append(1) or plain(*a, **k))
    asked = [{"se_type": "cluster", "clusters": ["year"]}, {"se_type": "cluster", "clusters": ["year"], "ssc": "K.adj=0"}, {}, {"se_type": "robust"}]
    work = {}
    shared = [fit(df, "y", ["x"], ["firm"], work=work, **o) for o in asked]
    assert len(calls) == 1
    for a, o in zip(shared, asked, strict=True):
        b = fit(df, "y", ["x"], ["firm"], **o)
        assert np.allclose(a.coef, b.coef, rtol=1e-12) and np.allclose(a.vcov, b.vcov, rtol=1e-12) and a.dof == b.dof
    calls.clear()
    fit(df, "y", ["x"], ["year"], work=work)
    assert len(calls) == 1


def test_one_effect_recovered(spark):
    """One effect's levels are means, without a solver, and the rows don't keep what was subtracted."""
    from quadrat.operators.absorb import absorb

    df = spark.createDataFrame([(i % 7, float(i * i % 31), 1.0 + i % 3) for i in range(70)], "firm long, y double, w double")
    out, how = absorb(df, ["y"], ["firm"], "w", effects=True, lean=True)
    assert how["method"] == "means" and "y" not in out.columns
    want = {r.firm: r.m for r in df.groupBy("firm").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).collect()}
    assert all(abs(r.y_const - want[r.firm]) < 1e-12 for r in how["terms"][0].collect()) and all(abs(r.y_fe1 - want[r.firm]) < 1e-12 for r in out.collect())
