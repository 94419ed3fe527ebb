import math

import numpy as np
import pandas as pd
import pytest

from quadrat.functions.distributions import chi2_tail, f_tail, student_p, student_quantile
from quadrat.operators.absorb import absorb
from quadrat.operators.graph import absorbed, mobility_groups
from quadrat.operators.model import feols, fit
from quadrat.operators.sample import collapse, drop_singletons
from quadrat.plans.formula import parse


def panel(n=600):
    i = np.arange(n)
    firm, year = i % 60 + 1, (i // 60) % 10 + 1
    x1, x2 = np.sin((i + 1) / 7), np.cos((i + 1) / 11)
    y = 1 + 0.7 * x1 - 0.3 * x2 + firm / 20 + year / 9 + np.sin((i + 1) / 13) / 10
    return pd.DataFrame({"firm": firm, "year": year, "x1": x1, "x2": x2, "y": y, "w": i % 3 + 1})


def dummies(p, keys):
    return np.column_stack([pd.get_dummies(p[k]).to_numpy(float) for k in keys])


@pytest.mark.parametrize("keys", [["firm"], ["firm", "year"]])
def test_against_dummy_least_squares(spark, keys):
    p = panel()
    r = fit(spark.createDataFrame(p), "y", ["x1", "x2"], keys)
    z = np.column_stack([p[["x1", "x2"]], dummies(p, keys)])
    b, *_ = np.linalg.lstsq(z, p.y, rcond=None)
    u = p.y - z @ b
    assert np.allclose(r.coef[:2], b[:2], rtol=1e-8)
    rank = np.linalg.matrix_rank(z)
    v = u @ u / (600 - rank) * np.linalg.pinv(z.T @ z)[:2, :2]
    assert r.df_resid == 600 - rank
    assert np.allclose(r.vcov[:2, :2], v, rtol=1e-6)


def test_frequency_weights_are_repeated_rows(spark):
    p = panel()
    a = fit(spark.createDataFrame(p), "y", ["x1", "x2"], ["firm"], weights="w", fweights=True, se_type="robust")
    b = fit(spark.createDataFrame(p.loc[p.index.repeat(p.w)]), "y", ["x1", "x2"], ["firm"], se_type="robust")
    assert np.allclose(a.coef, b.coef) and np.allclose(a.se[:2], b.se[:2]) and a.n == b.n


def test_formula(spark):
    f = parse("y ~ x1*x2 + C(g) | a^b + c[z] | d ~ q")
    assert f.x == ("x1", "x2", "x1:x2", "C(g)") and f.effects[0].keys == ("a", "b") and f.effects[1].slopes == ("z",) and f.instruments == ("q",)
    with pytest.raises(ValueError):
        parse("y ~ . | a")
    r = feols("y ~ x1 + x1:x2 | firm + year", spark.createDataFrame(panel()), clusters=["firm"], se_type="cluster")
    assert r.df_resid == 59 and r.terms == ["x1", "x1:x2", "_cons"]


def test_omitted_and_errors(spark):
    p = panel().assign(x3=lambda d: 2 * d.x1, x4=lambda d: d.firm * 1.0)
    r = fit(spark.createDataFrame(p), "y", ["x1", "x3", "x4"], ["firm"])
    assert set(r.omitted) == {"x3", "x4"} and math.isnan(r.se[1])
    with pytest.raises(ValueError):
        fit(spark.createDataFrame(p.assign(firm=-1)), "y", ["x1"], ["firm"])
    with pytest.raises(ValueError):
        fit(spark.createDataFrame(p), "y", [], ["firm"], endogenous=["x1"])


def test_chain_graph(spark):
    i = np.arange(40)
    p = pd.DataFrame({"f1": i // 2, "f2": (i + 1) // 2, "x": np.cos(i / 5)})
    p["y"] = np.sin(i / 3) + 0.2 * p.f1 - 0.1 * p.f2
    out, told = absorb(spark.createDataFrame(p), ["y"], ["f1", "f2"])
    z = dummies(p, ["f1", "f2"])
    u = p.y - z @ np.linalg.lstsq(z, p.y, rcond=None)[0]
    assert told["certified"] and np.allclose(sorted(out.toPandas().y_tilde), sorted(u), atol=1e-8)


def test_graph_and_sample(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12), (4, 12), (5, 13)], "a long, b long")
    assert dict(mobility_groups(df, "a", "b").collect()) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert absorbed(df, ["a", "b"])["redundant"][1] == 3
    assert drop_singletons(df, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        collapse(df, "a", ["b"])


def test_distributions():
    assert student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert student_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert f_tail(4.0, 2, 10) == pytest.approx(1.8**-5, abs=1e-12)
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_distributions_of_arrays():
    """Arrays give what their values give one by one, in far fewer steps; a quantile ends where halving does."""
    import time

    from quadrat.functions import distributions as m

    g = np.random.default_rng(3)
    x, n, u = np.concatenate([[0.0, -1.0], g.exponential(3, 300)]), g.integers(1, 60, 302).astype(float), np.concatenate([[0.5, 0.01], g.random(300)])
    for k in (1, 2, 4, 7):
        assert np.allclose(m.student_ps(x, k), [student_p(v, k) for v in x], rtol=1e-13, atol=1e-15)
        assert np.allclose(m.chi2_tails(x, k), [chi2_tail(v, k) for v in x], rtol=1e-13, atol=1e-15)
    assert np.allclose(m.f_tails(x, 2, n), [f_tail(v, 2, d) for v, d in zip(x, n, strict=True)], rtol=1e-13, atol=1e-15)
    assert np.allclose(m.student_quantiles(u, n), [student_quantile(v, d) for v, d in zip(u, n, strict=True)], rtol=1e-12, atol=1e-14)
    begin = time.perf_counter()
    m.student_quantiles(g.random(20_000), 1.0)
    assert time.perf_counter() - begin < 20
