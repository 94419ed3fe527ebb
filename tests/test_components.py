"""Standard errors of variance components against dense matrices, quantile groups, local surfaces, frequency weights."""

import math

import numpy as np
import pandas as pd
import pytest

from quadrat.functions.distributions import splitmix64
from quadrat.operators.akm import akm_kss, lowess, quantile_groups, sign_rows, sign_sums, subsampling


def panel():
    g = np.random.default_rng(5)
    rows = []
    for worker in range(60):
        for _ in range(int(g.integers(2, 7))):
            firm = int(g.integers(0, 7))
            rows.append((worker, firm, g.normal() + 0.3 * firm + 0.05 * worker))
    return pd.DataFrame(rows, columns=["w", "f", "y"]).sort_values(["w", "f"], ignore_index=True)


def dense(p, by_match):
    """The same estimate from whole matrices: rows in order of worker and firm."""
    n, d = len(p), pd.get_dummies(p.w).to_numpy(float)
    f = pd.get_dummies(p.f).to_numpy(float)
    x = np.column_stack([d, f[:, :-1]])
    inner = np.linalg.inv(x.T @ x)
    b = inner @ x.T @ p.y
    centre = np.eye(n) - 1 / n
    part = {"var_psi": (np.column_stack([0 * d, f[:, :-1]]),) * 2, "var_alpha": (np.column_stack([d, 0 * f[:, :-1]]),) * 2}
    part["cov_alpha_psi"] = part["var_alpha"][0], part["var_psi"][0]
    match = p.groupby(["w", "f"]).ngroup().to_numpy()
    block = match[:, None] == match[None] if by_match else np.eye(n, dtype=bool)
    hat = x @ inner @ x.T
    stays = p.groupby("w").f.transform("nunique").to_numpy() < 2
    out = {}
    for name, (u, v) in part.items():
        a = (u.T @ centre @ v + v.T @ centre @ u) / 2
        whole = x @ inner @ a @ inner @ x.T
        t = np.bincount(match)[match]
        base = np.diag(whole).copy()
        lev = np.diag(hat).copy()
        if by_match or name != "var_alpha":
            base[stays] = 0.0
        else:
            first = {}
            for k in np.flatnonzero(stays):
                if t[k] > 1:
                    first.setdefault(t[k], base[k])
            base[stays] = [first.get(x, 0.0) for x in t[stays]]
        lev[stays] = 1 / np.bincount(p.w)[p.w][stays]
        lam_b, lam_p = np.where(block, base[:, None], 0.0), np.where(block, lev[:, None], 0.0)
        eta = p.y.to_numpy() - hat @ p.y
        left = np.eye(n) - lam_p
        # singular blocks (stayers at match level) take the least solution, whose residuals are their own
        turn = np.linalg.pinv(left, rcond=1e-9) if by_match else np.linalg.inv(left)
        eta_h = np.where(stays & by_match, eta, turn @ eta)
        raw = p.y.to_numpy() * eta_h
        theta = (b @ a @ b - p.y @ lam_b @ eta_h) / n
        out[name] = theta, raw, base, lev, lam_b, turn, eta_h, a, inner, x, hat, b
    return out


@pytest.mark.parametrize("level", ["match", "obs"])
def test_component_errors(spark, level):
    p = panel()
    by_match = level == "match"
    r = akm_kss(spark.createDataFrame(p), "y", "w", "f", level=level, leverages="exact", errors=True, error_draws=400)
    kept = r.rows.select("worker", "firm", "y").toPandas().rename(columns={"worker": "w", "firm": "f"}).sort_values(["w", "f"], ignore_index=True)
    kept["w"] = kept.w.factorize(sort=True)[0]
    kept["f"] = kept.f.factorize(sort=True)[0]
    n = len(kept)
    assert set(r.errors) == {"var_psi", "cov_alpha_psi"} | (set() if by_match else {"var_alpha"})
    for name, (theta, raw, base, lev, lam_b, turn, eta_h, a, inner, x, hat, b) in dense(kept, by_match).items():
        if name not in r.errors:
            continue
        got, se = r.errors[name]
        assert math.isclose(got, theta, rel_tol=1e-7)
        snap = lambda v: v.astype(np.float32).astype(float)
        ones = np.ones(n)
        cell = quantile_groups(snap(np.round(base, 14)), ones, 1000) * 1001 + quantile_groups(snap(np.round(lev, 14)), ones, 1000)
        spread = pd.Series(raw).groupby(cell).transform("mean").to_numpy()
        row = x @ inner @ a @ b
        ydx = turn @ lam_b @ kept.y if by_match else lam_b @ kept.y / (1 - lev)
        wide = row - 0.5 * (lam_b @ eta_h + ydx - hat @ ydx)
        total = (wide**2 * spread).sum()
        # the form of errors alone has variance 2 tr((Q S)^2)
        q = x @ inner @ a @ inner @ x.T - lam_b @ turn @ (np.eye(n) - hat)
        q = (q + q.T) / 2
        s = np.sqrt(np.abs(spread))
        inside = s[:, None] * q * s[None]
        below = 2 * (inside * inside).sum() if (spread >= 0).all() else None
        if below is not None:
            assert math.isclose(se, math.sqrt(max(4 * total - below, 0)) / n, rel_tol=0.12)
        assert se >= 0 and math.isfinite(se)


def test_quantile_groups():
    g = np.random.default_rng(2)
    x, w = g.integers(0, 30, 80).astype(float), g.integers(1, 4, 80)
    every = np.sort(np.repeat(x, w))
    n = len(every)
    cuts = []
    for i in range(1, 10):
        q = i * (n + 1) / 10
        k = min(max(int(q), 1), n - 1)
        cuts.append((1 - (q - int(q))) * every[k - 1] + (q - int(q)) * every[k])
    assert quantile_groups(x, w, 10).tolist() == [sum(c <= v for c in cuts) for v in x]


def test_lowess_is_exact_on_a_plane():
    g = np.random.default_rng(3)
    a, b = g.normal(size=(2, 60))
    assert np.allclose(lowess(a, b, 2 + a - 3 * b, np.ones(60)), 2 + a - 3 * b)


def test_frequency_weights(spark):
    p = panel()
    p["k"] = 1 + np.arange(len(p)) % 3
    whole = p.loc[p.index.repeat(p.k)].drop(columns="k")
    a = akm_kss(spark.createDataFrame(p), "y", "w", "f", leverages="exact", weights="k")
    b = akm_kss(spark.createDataFrame(whole), "y", "w", "f", leverages="exact")
    assert a.n == b.n and all(math.isclose(a.kss[k], b.kss[k], rel_tol=1e-9) for k in a.kss) and math.isclose(a.var_y, b.var_y)
    with pytest.raises(ValueError):
        akm_kss(spark.createDataFrame(p), "y", "w", "f", weights="k", errors=True)


def test_eigen_shares(spark):
    p = panel()
    r = akm_kss(spark.createDataFrame(p), "y", "w", "f", leverages="exact", eigen=True)
    kept = r.rows.select("worker", "firm", "y").toPandas().rename(columns={"worker": "w", "firm": "f"}).sort_values(["w", "f"], ignore_index=True)
    kept["w"], kept["f"] = kept.w.factorize(sort=True)[0], kept.f.factorize(sort=True)[0]
    for name, (*_, a, inner, x, hat, b) in dense(kept, True).items():
        whole = x @ inner @ a @ inner @ x.T
        e = np.linalg.eigvalsh((whole + whole.T) / 2)
        e = e[np.argsort(-np.abs(e))]
        got = r.eigen[name]
        assert np.allclose(got["values"], e[:3], rtol=1e-6) and math.isclose(got["trace"], (e**2).sum(), rel_tol=0.25)


def test_keyed_signs():
    """Against the generator in plain Python."""

    def stream(seed, draw, unit):
        s = splitmix64(seed ^ (0xA24BAED4963EE407 * (draw + 1)) % 2**64)
        return splitmix64(s ^ (0x9FB21C651E98DF25 * (unit + 1)) % 2**64)

    rows = sign_rows(9, 6, 150)
    assert rows.tolist() == [1.0 if stream(9, 6, i // 64) >> (i % 64) & 1 else -1.0 for i in range(150)]
    counts = np.array([0, 1, 5, 63, 64, 65, 200])
    wanted = []
    for unit, n in enumerate(counts.tolist()):
        state, total = stream(9, 7, unit), 0
        while n > 0:
            state = splitmix64(state)
            k = min(n, 64)
            total += 2 * (state & ((1 << k) - 1)).bit_count() - k
            n -= k
        wanted.append(total)
    assert sign_sums(9, 7, counts).tolist() == wanted


def test_subsampling_draws(spark):
    p = panel()
    df = spark.createDataFrame(p)
    got = subsampling(df, "y", "w", "f", fractions=[0.0, 0.2], reps=2, seed=4, leverages="exact")
    assert [(r["fraction"], r["rep"]) for r in got] == [(0.0, 0), (0.2, 0), (0.2, 1)]
    whole = akm_kss(df, "y", "w", "f", leverages="exact")
    assert got[0]["n"] == whole.n and math.isclose(got[0]["kss_var_psi"], whole.kss["var_psi"], rel_tol=1e-9)
    assert got[1]["movers"] < got[0]["movers"] and got[1]["kss_var_psi"] != got[2]["kss_var_psi"]
