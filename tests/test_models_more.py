"""Slopes, retained effects, groups, decompositions, worker-firm components and tables, against dense algebra."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions.tables import model_table, parts_table, render
from quadrat.operators import absorb as absorb_module
from quadrat.operators.absorb import absorb
from quadrat.operators.akm import akm_kss, bipartite, cut_workers, leave_out_csv, leave_out_set, subsampling
from quadrat.operators.decompose import decompose
from quadrat.operators.resample import bootstrap
from quadrat.operators.groups import fit_groups
from quadrat.operators.model import feols, fit, partial_out, prepare_formula
from quadrat.plans.formula import Effect


def panel(n=300, seed=3):
    g = np.random.default_rng(seed)
    p = pd.DataFrame({"a": g.integers(0, 12, n), "b": g.integers(0, 7, n), "z": g.normal(size=n), "w": g.integers(1, 4, n).astype(float)})
    p["x1"] = g.normal(size=n) + p.a / 10
    p["x2"] = 0.4 * p.x1 + g.normal(size=n)
    p["x3"] = -0.3 * p.x1 + g.normal(size=n)
    p["y"] = p.x1 + 0.5 * p.x2 - 0.7 * p.x3 + 0.1 * p.a * p.z + p.b / 5 + g.normal(size=n)
    return p


def dummies(p, k):
    return pd.get_dummies(p[k]).to_numpy(float)




@pytest.mark.parametrize("fes", [[Effect(("a",), ("z",))], [Effect(("a",), ("z",), False)], [Effect(("a",), ("z",)), "b"]])
def test_slopes(spark, fes):
    p = panel()
    r = fit(spark.createDataFrame(p), "y", ["x1", "x2"], fes)
    blocks = [p[["x1", "x2"]].to_numpy()]
    for e in fes:
        e = e if isinstance(e, Effect) else Effect((e,))
        d = dummies(p, e.keys[0])
        blocks += [d] * e.intercept + [d * p[[s]].to_numpy() for s in e.slopes]
    z = np.column_stack(blocks)
    b, *_ = np.linalg.lstsq(z, p.y, rcond=None)
    u = (p.y - z @ b).to_numpy()
    rank = np.linalg.matrix_rank(z)
    assert np.allclose(r.coef[:2], b[:2], rtol=1e-8) and r.df_resid == len(p) - rank
    assert np.allclose(r.vcov[:2, :2], u @ u / (len(p) - rank) * np.linalg.pinv(z.T @ z)[:2, :2], rtol=1e-6)


def test_sweeps_and_formula_slopes(spark, monkeypatch):
    p = panel(120)
    df = spark.createDataFrame(p)
    want = fit(df, "y", ["x1"], [Effect(("a",), ("z",)), "b"])
    got = feols("y ~ x1 | a[z] + b", df)
    assert np.allclose(want.coef, got.coef)
    monkeypatch.setattr(absorb_module, "MOST_CELLS", 1)
    out, told = absorb(df, ["y"], ["a", "b"])
    assert told["method"] == "spread levels" and told["certified"]
    z = np.column_stack([dummies(p, "a"), dummies(p, "b")])
    u = p.y - z @ np.linalg.lstsq(z, p.y, rcond=None)[0]
    assert np.allclose(sorted(out.toPandas().y_tilde), sorted(u), atol=1e-6)
    spread = fit(df, "y", ["x1"], [Effect(("a",), ("z",)), "b"], retain_fes=True)
    assert np.allclose(want.coef, spread.coef) and np.allclose(want.vcov, spread.vcov) and spread.absorption["method"] == "spread levels"
    t = spread.fixef().toPandas()
    assert np.allclose(t.fe1 + t.fe2 + t.x1 * spread.coef[0] + spread.coef[1], t["__y"] - t["__u"], atol=1e-7)


def test_retained_effects_and_predictions(spark):
    p = panel()
    r = fit(spark.createDataFrame(p), "y", ["x1"], ["a", "b"], retain_fes=True)
    t = r.fixef().toPandas()
    assert np.allclose(t.fe1 + t.fe2 + t.x1 * r.coef[0] + r.coef[1], t["__y"] - t["__u"], atol=1e-8)
    assert abs(t.fe1.mean()) < 1e-10 and t.groupby("a").fe1.std().max() < 1e-10
    d = r.predict("dresiduals").toPandas()
    assert np.allclose(d.dresiduals, d["__y"] - d.x1 * r.coef[0] - r.coef[1])
    assert math.isfinite(r.ll) and r.information()["df"] == 1 + r.df_absorbed and r.r2_adj < r.r2
    assert r.summarize().count() == 2
    own = r.sample.select("a", "b", "x1", F.col("__y").alias("y"))
    for kind in ("xb", "stdp", "xbd", "d"):
        old, new = (np.sort(x.toPandas()[kind]) for x in (r.predict(kind), r.predict(kind, own.withColumn(kind, F.lit("x")))))
        assert np.allclose(old, new, atol=1e-8), kind
    strange = r.predict("xbd", own.limit(3).withColumn("a", F.lit(987_654_321)))
    assert strange.where("xbd IS NULL").count() == 3
    with pytest.raises(ValueError):
        r.predict("residuals", own)
    assert partial_out(spark.createDataFrame(p), ["y"], ["a", "b"], drop_singletons_=True).count() == len(p)


@pytest.mark.parametrize("aggregation", ["mean", "sum"])
def test_groups_and_individuals(spark, aggregation):
    i = np.arange(500)
    patent, inventor = i // 5 + 1, i % 80 + 1
    p = pd.DataFrame({"patent": patent, "inventor": inventor, "year": (patent - 1) % 10 + 1, "funding": (patent * 17) % 31 / 10})
    p["cites"] = 2 + 0.4 * p.funding + p.patent / 100 + p.year / 8 + np.sin(p.patent)
    df = spark.createDataFrame(p)
    one = p.drop_duplicates("patent")
    plain = fit_groups(df, "cites", ["funding"], "patent", ["year"])
    assert plain.n == 100 and np.allclose(plain.coef, fit(spark.createDataFrame(one), "cites", ["funding"], ["year"]).coef)
    r = fit_groups(df, "cites", ["funding"], "patent", ["year"], individual="inventor", aggregation=aggregation)
    bridge = pd.crosstab(p.patent, p.inventor).to_numpy(float)
    z = np.column_stack([one.funding, bridge / (bridge.sum(1, keepdims=True) if aggregation == "mean" else 1), dummies(one, "year")])
    b, *_ = np.linalg.lstsq(z, one.cites, rcond=None)
    u = one.cites - z @ b
    assert r.coef[0] == pytest.approx(b[0], rel=1e-7) and r.rss == pytest.approx(u @ u, rel=1e-7)
    assert r.absorption["individual"].count() == 80
    with pytest.raises(ValueError):
        fit_groups(df, "inventor", ["funding"], "patent")


def test_decomposition_without_effects(spark):
    p = panel()
    p["cl"] = p.a
    groups = {"g2": ["x2"], "g3": ["x3", "z"]}
    df = spark.createDataFrame(p)
    d = decompose(df, "y", ["x1"], groups)
    n = len(p)
    x1, x2 = np.column_stack([p.x1, np.ones(n)]), p[["x2", "x3", "z"]].to_numpy()
    z = np.column_stack([p.x1, x2, np.ones(n)])
    b = np.linalg.lstsq(z, p.y, rcond=None)[0]
    base = np.linalg.lstsq(x1, p.y, rcond=None)[0]
    gam = np.linalg.lstsq(x1, x2, rcond=None)[0]
    delta = [gam[0, 0] * b[1], gam[0, 1:] @ b[2:4]]
    assert np.allclose(d.delta[:, 0], delta) and d.identity_gap < 1e-10 and np.allclose(d.total, base[0] - b[0])
    e, free, inv, big = p.y - z @ b, n - 5, np.linalg.inv(x1.T @ x1), np.linalg.inv(z.T @ z)
    h = np.column_stack([x2[:, 0] * b[1], x2[:, 1:] @ b[2:4]])
    v = h - x1 @ np.linalg.lstsq(x1, h, rcond=None)[0]
    want = v.T @ v / free * inv[0, 0]
    vb = big[1:4, 1:4] * (e @ e) / free
    load = np.array([[gam[0, 0], 0, 0], [0, gam[0, 1], gam[0, 2]]])
    assert np.allclose(d.cov, want + load @ vb @ load.T, rtol=1e-8)
    for vce, ids in (("robust", np.arange(n)), ("cluster", p.cl.to_numpy())):
        r = decompose(df, "y", ["x1"], groups, vce=vce, clusters=["cl"] if vce == "cluster" else [])
        s = np.column_stack([z * e.to_numpy()[:, None], x1 * v[:, [0]], x1 * v[:, [1]]])
        s = np.stack([s[ids == c].sum(0) for c in np.unique(ids)])
        g = len(s)
        bread = np.zeros((9, 9))
        bread[:5, :5], bread[5:7, 5:7], bread[7:, 7:] = big, inv, inv
        c = bread @ s.T @ s @ bread
        q, own = (n / (n - 1), n / free) if vce == "robust" else (g / (g - 1), (n - 1) / free * g / (g - 1))
        part = c[1:4, [5, 7]]
        want = q * c[np.ix_([5, 7], [5, 7])] + own * load @ c[1:4, 1:4] @ load.T + q * (load @ part + (load @ part).T)
        assert np.allclose(r.cov, want, rtol=1e-7)
    assert len(d.tidy()) == 3 and d.waterfall("x1")[-2]["end"] == pytest.approx(d.full[0])
    assert d.contrast({("x1", "g2"): 1.0, ("x1", "g3"): 1.0})["value"] == pytest.approx(d.total[0])
    assert "Other (filtered)" in render(parts_table(d, keep="g2"), "latex") and render(parts_table(d), "html").count("<tr>") == 5


def test_decomposition_with_effects(spark):
    p = panel()
    df = spark.createDataFrame(p)
    d = decompose(df, "y", ["x1"], {"g2": ["x2"]}, fes=["a"], vce="cluster", clusters=["b"])
    full = np.linalg.lstsq(np.column_stack([p.x1, p.x2, dummies(p, "a")]), p.y, rcond=None)[0]
    base = np.linalg.lstsq(np.column_stack([p.x1, np.ones(len(p))]), p.y, rcond=None)[0]
    assert d.groups == ["g2", "a"] and np.allclose([d.base[0], d.full[0]], [base[0], full[0]]) and d.identity_gap < 1e-9
    c = decompose(df, "y", ["x1"], {"g2": ["x2"], "g3": ["x3"]}, fes=["a"], common_fes=["b"], weights="w")
    assert c.identity_gap < 1e-9 and np.isfinite(c.cov).all() and c.diagnostics["connectivity"] == "identified_two_way"
    with pytest.raises(ValueError):
        decompose(spark.createDataFrame(p.assign(x4=2 * p.x1)), "y", ["x1"], {"g": ["x4"]})


def test_bootstrap(spark):
    p = panel(60)
    got = bootstrap(spark.createDataFrame(p), "a", reps=3, y="y", x1=["x1"], groups={"g": ["x2"]})
    assert got[0]["valid"] == 3 and got[0]["low"] <= got[0]["high"]


def workers(n=60, firms=8, seed=5):
    g = np.random.default_rng(seed)
    w = np.repeat(np.arange(n), 4)
    f = g.integers(0, firms, 4 * n)
    f[::2] = f[1::2]
    f[w < 10] = np.repeat(np.arange(10) % firms, 4)  # stayers
    y = g.normal(0, 0.6, n)[w] + g.normal(0, 0.4, firms)[f] + g.normal(0, 0.3, 4 * n)
    return pd.DataFrame({"w": w, "f": f, "y": y, "x": g.normal(size=4 * n), "z": f * 1.0})


def dense_components(p, level):
    n = len(p)
    a, b = dummies(p, "w"), dummies(p, "f")
    x = np.column_stack([a, b[:, :-1]])
    ga, gb = a.shape[1], b.shape[1]
    coef = np.linalg.lstsq(x, p.y, rcond=None)[0]
    alpha, psi = a @ coef[:ga], b @ np.append(coef[ga:], 0)
    inv = np.linalg.inv(x.T @ x)
    pa, pb = np.column_stack([a, 0 * b[:, :-1]]), np.column_stack([0 * a, b[:, :-1]])
    pa, pb = pa - pa.mean(0), pb - pb.mean(0)
    forms = [pb.T @ pb, pa.T @ pa, (pa.T @ pb + pb.T @ pa) / 2]
    plain = np.array([psi.var(), alpha.var(), np.mean((alpha - alpha.mean()) * (psi - psi.mean()))]) * n / (n - 1)
    if level == "obs":
        lev = np.einsum("ij,jk,ik->i", x, inv, x)
        sig = (p.y - p.y.mean()) * (p.y - x @ coef) / (1 - lev)
        return plain - np.array([np.sum(np.einsum("ij,jk,ik->i", x @ inv, m, x @ inv) * sig) for m in forms]) / (n - 1)
    m = p.assign(i=np.arange(n)).groupby(["w", "f"]).agg(t=("y", "size"), y=("y", "mean"), i=("i", "first")).reset_index()
    xm, root = x[m.i], np.sqrt(m.t.to_numpy())
    yt = root * m.y
    eta = yt - root * (xm @ coef)
    lev = m.t * np.einsum("ij,jk,ik->i", xm, inv, xm)
    stays = m.groupby("w").f.transform("size") < 2
    mover = (yt - yt.mean()) * eta / np.where(stays, 1, 1 - lev)
    e = (p.y - p.y.mean()) * (p.y - x @ coef) / (1 - 1 / p.groupby("w").y.transform("size"))
    own = e.groupby([p.w, p.f]).mean().reset_index(drop=True)
    sig = np.where(stays, own, mover)
    return plain - np.array([np.sum(m.t * np.einsum("ij,jk,ik->i", xm @ inv, q, xm @ inv) * sig) for q in forms]) / (n - 1)


@pytest.mark.parametrize("level", ["match", "obs"])
def test_worker_firm_components(spark, level):
    p = workers()
    r = akm_kss(spark.createDataFrame(p), "y", "w", "f", level=level, z=["z"])
    kept = r.rows.toPandas()[["worker", "firm", "y"]].rename(columns={"worker": "w", "firm": "f"})
    assert r.leverages == "exact" and r.firms == 8
    assert np.allclose(list(r.kss.values()), dense_components(kept, level), rtol=1e-8)
    assert r.lincom[0]["se"] >= 0 and r.frame().count() == 3
    j = akm_kss(spark.createDataFrame(p), "y", "w", "f", level=level, leverages="jla", draws=400)
    assert np.allclose(list(j.plugin.values()), list(r.plugin.values())) and abs(j.kss["var_psi"] - r.kss["var_psi"]) < 0.05


def test_components_extras(spark, tmp_path):
    df = spark.createDataFrame(workers())
    r = akm_kss(df, "y", "w", "f", controls=["x"])
    r.export(str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out_effects")).count() == r.workers + r.firms
    long = bipartite(df, "y", "w", "f", ["x"])
    leave_out_csv(long, str(tmp_path / "lo"))
    assert long.agg({"t": "max"}).first()[0] == 3
    assert len(subsampling(df, "y", "w", "f", [0.2])) == 1


def test_leave_out_set(spark):
    # worker 9 alone joins two parts: without, the one with more firms stays; worker 8 has one row
    edges = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3), (4, 2), (4, 3), (9, 3), (9, 4), (5, 4), (5, 5), (6, 4), (6, 5), (7, 1), (7, 1), (8, 1)]
    df = spark.createDataFrame(edges, "w long, f long")
    got = {tuple(r) for r in leave_out_set(df, "w", "f").collect()}
    assert got == {(w, f) for w, f in edges if w in (1, 2, 3, 4, 7)}
    g = np.random.default_rng(1)
    for _ in range(20):
        w, f = (np.array(x) for x in zip(*{(int(a), int(b)) for a, b in zip(g.integers(0, 8, 14), g.integers(0, 6, 14), strict=True)}, strict=True))

        def parts(keep):
            label = {("f", x): x for x in set(f[keep].tolist())}
            for _ in range(20):
                for a in set(w[keep].tolist()):
                    low = min(label["f", x] for x in f[keep & (w == a)].tolist())
                    for x in f[keep & (w == a)].tolist():
                        label["f", x] = low
            return len(set(label.values()))

        alone = [a for a in set(w.tolist()) if (k := set(f[w != a].tolist()) >= set(f[w == a].tolist())) and parts(w != a) > parts(w == w) or (not k and (w == a).sum() > 1)]
        assert sorted(cut_workers(w, f, 8, 6).tolist()) == sorted(alone)


def test_tables(spark):
    r = fit(spark.createDataFrame(panel()), "y", ["x1", "x2"], ["a"])
    rows = model_table({"one": r}, drop="_cons")
    assert render(rows).startswith("|  | one |") and "x2" in render(rows, "csv") and len(rows) == 8
    with pytest.raises(ValueError):
        render(rows, "pdf")


def test_formula_terms_and_small_sample_options(spark):
    from pyspark.sql import functions as F

    p = panel(120)
    df = spark.createDataFrame(p)
    r = feols("y ~ x1 + I(x1**2) + exp(x2) + twice(x3) + C(b, Treatment(reference=2))", df, context={"twice": lambda c: 2 * c}, subset=F.col("a") < 10)
    q = p[p.a < 10]
    levels = [v for v in sorted(q.b.unique()) if v != 2]
    z = np.column_stack([q.x1, q.x1**2, np.exp(q.x2), 2 * q.x3, *[(q.b == v) * 1.0 for v in levels], np.ones(len(q))])
    assert r.terms[4:-1] == [f"b[{v}]" for v in levels] and np.allclose(r.coef, np.linalg.lstsq(z, q.y, rcond=None)[0])
    kept = prepare_formula("y ~ x1 | a^b", df)
    one = kept.fit(clusters=["a", "w"], se_type="cluster", na_action="omit")
    two = kept.fit(clusters=["a", "w"], se_type="cluster", ssc={"g_adj": False, "k_adj": False, "t_df": 5})
    assert np.allclose(one.coef, two.coef) and two.df_resid == 5 and two.se[0] < one.se[0]
    with pytest.raises(ValueError):
        kept.fit(ssc={"other": 1})
