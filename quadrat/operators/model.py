"""Linear models: OLS, WLS and two-stage least squares after absorption, with classical, robust and clustered inference."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_tail, student_p, student_quantile
from ..plans.formula import Effect, Formula, parse, split_top
from .absorb import absorb, as_effect, normalise
from .graph import absorbed
from .sample import check, counted, drop_singletons, keep_cut

#: Stands on the diagonal of a covariance that can't be estimated.
UNAVAILABLE = -1e-10
#: What a sweep may still move, by mode; results are solved to the same precision, and certified by it.
MODES = {"comparable": 1e-9, "fast": 1.0, "strict-residual": 1e-9}
SYNONYMS = {"homoskedastic": "unadjusted", "classical": "unadjusted", "unadj": "unadjusted", "ols": "unadjusted", "iid": "unadjusted", "hc1": "robust", "heteroskedastic": "robust", "clustered": "cluster"}


@dataclass
class Result:
    terms: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: int
    df_resid: float
    df_model: int
    df_absorbed: int
    rss: float
    tss: float
    tss_within: float
    sample: DataFrame
    absorption: dict
    dof: dict
    omitted: dict[str, str] = field(default_factory=dict)
    level: float = 0.95
    y_name: str = "y"
    fe_names: list[str] = field(default_factory=list)
    vce: str = "unadjusted"
    cluster_names: list[str] = field(default_factory=list)
    iv: dict = field(default_factory=dict)
    available: bool = True
    retained: bool = False

    @property
    def se(self) -> np.ndarray:
        """NaN for omitted terms, and for all where inference isn't available (then the covariance's diagonal is UNAVAILABLE)."""
        d = np.diag(self.vcov)
        return np.where((d > 0) & self.available, np.sqrt(np.maximum(d, 0)), np.nan)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else float("nan")

    @property
    def r2_within(self) -> float:
        return 1 - self.rss / self.tss_within if self.tss_within else float("nan")

    @property
    def rmse(self) -> float:
        return math.sqrt(self.rss / self.df_resid) if self.df_resid > 0 else float("nan")

    @property
    def r2_adj(self) -> float:
        free = self.n - self.df_model - max(self.df_absorbed, 1)
        return 1 - (1 - self.r2) * (self.n - 1) / free if free > 0 else float("nan")

    @property
    def r2_within_adj(self) -> float:
        free = self.n - self.df_model - max(self.df_absorbed, 1)
        return 1 - (1 - self.r2_within) * (free + self.df_model) / free if free > 0 else float("nan")

    def _log_likelihood(self, rss: float) -> float:
        return -0.5 * self.n * (1 + math.log(2 * math.pi) + math.log(rss / self.n)) if rss > 0 else float("nan")

    @property
    def ll(self) -> float:
        return self._log_likelihood(self.rss)

    @property
    def ll_0(self) -> float:
        return self._log_likelihood(self.tss_within)

    @property
    def saturated(self) -> bool:
        return self.df_model > 0 and self.rss <= 1e-9 * self.tss_within

    def confint(self, level: float | None = None) -> dict[str, tuple[float, float]]:
        crit = student_quantile(0.5 + (level or self.level) / 2, self.df_resid) if self.df_resid > 0 else float("nan")
        return {t: (b - crit * s, b + crit * s) for t, b, s in zip(self.terms, self.coef.tolist(), self.se.tolist(), strict=True)}

    def information(self) -> dict[str, float]:
        """Log likelihoods and information criteria; rank counts slopes and the constant or effects."""
        rank = self.df_model + max(self.df_absorbed, 1)
        return {"n": self.n, "ll_0": self.ll_0, "ll": self.ll, "df": rank, "aic": 2 * rank - 2 * self.ll, "bic": rank * math.log(self.n) - 2 * self.ll}

    def summarize(self) -> DataFrame:
        """Mean, standard deviation, least and greatest of the outcome and each regressor over the sample."""
        names = ["__y", *[t for t in self.terms if t != "_cons"]]
        row = self.sample.agg(*[f(F.col(f"`{c}`")) for c in names for f in (F.avg, F.stddev, F.min, F.max)]).first()
        return self.sample.sparkSession.createDataFrame([("y" if c == "__y" else c, *row[4 * i : 4 * i + 4]) for i, c in enumerate(names)], "variable string, mean double, sd double, least double, greatest double")

    def fixef(self) -> DataFrame:
        """The sample with fe1, fe2, ...: what each effect contributes. The model must be fit with retain_fes."""
        if not self.retained:
            raise ValueError("fit with retain_fes=True")
        return self.sample

    def tidy(self) -> list[dict]:
        crit = student_quantile(0.5 + self.level / 2, self.df_resid) if self.df_resid > 0 and self.available else float("nan")
        nan = float("nan")
        if not self.available:
            return [{"term": t, "coef": b, "se": nan, "t": nan, "p": nan, "low": nan, "high": nan} for t, b in zip(self.terms, self.coef.tolist(), strict=True)]
        return [{"term": t, "coef": b, "se": s, "t": b / s, "p": student_p(b / s, self.df_resid), "low": b - crit * s, "high": b + crit * s} for t, b, s in zip(self.terms, self.coef.tolist(), self.se.tolist(), strict=True)]

    def wald(self) -> tuple[float, float]:
        """The F statistic that all slopes are zero, and its p-value."""
        k = [i for i, t in enumerate(self.terms) if t != "_cons" and t not in self.omitted]
        f = float(self.coef[k] @ np.linalg.solve(self.vcov[np.ix_(k, k)], self.coef[k]) / len(k))
        return f, f_tail(f, len(k), self.df_resid)

    def coef_table(self) -> list[dict]:
        """Terms with estimates, standard errors, t, p and interval, for table packages."""
        return [{"term": r["term"], "b": r["coef"], "se": r["se"], "t": r["t"], "p": r["p"], "ci95l": r["low"], "ci95u": r["high"]} for r in self.tidy()]

    def supported_stats(self) -> list[str]:
        return ["N", "r2", "adj_r2", "r2_within", "adj_r2_within", "rmse", "ll", "aic", "bic", "fvalue", "se_type", "df_r", "df_a"]

    def stat(self, key: str):
        """One of supported_stats(); None for others."""
        told = {"N": lambda: self.n, "r2": lambda: self.r2, "adj_r2": lambda: self.r2_adj, "r2_within": lambda: self.r2_within, "adj_r2_within": lambda: self.r2_within_adj, "rmse": lambda: self.rmse, "ll": lambda: self.ll}
        told |= {"aic": lambda: self.information()["aic"], "bic": lambda: self.information()["bic"], "fvalue": lambda: self.wald()[0], "se_type": lambda: self.vcov_info()["label"], "df_r": lambda: self.df_resid, "df_a": lambda: self.df_absorbed}
        return told[key]() if key in told else None

    def default_stat_keys(self) -> list[str]:
        return ["N", "r2", *(["r2_within"] if self.fe_names else [])]

    def stat_labels(self) -> dict[str, str]:
        return {"N": "Observations", "r2": "R2", "adj_r2": "Adj. R2", "r2_within": "Within R2", "adj_r2_within": "Adj. within R2", "rmse": "RMSE", "ll": "Log likelihood", "aic": "AIC", "bic": "BIC", "fvalue": "F", "se_type": "S.E. type", "df_r": "Residual df", "df_a": "Absorbed df"}

    def vcov_info(self) -> dict:
        label = {"unadjusted": "iid", "robust": "robust", "cluster": "by: " + "+".join(self.cluster_names)}[self.vce]
        return {"vcov_type": self.vce, "clustervar": list(self.cluster_names), "label": label}

    @property
    def depvar(self) -> str:
        return self.y_name

    @property
    def fixef_string(self) -> str | None:
        return "+".join(self.fe_names) or None

    def var_labels(self) -> dict[str, str]:
        return {t: "Constant" if t == "_cons" else t for t in self.terms}

    def frame(self) -> DataFrame:
        rows = [(r["term"], r["coef"], r["se"], r["t"], self.n, float(self.df_resid)) for r in self.tidy()]
        return self.sample.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, n long, df_r double")

    def predict(self, kind: str = "residuals", newdata: DataFrame | None = None) -> DataFrame:
        """The sample with a column `kind`: residuals, xb, xbd (fitted with effects), d (the effects' part),
        dresiduals (residuals with effects), score or stdp (standard error of xb).

        newdata: instead its rows, with xb, stdp, xbd or d; the last two need retain_fes and effects without slopes, and
        are null where the sample doesn't have a level.
        """
        if newdata is not None and kind not in ("xb", "stdp", "xbd", "d"):
            raise ValueError(f"{kind} of new rows")
        if newdata is not None and kind in ("xbd", "d"):
            return self._effects_of(newdata, kind)
        rows = self.sample if newdata is None else newdata
        slopes = [(t, b) for t, b in zip(self.terms, self.coef.tolist(), strict=True) if t != "_cons"]
        cons = dict(zip(self.terms, self.coef.tolist(), strict=True)).get("_cons", 0.0)
        xb = sum((F.col(t) * b for t, b in slopes), F.lit(cons))
        if kind == "stdp":
            v = np.nan_to_num(self.vcov)
            named = [F.lit(1.0) if t == "_cons" else F.col(t) for t in self.terms]
            return rows.withColumn(kind, F.sqrt(sum((a * b * float(v[i, j]) for i, a in enumerate(named) for j, b in enumerate(named)), F.lit(0.0))))
        made = {"score": F.col("__u"), "dresiduals": F.col("__y") - xb, "residuals": F.col("__u"), "xb": xb, "xbd": F.col("__y") - F.col("__u"), "d": F.col("__y") - F.col("__u") - xb}[kind]
        return rows.withColumn(kind, made)

    def _effects_of(self, rows: DataFrame, kind: str) -> DataFrame:
        shown = self.fixef().columns[: len(self.fe_names)]
        if not all(k in self.sample.columns and k in rows.columns for k in self.fe_names):
            raise ValueError("effects of new rows need their keys as columns, without slopes")
        out, names = rows, list(rows.columns)
        for i, (key, effect) in enumerate(zip(self.fe_names, shown, strict=True)):
            levels = keep_cut(self.sample.groupBy(F.col(key).alias(f"__l{i}")).agg(F.first(effect).alias(f"__e{i}")))
            out = out.join(counted(levels, levels.count()), F.col(key) == F.col(f"__l{i}"), "left")
        d = sum((F.col(f"__e{i}") for i in range(len(shown))), F.lit(0.0))
        slopes = sum((F.col(t) * b for t, b in zip(self.terms, self.coef.tolist(), strict=True) if t != "_cons"), F.lit(dict(zip(self.terms, self.coef.tolist(), strict=True)).get("_cons", 0.0)))
        return out.select(*[F.col(f"`{c}`") for c in names if c != kind], (d + slopes if kind == "xbd" else d).alias(kind))


def moments(df: DataFrame, columns: list[str], weight: F.Column) -> np.ndarray:
    """The weighted cross products of the columns, in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(weight * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def meat(df: DataFrame, scores: list[str], by: list[str] | None) -> tuple[np.ndarray, int]:
    """The sum of outer products of scores, of rows or of the sums in each cluster, and the number of clusters."""
    if by is None:
        return moments(df, scores, F.lit(1.0)), 0
    sums = df.groupBy(*by).agg(*[F.sum(s).alias(s) for s in scores])
    pairs = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    row = sums.agg(F.count(F.lit(1)), *[F.sum(F.col(scores[i]) * F.col(scores[j])) for i, j in pairs]).first()
    out = np.zeros((len(scores), len(scores)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v
    return out, row[0]


def multiway(df: DataFrame, scores: list[str], clusters: list[str], each: bool = False) -> tuple[np.ndarray, int]:
    """Sums over all non-empty sets of cluster variables, with alternating signs; and the least number of clusters.

    each: every set's sum is scaled by its own G / (G - 1).
    """
    total, least = np.zeros((len(scores), len(scores))), None
    for n in range(1, len(clusters) + 1):
        for some in combinations(clusters, n):
            part, g = meat(df, scores, list(some))
            total += (-1) ** (n + 1) * part * (g / (g - 1) if each and g > 1 else 1.0)
            least = g if least is None or (n == 1 and g < least) else least
    return total, least


def kept_columns(gram: np.ndarray, raw: np.ndarray, tol: float = 1e-6, left: np.ndarray | None = None, order: list[int] | None = None) -> tuple[list[int], dict[int, str]]:
    """Columns kept, in their order; dropped: those the effects explain, and those that kept columns do.

    raw and left: squares of the columns before and after absorption, by default gram's. order: which come first; the rest go from the left.
    """
    left = np.diag(gram) if left is None else left
    keep: list[int] = []
    out: dict[int, str] = {}
    for j in [*(order or []), *(k for k in range(len(gram)) if k not in (order or []))]:
        if left[j] <= 1e-9 * raw[j]:
            out[j] = "explained by the effects"
            continue
        rest = gram[j, j]
        if keep:
            b = np.linalg.solve(gram[np.ix_(keep, keep)], gram[keep, j])
            rest -= b @ gram[keep, j]
        if rest <= tol**2 * gram[j, j]:
            out[j] = "collinear"
        else:
            keep.append(j)
    return sorted(keep), out


def small_sample(told: dict | str | None) -> dict:
    """The small-sample options, from a dict or a text like "K.adj=1 K.fixef=nonnested G.df=min"."""
    options = {"k_adj": True, "k_fixef": None, "k_exact": True, "g_adj": True, "g_df": "min", "t_df": None}
    if isinstance(told, str):
        flags = {"": True, "1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
        given = {}
        for part in told.replace(",", " ").split():
            name, _, value = part.lower().partition("=")
            name = name.replace(".", "_")
            if name in ("k_adj", "k_exact", "g_adj"):
                if value not in flags:
                    raise ValueError(f"small-sample option {part!r}")
                given[name] = flags[value]
            elif name == "k_fixef":
                given[name] = {"true": "full", "yes": "full", "false": "none", "no": "none"}.get(value, value)
            elif name == "t_df":
                given[name] = float(value)
            else:
                given[name] = value
        told = given
    options |= told or {}
    if len(options) > 6 or options["g_df"] not in ("min", "conventional") or options["k_fixef"] not in (None, "full", "nonnested", "none"):
        raise ValueError(f"small-sample options {told}")
    return options


def clamped(v: np.ndarray, scale: np.ndarray) -> np.ndarray | None:
    """v without its negative eigenvalues, of the columns divided by their scale; None if it has none."""
    e, q = np.linalg.eigh((v + v.T) / 2 * np.outer(scale, scale))
    return (q * np.maximum(e, 0)) @ q.T / np.outer(scale, scale) if len(e) and e[0] < 0 else None


def fit(df: DataFrame, y: str, x: list[str], fes: list[str | Effect] = (), weights: str | None = None, fweights: bool = False, clusters: list[str] = (), se_type: str = "unadjusted", endogenous: list[str] = (), instruments: list[str] = (), intercept: bool = True, drop_singletons_: bool = True, na_action: str = "raise", level: float = 0.95, dof: str = "all", retain_fes: bool = False, ssc: dict | str | None = None, weight_kind: str | None = None, tol: float = 1e-8, tolerance_mode: str = "comparable", collinear_priority: list[str] = (), aliases: list[str] = (), backend: str = "cpu", threads: int | None = None, convergence: str = "auto", progress=None, work: dict | None = None) -> Result:
    """Fit y on x (endogenous ones last) after absorbing fes. Analytic weights, or frequency weights with fweights.

    An Effect in fes may have slopes. retain_fes: the sample gets fe1, fe2, ..., what each effect contributes to y.
    aliases: names for those columns. ssc: small-sample options, see small_sample(): k_adj (count parameters in robust and
    clustered factors), k_fixef (full, nonnested or none: which effects count in them, by default those that clusters don't nest),
    k_exact (less redundant levels, or all levels), g_adj (G / (G - 1)), g_df (min: one factor of the fewest clusters,
    conventional: one for each set of cluster variables), t_df (degrees of freedom of t).
    weight_kind: a, f (as fweights), p (as a, and robust unless told otherwise) or i (as a, but n is the sum of weights).
    tol and tolerance_mode (comparable, fast, strict-residual) bound the certificate of the absorption; what is solved is the same.
    backend must be cpu; threads and convergence (auto, normchange, sweep or both) are taken and change nothing: Spark deals
    out the work, and what is solved is certified. progress: called with a line of text at each step.
    Where inference isn't available (no degrees of freedom left, fewer than two clusters) standard errors are NaN.
    work: a dict that keeps the sample and what is absorbed from one fit for later ones of the same rows, columns, effects and weights, which
    may differ in their inference; their clusters must be the first one's, or fewer, or effects.
    """
    small = small_sample(ssc)
    if backend != "cpu" or convergence not in ("auto", "normchange", "sweep", "both"):
        raise ValueError(f"backend {backend!r}, convergence {convergence!r}")
    say = progress or (lambda text: None)
    if weight_kind not in (None, "a", "f", "p", "i") or (weight_kind and not weights):
        raise ValueError(f"weight_kind {weight_kind!r}")
    if tolerance_mode not in MODES:
        raise ValueError(f"tolerance_mode {tolerance_mode!r}")
    if tolerance_mode == "strict-residual" and any(as_effect(e).slopes for e in fes):
        raise ValueError("strict-residual goes without slopes")
    bound = max(8 * min(tol, MODES[tolerance_mode]), 64 * float(np.finfo(float).eps))
    fweights = fweights or weight_kind == "f"
    se_type = "robust" if weight_kind == "p" and SYNONYMS.get(se_type, se_type) == "unadjusted" else se_type
    se_type = SYNONYMS.get(se_type, se_type)
    if se_type not in ("unadjusted", "robust", "cluster") or (se_type == "cluster") != bool(clusters):
        raise ValueError(f"se_type {se_type!r} with clusters {list(clusters)}")
    if len(instruments) < len(endogenous):
        raise ValueError("fewer instruments than endogenous regressors")
    level = level / 100 if level > 1 else level
    xs = [*x, *endogenous]
    vs = [y, *xs, *instruments]
    effects = [as_effect(e) for e in fes]
    ids = list(dict.fromkeys([*(e.keys[0] for e in effects), *clusters]))
    slopes = {z: f"__z{i}" for i, z in enumerate(dict.fromkeys(z for e in effects for z in e.slopes))}
    fes = [Effect(e.keys, tuple(slopes[z] for z in e.slopes), e.intercept) for e in effects]
    plain = [e.keys[0] for e in effects if e.intercept]
    cols, w = [f"__v{i}" for i in range(len(vs))], F.col("__w") if weights else F.lit(1.0)
    asked = (df, vs, effects, weights, fweights, intercept, drop_singletons_, na_action, bound)
    if work and work["asked"][0] is df and work["asked"][1:] == asked[1:] and set(ids) <= set(work["ids"]):
        rows, told, tilde, how = (work[k] for k in ("rows", "told", "tilde", "how"))
    else:
        picked = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(vs)], *[F.col(z).cast("double").alias(c) for z, c in slopes.items()], *([F.col(weights).cast("double").alias("__w")] if weights else []), *[F.col(c).alias(c) for c in ids])
        rows = check(picked, cols + list(slopes.values()) + (["__w"] if weights else []), ids, na_action)
        if weights and rows.where("__w < 0" + (" OR __w <> floor(__w) OR __w = 0" if fweights else "")).limit(1).count():
            raise ValueError("weights must be" + (" positive whole numbers" if fweights else " at least 0"))
        rows = drop_singletons(rows, plain, "__w" if fweights else None) if plain and drop_singletons_ else keep_cut(rows)
        told = rows.agg(F.count(F.lit(1)), F.sum(w), *[F.sum(w * F.col(c)) / F.sum(w) for c in cols]).first()
        tilde = how = None
    if not told[0]:
        raise ValueError("no rows are left")
    n_rows, w_sum, means = told[0], float(told[1]), np.array(told[2:], float)
    say(f"the sample has {n_rows} rows")
    n = int(w_sum) if fweights or weight_kind == "i" else n_rows
    cons = intercept and not fes
    if tilde is None:
        centred = rows.select(*rows.columns, *[(F.col(c) - float(m if cons or plain else 0.0)).alias(f"{c}c") for c, m in zip(cols, means, strict=True)])
        tilde, how = absorb(centred, [f"{c}c" for c in cols], list(fes), "__w" if weights else None, bound=bound, lean=True)
        if work is not None:
            work.clear()
            work.update(asked=asked, ids=ids, rows=rows, told=told, tilde=tilde, how=how, dof={})
    say(f"absorbed by {how['method']} in {how['iterations']} rounds")
    t = [f"{c}c_tilde" for c in cols]
    # Squares without weights tell what the effects explain; one pass gives them and the products.
    pairs = [(i, j) for i in range(len(t)) for j in range(i, len(t))]
    told = np.array(tilde.agg(*[F.sum(w * F.col(t[i]) * F.col(t[j])) for i, j in pairs], *[F.sum(F.col(c) ** 2) for c in [*cols, *t]]).first(), float)
    gram, squares = np.zeros((len(t), len(t))), told[len(pairs) :]
    for (i, j), v in zip(pairs, told, strict=False):
        gram[i, j] = gram[j, i] = v
    raw, after = squares[: len(cols)], squares[len(cols) :]
    k = len(xs)
    first_ones = [xs.index(c) for c in collinear_priority]
    keep, omitted = kept_columns(gram[1 : k + 1, 1 : k + 1], raw[1 : k + 1], max(1e-6, 10 * tol), after[1 : k + 1], first_ones)
    kept = [1 + j for j in keep]
    if endogenous:
        exog = [i for i in kept if i <= len(x)]
        zs = [*exog, *range(k + 1, len(vs))]
        z_keep, _ = kept_columns(gram[np.ix_(zs, zs)], raw[zs], left=after[zs])
        zs = [zs[i] for i in z_keep]
        if len(zs) < len(kept):
            raise ValueError(f"under-identified: {len(zs)} instruments and exogenous columns are left for {len(kept)} regressors")
        # The rank of the first stage: of the endogenous columns' covariance with what instruments add to the exogenous ones.
        given, new, told_by = [i for i in kept if i <= len(x)], [z for z in zs if z > k], [i for i in kept if i > len(x)]
        inner = gram[np.ix_(new, new)] - (gram[np.ix_(new, given)] @ np.linalg.solve(gram[np.ix_(given, given)], gram[np.ix_(given, new)]) if given else 0)
        outer = gram[np.ix_(new, told_by)] - (gram[np.ix_(new, given)] @ np.linalg.solve(gram[np.ix_(given, given)], gram[np.ix_(given, told_by)]) if given else 0)
        d1, d2 = np.sqrt(np.diag(inner)), np.sqrt(np.maximum(np.diag(gram)[told_by], 1e-300))
        rank = int(np.linalg.matrix_rank(outer / d1[:, None] / d2[None], tol=1e-9))
        if rank < len(told_by):
            raise ValueError(f"under-identified: the first stage has rank {rank} for {len(told_by)} endogenous regressors")
        explained = np.einsum("ij,ij->j", outer, np.linalg.solve(inner, outer))
        total = np.diag(gram)[told_by] - (np.einsum("ij,ij->j", gram[np.ix_(given, told_by)], np.linalg.solve(gram[np.ix_(given, given)], gram[np.ix_(given, told_by)])) if given else 0)
        checks = {"instruments": len(new), "rank": rank, "overidentified": len(zs) - len(kept), "partial_r2": dict(zip([xs[i - 1] for i in told_by], (explained / total).tolist(), strict=True))}
        first = np.linalg.solve(gram[np.ix_(zs, zs)], gram[np.ix_(zs, kept)])
        a = first.T @ gram[np.ix_(zs, kept)]
        b = np.linalg.solve(a, first.T @ gram[zs, 0])
        fitted = [sum((F.col(t[z]) * float(first[i, j]) for i, z in enumerate(zs)), F.lit(0.0)) for j in range(len(kept))]
    else:
        checks = {}
        a = gram[np.ix_(kept, kept)]
        b = np.linalg.solve(a, gram[kept, 0])
        fitted = [F.col(t[j]) for j in kept]
    bread = np.linalg.inv(a) if kept else np.zeros((0, 0))
    u = F.col(t[0]) - sum((F.col(t[j]) * float(v) for j, v in zip(kept, b, strict=True)), F.lit(0.0))
    # The rows are cut where effects were absorbed; what follows are columns of theirs, made again in each pass.
    scored = tilde.select(*rows.columns, u.alias("__u"), *[f.alias(f"__x{i}") for i, f in enumerate(fitted)])
    centre = intercept or bool(fes)
    middle_y = float(means[0]) if centre else 0.0
    rss, tss = (float(v) for v in scored.agg(F.sum(w * F.col("__u") ** 2), F.sum(w * (F.col("__v0") - middle_y) ** 2)).first())
    searched = work["dof"] if work else {}
    if (of := (dof, *clusters)) not in searched:
        searched[of] = absorbed(rows, list(fes), list(clusters), intercept, dof, "__w" if weights else None)
    dof = searched[of]
    df_a = dof["df_a"] if fes else 0
    p = len(kept) + intercept
    df_r = n - len(kept) - (df_a if fes else cons)
    scale = n / w_sum if weights and not fweights else 1.0
    # The constant joins as a column of ones: with effects it is recovered from the means, and so is its part of the scores.
    if intercept:
        m = means[kept]
        shift = np.block([[np.eye(len(kept)), np.zeros((len(kept), 1))], [-m[None], np.ones((1, 1))]])
        full = np.block([[bread, np.zeros((len(kept), 1))], [np.zeros((1, len(kept))), np.array([[1 / w_sum]])]])
        scored = scored.withColumn(f"__x{len(kept)}", F.lit(1.0))
    else:
        shift, full = np.eye(len(kept)), bread
    s = [f"__s{i}" for i in range(p)]
    counted = df_a
    if small["k_fixef"] or not small["k_exact"]:
        lost = sum(x for x, inside in zip(dof["levels"], dof["nested"], strict=True) if inside)
        own = df_a if small["k_exact"] else sum(x for x, inside in zip(dof["levels"], dof["nested"], strict=True) if not inside)
        counted = {"none": 0, "full": own + lost}.get(small["k_fixef"], own)
    available = df_r > 0
    if se_type == "unadjusted":
        v = full * (rss * scale / df_r if df_r > 0 else np.nan)
    else:
        power = F.sqrt(w) if fweights and se_type == "robust" else w
        scores = scored.select(*clusters, *[(power * F.col("__u") * F.col(f"__x{i}")).alias(c) for i, c in enumerate(s)])
        if se_type == "robust":
            middle, _ = meat(scores, s, None)
            free = n - len(kept) - (counted if fes else cons)
            factor = (n / free if small["k_adj"] else 1.0) if df_r > 0 and free > 0 else np.nan
        else:
            middle, g = meat(scores, s, list(clusters)) if len(clusters) == 1 else multiway(scores, s, list(clusters), small["g_adj"] and small["g_df"] == "conventional")
            inside = int(bool(fes) and any(dof["nested"]))
            free = n - len(kept) - max(counted, 1 if centre else 0) - (inside if counted else 0)
            once = small["g_adj"] and not (len(clusters) > 1 and small["g_df"] == "conventional")
            factor = (g / (g - 1) if once else 1.0) * ((n - 1) / free if small["k_adj"] else 1.0) if g > 1 and free > 0 else np.nan
            df_r = min(df_r, g - 1)
            available = available and g > 1
        v = full @ middle @ full * factor
    df_r = small["t_df"] or df_r
    v = shift @ v @ shift.T
    if len(clusters) > 1 and available:
        spread = np.array(rows.agg(*[F.sqrt(F.sum(w * (F.col(cols[j]) - float(means[j])) ** 2) / ((w_sum if fweights else n_rows) - 1) / (1.0 if fweights else w_sum / n_rows)) for j in kept]).first(), float) if kept else np.zeros(0)
        of = np.append(np.maximum(spread, 1e-3), [1.0] * int(intercept))
        whole = clamped(v, of)
        if whole is not None:
            # the slopes' own block is mended by itself, so that it doesn't depend on the constant
            own = v[: len(kept), : len(kept)]
            block = clamped(own, of[: len(kept)])
            whole[: len(kept), : len(kept)] = own if block is None else block
            v = whole
    terms = [*xs, *(["_cons"] if intercept else [])]
    coef, vcov = np.zeros(len(terms)), np.zeros((len(terms), len(terms)))
    at = [j for j in keep]
    coef[at] = b
    place = at + ([len(xs)] if intercept else [])
    vcov[np.ix_(place, place)] = v if available else 0.0
    if intercept:
        coef[len(xs)] = means[0] - means[kept] @ b
    if not available:
        np.fill_diagonal(vcov, UNAVAILABLE)
    elif not (np.isfinite(coef).all() and np.isfinite(vcov).all()):
        raise RuntimeError("the fit gave coefficients or variances that aren't finite")
    if retain_fes and fes:
        left = F.col("__v0") - sum((F.col(f"__v{j}") * float(v) for j, v in zip(kept, b, strict=True)), F.lit(float(coef[len(xs)]) if intercept else 0.0))
        scored, _ = absorb(scored.select(*rows.columns, "__u", left.alias("__d")), ["__d"], list(fes), "__w" if weights else None, effects=True, lean=True)
        if not slopes:
            scored = normalise(scored, [f"__d_fe{i + 1}" for i in range(len(fes))], plain, "__w" if weights else None)
            scored = keep_cut(scored) if len(fes) > 1 else scored  # with one it is a column less a number
    shown = [F.col(f"__d_fe{i + 1}").alias(([*aliases, *[f"fe{j + 1}" for j in range(len(aliases), len(fes))]])[i]) for i in range(len(fes))] if retain_fes else []
    sample = scored.select(*shown, *ids, F.col("__v0").alias("__y"), "__u", *([F.col("__w")] if weights else []), *[F.col(f"__v{i + 1}").alias(c) for i, c in enumerate(xs)])
    return Result(terms, coef, vcov, n, df_r, len(kept), df_a, rss * scale, tss * scale, float(gram[0, 0]) * scale, sample, how, dof, {xs[j]: r for j, r in omitted.items()}, level, y, [e.name for e in effects], se_type, list(clusters), checks, available, bool(retain_fes and fes))


def _categories(term: str, df: DataFrame, intercept: bool) -> tuple[str, list]:
    """The column of C(g) or C(g, Treatment(reference=v)) and the levels that get a column, in order."""
    parts = split_top(term[2:-1], ",")
    g = parts[0].strip("`")
    values = sorted(r[0] for r in df.where(F.col(g).isNotNull()).select(g).distinct().collect())  # a regressor for each level, so few
    if not intercept:
        return g, values
    reference = values[0] if values else None
    if len(parts) > 1:
        m = re.fullmatch(r"Treatment\(\s*(?:reference\s*=\s*)?(.+?)\s*\)", parts[1])
        found = [v for v in values if m and str(v) == m[1].strip("\"'")]
        if not found:
            raise ValueError(f"no such reference level: {term}")
        reference = found[0]
    return g, [v for v in values if v != reference]


def _transform(term: str, df: DataFrame, context: dict):
    """The column of one factor of a term: a column, I(...), Q("name"), or a call of context's or Spark's functions."""
    if (name := term.strip("`")) in df.columns:
        return F.col(f"`{name}`")
    if m := re.fullmatch(r"""Q\((["'])(.+)\1\)""", term):
        return F.col(f"`{m[2]}`")
    if m := re.fullmatch(r"(\w+)\((.*)\)", term):
        inner = re.sub(r"([\w.`]+|\([^()]*\))\s*\*\*\s*([\w.]+)", r"power(\1, \2)", m[2])
        if m[1] == "I":
            return F.expr(inner)
        if m[1] in context:
            return context[m[1]](*[F.expr(a) for a in split_top(inner, ",")])
        return F.expr(f"{m[1]}({inner})")
    raise ValueError(f"no column {term!r}")


@dataclass
class Prepared:
    """A formula's columns over a frame, made once; fit() takes the options of the module's fit()."""

    df: DataFrame
    formula: Formula
    names: list[str]
    effects: list[Effect]

    def fit(self, **options) -> Result:
        f = self.formula
        return fit(self.df, f.y, self.names, self.effects, endogenous=list(f.endogenous), instruments=list(f.instruments), intercept=f.intercept, **options)


def design(formula: str | Formula, df: DataFrame, context: dict | None = None, subset=None) -> Prepared:
    """Products of columns become columns, joint effects become joint keys, C(g) and its products become dummies and theirs.

    context: names to functions of columns, for terms like log1(x). subset: a condition on rows, as SQL or column.
    """
    f = parse(formula) if isinstance(formula, str) else formula
    made = df if subset is None else df.where(subset)
    names: list[str] = []
    present = {frozenset(split_top(t, ":")) for t in f.x} | ({frozenset()} if f.intercept or f.effects else set())
    for term in f.x:
        factors = split_top(term, ":")
        if not any(x.startswith("C(") for x in factors):
            if term not in df.columns:
                product = F.lit(1.0)
                for part in factors:
                    product = product * _transform(part, df, context or {})
                made = made.withColumn(term, product)
            names.append(term)
            continue
        # Of a category all levels get a column, but the reference where the rest of the term is in the model by itself.
        cells = [("", F.lit(1.0))]
        for part in factors:
            if part.startswith("C("):
                g, values = _categories(part, made, frozenset(factors) - {part} in present)
                each = [(f"{g}[{v}]", F.when(F.col(g) == v, 1.0).otherwise(F.when(F.col(g).isNotNull(), 0.0))) for v in values]
            else:
                each = [(part, _transform(part, df, context or {}))]
            cells = [(f"{name}:{n}" if name else n, column * c) for name, column in cells for n, c in each]
        for name, column in cells:
            made = made.withColumn(name, column)
            names.append(name)
    keys = []
    for e in f.effects:
        name = "^".join(e.keys)
        if len(e.keys) > 1:
            # as a struct's JSON, so that values that hold the separator don't meet
            whole = F.lit(True)
            for k in e.keys:
                whole = whole & F.col(k).isNotNull()
            made = made.withColumn(name, F.when(whole, F.to_json(F.array(*[F.col(k).cast("string") for k in e.keys]))))
        keys.append(Effect((name,), e.slopes, e.intercept))
    return Prepared(made, f, names, keys)


def prepare_formula(formula: str | Formula, df: DataFrame, context: dict | None = None, subset=None) -> Prepared:
    """A design kept in the checkpoint folder, to be fit repeatedly without making its columns again."""
    out = design(formula, df, context, subset)
    used = list(dict.fromkeys([*out.df.columns]))
    return Prepared(keep_cut(out.df.select(*[F.col(f"`{c}`") for c in used])), out.formula, out.names, out.effects)


def feols(formula: str | Formula, df: DataFrame, context: dict | None = None, subset=None, **options) -> Result:
    """Fit a formula, see design(); options are those of fit()."""
    return design(formula, df, context, subset).fit(**options)


def partial_out(df: DataFrame, columns: list[str], fes: list[str | Effect], weights: str | None = None, drop_singletons_: bool = False) -> DataFrame:
    """The rows with <column>_tilde: what the effects don't explain. Singletons stay unless asked for."""
    if drop_singletons_:
        df = drop_singletons(df, [e.keys[0] for e in map(as_effect, fes) if e.intercept])
    return absorb(df, columns, fes, weights)[0]
