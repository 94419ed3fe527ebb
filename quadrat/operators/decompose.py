"""How much each group of added covariates moves the coefficients of the focal ones, with the covariance of the parts.

All rows stay in the cluster: one absorption gives what effects contribute, and every covariance is an aggregation of
products of columns (moments) or of cluster sums (meat). The driver holds matrices of the size of the columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, normal_quantile, normal_tail
from .absorb import absorb, normalise
from .graph import absorbed, mobility_groups
from .model import SYNONYMS, kept_columns, meat, moments, multiway
from .sample import check, drop_singletons, keep_cut


@dataclass
class Decomposition:
    targets: list[str]
    groups: list[str]
    base: np.ndarray
    full: np.ndarray
    delta: np.ndarray
    cov: np.ndarray
    base_cov: np.ndarray
    cross: np.ndarray
    n: int
    df_full: float
    identity_gap: float
    regular: dict[tuple[str, str], bool]
    diagnostics: dict
    sample: DataFrame
    level: float = 0.95

    @property
    def total(self) -> np.ndarray:
        return self.delta.sum(0)

    @property
    def total_cov(self) -> np.ndarray:
        """The covariance of totals; the total of a target imposed as zero is its base coefficient."""
        k, g = len(self.targets), len(self.groups)
        out = self.cov.reshape(g, k, g, k).sum((0, 2))
        lost = [self.targets.index(t) for t in self.diagnostics.get("imposed_zero", [])]
        if lost and not np.isnan(out[np.ix_(lost, lost)]).any():
            out[np.ix_(lost, lost)] = self.base_cov[np.ix_(lost, lost)]
        return out

    def tidy(self, share: str = "base", least: float = 1e-12, weak_t: float = 3.0) -> list[dict]:
        """A row for each target and group, and for each target's total.

        share: of the base coefficient (base: its covariance counts; base_fixed: it doesn't) or of the movement. A share of
        a denominator under `least` is NaN; weak marks denominators with |t| under weak_t.
        """
        if share not in ("base", "base_fixed", "movement"):
            raise ValueError(f"share {share!r}")
        crit, out, k = normal_quantile(0.5 + self.level / 2), [], len(self.targets)
        v = self.cov.reshape(len(self.groups), k, len(self.groups), k)
        for j, target in enumerate(self.targets):
            below, below_v = (self.total[j], self.total_cov[j, j]) if share == "movement" else (self.base[j], self.base_cov[j, j])
            for g, name in [*enumerate(self.groups), (None, "total")]:
                d, s2 = (self.total[j], self.total_cov[j, j]) if g is None else (self.delta[g, j], v[g, j, g, j])
                with_total = v[:, j, :, j].sum() if g is None else v[g, j, :, j].sum()
                with_base = self.cross.reshape(len(self.groups), k, k)[:, j, j].sum() if g is None else self.cross.reshape(len(self.groups), k, k)[g, j, j]
                c = {"base": with_base, "base_fixed": 0.0, "movement": with_total}[share]
                row = {"target": target, "group": name, "delta": float(d), "se": math.sqrt(s2) if s2 >= 0 else float("nan")}
                row |= {"z": row["delta"] / row["se"] if row["se"] else float("nan"), "low": row["delta"] - crit * row["se"], "high": row["delta"] + crit * row["se"]}
                row["p"] = 2 * normal_tail(abs(row["z"])) if row["z"] == row["z"] else float("nan")
                if abs(below) > least:
                    r = d / below
                    var = (s2 + (0.0 if share == "base_fixed" else r * r * below_v - 2 * r * c)) / below**2
                    row |= {"share": float(r), "share_se": math.sqrt(max(var, 0.0)), "weak": bool(below_v > 0 and abs(below) / math.sqrt(below_v) < weak_t)}
                else:
                    row |= {"share": float("nan"), "share_se": float("nan"), "weak": True}
                row["regular"] = self.regular.get((target, name), True)
                out.append(row)
        return out

    def contrast(self, weights: dict[tuple[str, str], float]) -> dict:
        """A weighted sum of contributions, keyed by (target, group), with its standard error."""
        w = np.zeros(self.delta.size)
        for (target, group), v in weights.items():
            w[self.groups.index(group) * len(self.targets) + self.targets.index(target)] = v
        value, var = float(w @ self.delta.ravel()), float(w @ self.cov @ w)
        se = math.sqrt(max(var, 0.0))
        return {"value": value, "se": se, "z": value / se if se else float("nan"), "p": 2 * normal_tail(abs(value / se)) if se else float("nan")}

    def waterfall(self, target: str) -> list[dict]:
        """Steps from the base to the full coefficient: each group's bar with where it starts and ends."""
        j, at = self.targets.index(target), float(self.base[self.targets.index(target)])
        out = [{"step": "base", "start": 0.0, "end": at}]
        for g, name in enumerate(self.groups):
            out.append({"step": name, "start": at, "end": at - float(self.delta[g, j])})
            at = out[-1]["end"]
        return [*out, {"step": "full", "start": 0.0, "end": float(self.full[j])}]

    def frame(self) -> DataFrame:
        rows = [(r["target"], r["group"], r["delta"], r["se"], r["share"]) for r in self.tidy()]
        return self.sample.sparkSession.createDataFrame(rows, "target string, group string, delta double, se double, share double")


def decompose(df: DataFrame, y: str, x1: list[str], groups: dict[str, list[str]] | None = None, fes: list[str] = (), common_fes: list[str] = (), vce: str = "unadjusted", clusters: list[str] = (), weights: str | None = None, fweights: bool = False, gamma0: bool = False, cov0: bool = False, na_action: str = "raise", alpha: float = 0.05, level: float = 0.95, absorbed_targets: list[str] = (), position: str | None = None) -> Decomposition:
    """Contributions of groups of columns, and of each effect in fes, to the difference of x1's coefficients without and with them.

    common_fes are in both models and in every auxiliary one. Both models use the full one's sample. gamma0 leaves out the
    sampling of the groups' coefficients, cov0 its covariance with the auxiliary regressions; effects always go by gamma0.
    Targets that the full model doesn't identify raise; but those in absorbed_targets must be explained by the effects: their full
    coefficient is imposed as zero, and their total has the base coefficient's variance, which needs clusters by an added effect
    (else their covariances are NaN). position: a column of row numbers from 0, whose kept ones are hashed (see sample_hash()).
    """
    vce = SYNONYMS.get(vce, vce)
    if vce not in ("unadjusted", "robust", "cluster") or (vce == "cluster") != bool(clusters):
        raise ValueError(f"vce {vce!r} with clusters {list(clusters)}")
    groups, fes, common = dict(groups or {}), list(fes), list(common_fes)
    if not x1 or not (groups or fes) or set(fes) & set(common) or set(fes) & set(groups):
        raise ValueError("name targets, and groups or effects with distinct names")
    x2 = [c for g in groups.values() for c in g]
    if set(absorbed_targets) - set(x1) or absorbed_targets and not fes:
        raise ValueError("absorbed targets must be targets, and effects must be added")
    whole_p, q, every = len(x1), len(x2), [*common, *fes]
    active = [i for i, t in enumerate(x1) if t not in absorbed_targets]
    p = len(active)  # targets that the full model estimates
    ids = list(dict.fromkeys([*every, *clusters]))
    names = ["__y", *[f"__a{i}" for i in range(whole_p)], *[f"__b{i}" for i in range(q)]]
    picked = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip([y, *x1, *x2], names, strict=True)], *([F.col(weights).cast("double").alias("__w")] if weights else []), *([F.col(position).cast("long").alias("__at")] if position else []), *ids)
    n_input = df.count() if position else 0
    rows = check(picked, names + (["__w"] if weights else []), ids, na_action)
    rows = keep_cut(drop_singletons(rows, every, "__w" if fweights else None) if every else rows)
    n_rows, w_sum = rows.agg(F.count(F.lit(1)), F.sum("__w") if weights else F.count(F.lit(1))).first()
    if not n_rows:
        raise ValueError("no rows are left")
    n = float(w_sum) if fweights else float(n_rows)
    rows = rows.withColumn("__q", F.col("__w") * (1.0 if fweights else n / w_sum) if weights else F.lit(1.0)).withColumn("__one", F.lit(1.0))
    w = F.col("__q")
    # score factors: robust scores of frequency weights count each repeated row once
    power = F.sqrt(w) if fweights and vce == "robust" else w

    rows, _ = absorb(rows, names, every, "__q", "_t", effects=bool(every)) if every else absorb(rows, names, [], None, "_t")
    provenance = sample_hash(n_input, rows.select("__at")) if position else None
    estimated = [f"__a{i}" for i in active] + names[whole_p + 1 :]
    design = [f"{c}_t" for c in estimated] + ([] if every else ["__one"])
    if absorbed_targets:
        lost = [f"__a{x1.index(t)}" for t in absorbed_targets]
        kept_part = rows.agg(*[F.sum(w * F.col(f"{c}_t") ** 2) / F.sum(w * F.col(c) ** 2) for c in lost]).first()
        if any(x is not None and x > 1e-9 for x in kept_part):
            raise ValueError("an absorbed target must be explained by the effects")
    gram = moments(rows, ["__y_t", *design], w)
    keep, out = kept_columns(gram[1 : p + q + 1, 1 : p + q + 1], np.diag(moments(rows, ["__y", *estimated], w))[1:])
    if out:
        raise ValueError(f"not identified in the full model: {[[*(x1[i] for i in active), *x2][j] for j in out]}")
    bread = np.linalg.inv(gram[1:, 1:])
    b = bread @ gram[1:, 0]
    e = F.col("__y_t") - sum((F.col(c) * float(v) for c, v in zip(design, b, strict=True)), F.lit(0.0))
    parts = {g: sum((F.col(f"__b{x2.index(c)}") * float(b[p + x2.index(c)]) for c in cols), F.lit(0.0)) for g, cols in groups.items()}
    shown = [F.col(f"__y_fe{d + 1}") - sum((F.col(f"{c}_fe{d + 1}") * float(v) for c, v in zip(estimated, b, strict=False)), F.lit(0.0)) for d in range(len(every))]
    dof = absorbed(rows, every, list(clusters), True)
    df_full = n - p - q - max(dof["df_a"], 1) - int(bool(every) and bool(dof["df_a"]) and any(dof["nested"]))
    rows = rows.select(*names, *design, *ids, "__q", e.alias("__e"), *[v.alias(f"__h{i}") for i, v in enumerate(parts.values())], *[v.alias(f"__f{d}") for d, v in enumerate(shown)], *(["__one"] if every else []))
    if every:
        rows = keep_cut(normalise(rows, [f"__f{d}" for d in range(len(every))], every, "__q"))
    h = [f"__h{i}" for i in range(len(groups))] + [f"__f{every.index(d)}" for d in fes]
    labels = [*groups, *fes]
    # the auxiliary design: targets and the constant, or targets within the common effects
    a = names[1 : whole_p + 1]
    if common:
        wanted = ["__y", *a, *names[whole_p + 1 :], *h]
        rows, _ = absorb(rows, wanted, common, "__q", "_c")
        side, outcome, b2, h = [f"{c}_c" for c in a], "__y_c", [f"{c}_c" for c in names[whole_p + 1 :]], [f"{c}_c" for c in h]
    else:
        side, outcome, b2 = [*a, "__one"], "__y", names[whole_p + 1 :]
    ka, count = len(side), len(h)
    cross = moments(rows, [*side, outcome, *b2, *h], w)
    inverse = np.linalg.inv(cross[:ka, :ka])
    base = inverse @ cross[:ka, ka]
    gammas = inverse @ cross[:ka, ka + 1 : ka + 1 + q]
    delta = (inverse @ cross[:ka, ka + 1 + q :]).T
    span, at = [], 0
    for g in labels:
        size = len(groups.get(g, []))
        span.append((at, at + size))
        at += size
    fit_of = lambda v: sum((F.col(c) * float(x) for c, x in zip(side, v, strict=True)), F.lit(0.0))
    v_cols, k = [f"__r{g}" for g in range(count)], len(design)
    rows = keep_cut(rows.select("*", (F.col(outcome) - fit_of(base)).alias("__u"), *[(F.col(c) - fit_of(delta[g])).alias(r) for g, (c, r) in enumerate(zip(h, v_cols, strict=True))]))
    gamma = lambda g: gammas[:, slice(*span[g])]
    cov, with_base, total = np.zeros((count, ka, count, ka)), np.zeros((count, ka, ka)), int(count)
    if vce == "unadjusted":
        omega = moments(rows, ["__e", "__u", *v_cols], w) / df_full
        means = np.array(rows.agg(*[F.sum(w * F.col(c)) / F.sum(w) for c in ["__e", "__u", *v_cols]]).first(), float)
        omega -= np.outer(means, means) * n / df_full
        v2 = bread[p : p + q, p : p + q] * float(rows.agg(F.sum(w * F.col("__e") ** 2)).first()[0]) / df_full
        base_cov = inverse * omega[1, 1] * df_full / (n - ka - (absorbed(rows, common, [], True)["df_a"] if common else 0))
        for g in range(total):
            with_base[g] = omega[g + 2, 1] * inverse
            for i in range(total):
                cov[g, :, i] = omega[g + 2, i + 2] * inverse
                if not gamma0 and gamma(g).size and gamma(i).size:
                    cov[g, :, i] += gamma(g) @ v2[slice(*span[g]), slice(*span[i])] @ gamma(i).T
    else:
        scores = [(power * F.col("__e") * F.col(c)) for c in design] + [(power * F.col(r) * F.col(c)) for r in v_cols for c in side] + [(power * F.col("__u") * F.col(c)) for c in side]
        s = [f"__s{i}" for i in range(len(scores))]
        scored = rows.select(*clusters, *[c.alias(x) for c, x in zip(scores, s, strict=True)])
        if vce == "robust":
            middle, _ = meat(scored, s, None)
            big, own = n / (n - 1), n / df_full
        else:
            middle, g_n = meat(scored, s, list(clusters)) if len(clusters) == 1 else multiway(scored, s, list(clusters))
            if g_n < 2:
                raise ValueError("fewer than two clusters")
            big, own = g_n / (g_n - 1), (n - 1) / df_full * g_n / (g_n - 1)
        side_bread = np.zeros((len(s), len(s)))
        side_bread[:k, :k] = bread
        for g in range(total + 1):
            low = k + g * ka
            side_bread[low : low + ka, low : low + ka] = inverse
        c = side_bread @ middle @ side_bread
        v2 = own * c[p : p + q, p : p + q]
        at_g = lambda g: slice(k + g * ka, k + (g + 1) * ka)
        at_2 = lambda g: slice(p + span[g][0], p + span[g][1])
        base_cov = c[at_g(total), at_g(total)] * big
        for g in range(total):
            with_base[g] = big * c[at_g(g), at_g(total)]
            if not gamma0 and gamma(g).size:
                with_base[g] += big * gamma(g) @ c[at_2(g), at_g(total)]
            for i in range(total):
                cov[g, :, i] = big * c[at_g(g), at_g(i)]
                if not gamma0 and gamma(g).size and gamma(i).size:
                    cov[g, :, i] += gamma(g) @ v2[slice(*span[g]), slice(*span[i])] @ gamma(i).T
                    if not cov0:
                        cov[g, :, i] += big * (gamma(g) @ c[at_2(g), at_g(i)] + (gamma(i) @ c[at_2(i), at_g(g)]).T)
    # first-order inference on a product needs one of its factors not to be zero
    regular = {}
    for g, name in enumerate(labels):
        if not gamma(g).size:
            continue
        beta, v = b[p + span[g][0] : p + span[g][1]], v2[slice(*span[g]), slice(*span[g])]
        values, vectors = np.linalg.eigh(v)
        good = values > len(values) * 100 * np.finfo(float).eps * max(values.max(), 0)
        wald = float((((vectors.T @ beta)[good]) ** 2 / values[good]).sum())
        whole = bool(good.any()) and chi2_tail(wald, int(good.sum())) < alpha / 2
        for j, target in enumerate(x1):
            cells = cross[ka + 1 + span[g][0] : ka + 1 + span[g][1], ka + 1 + span[g][0] : ka + 1 + span[g][1]]
            left = np.diag(cells - gamma(g).T @ cross[:ka, :ka] @ gamma(g)) / df_full * inverse[j, j]
            z = np.abs(gamma(g)[j]) / np.sqrt(np.maximum(left, 1e-300))
            regular[target, name] = whole or any(2 * normal_tail(float(t)) < alpha / 2 / len(z) for t in z)
    full = np.zeros(whole_p)
    full[active] = b[:p]
    told = {"clusters": int(g_n) if vce == "cluster" else 0, "few_clusters": vce == "cluster" and g_n < 30, "connectivity": "none"}
    if len(every) == 2:
        parts_n = mobility_groups(rows, every[0], every[1]).select("group").distinct().count()
        told |= {"connectivity": "identified_two_way" if parts_n == 1 else "normalization_dependent", "components": parts_n}
    elif len(every) > 2:
        told["connectivity"] = "not_certified_multiway"
    within_share = np.diag(gram)[1 : p + 1] / np.maximum((np.diag(cross)[:whole_p] if common else np.diag(moments(rows, a, w)))[active], 1e-300)
    told["near_collinear"] = [x1[i] for i, r in zip(active, within_share, strict=True) if 1e-9 < r <= 1e-4] if every else []
    told |= {"imposed_zero": list(absorbed_targets), "sample_hash": provenance}
    p = whole_p
    gap = float(np.max(np.abs(delta[:, :p].sum(0) - (base[:p] - full))))
    if absorbed_targets and not (vce == "cluster" and list(clusters) and set(clusters) <= set(fes)):
        lost = [x1.index(t) for t in absorbed_targets]
        cov[:, lost], cov[:, :, :, lost], with_base[:, lost], with_base[:, :, lost] = np.nan, np.nan, np.nan, np.nan
    take = [g * ka + j for g in range(count) for j in range(p)]
    flat = cov.reshape(count * ka, count * ka)[np.ix_(take, take)]
    return Decomposition(list(x1), labels, base[:p], full, delta[:, :p], flat, base_cov[:p, :p], with_base[:, :p, :p].reshape(-1, p), int(n), df_full, gap, regular, told, rows.select(*ids, "__e", *v_cols), level)


#: Rows of a sample up to which it is hashed, which goes row after row.
MOST_HASHED = 50_000_000


def sample_hash(n_input: int, positions: DataFrame, domain: str = "quadrat-sample-v1") -> str:
    """The 64-bit FNV-1a hash, in hex, of the domain's name, the numbers of input and kept rows, and the kept positions in order.

    Numbers are eight bytes, the least first. positions: one column. It tells samples apart, and is no digest against tampering.
    """
    n = positions.count()
    if n > MOST_HASHED:
        raise ValueError(f"{n} rows are more than are hashed ({MOST_HASHED})")
    value = 0xCBF29CE484222325

    def add(data: bytes) -> None:
        nonlocal value
        for byte in data:
            value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF

    add(domain.encode())
    add(n_input.to_bytes(8, "little") + n.to_bytes(8, "little"))
    name = positions.columns[0]
    for row in positions.orderBy(name).toLocalIterator():
        add(int(row[0]).to_bytes(8, "little"))
    return f"{value:016x}"
