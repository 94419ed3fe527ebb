"""Worker and firm effects, and their variance components corrected for limited mobility.

Person-years stay in the cluster: they are aggregated to matches (worker, firm) with a count and the sums of y and its
square, which is all that the components need at either level. The leave-out set takes components in the cluster first, then searches the largest for workers whose leaving would split it. The
match table goes to the driver for the search and the solves up to MOST_MATCHES, counted first; beyond, the search (connectivity.py), the solves, leverages, components and
projections stay in the cluster (spread_akm.py), with standard errors and eigenvalue shares left to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import mobility_groups
from .model import fit
from .sample import MOST_BROADCAST, check, counted, keep_cut

MOST_MATCHES = 20_000_000
#: Matches from which the leave-out set is searched for in the cluster.
MOST_SEARCHED = 2_000_000
#: Firms up to which the reduced system is inverted whole, and working rows up to which leverages are exact by default.
DENSE_FIRMS, EXACT_ROWS = 5_000, 10_000


def _arrow(df: DataFrame):
    n = df.count()
    if n > MOST_MATCHES:
        raise ValueError(f"{n} matches are more than the driver takes ({MOST_MATCHES})")
    return df.toArrow().to_pandas()


def matches(df: DataFrame, y: str, worker: str, firm: str, weight: str | None = None, sums: list[str] = ()) -> DataFrame:
    """(worker, firm, t, s, ss): of each match the number of its rows (or their frequency weight), and the sums of y, of its square and of further columns."""
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(y).cast("double")
    return df.groupBy(F.col(worker).alias("worker"), F.col(firm).alias("firm")).agg(F.sum(w).alias("t"), F.sum(w * v).alias("s"), F.sum(w * v * v).alias("ss"), *[F.sum(c).alias(c) for c in sums])


def cut_workers(w: np.ndarray, f: np.ndarray, n_workers: int, n_firms: int) -> np.ndarray:
    """Workers whose removal splits the bipartite graph of edges (w, f): its articulation points, by depth-first search."""
    n = n_workers + n_firms
    ends = np.concatenate([w, f + n_workers])
    order = np.argsort(ends, kind="stable")
    other = np.concatenate([f + n_workers, w])[order].tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()
    seen, low, at, cut, clock = [0] * n, [0] * n, first[:-1].copy(), np.zeros(n, bool), 0
    for root in range(n_workers, n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        path, parents, branches = [root], [-1], 0
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                u = other[at[v]]
                at[v] += 1
                if not seen[u]:
                    clock += 1
                    seen[u] = low[u] = clock
                    path.append(u)
                    parents.append(v)
                elif u != parents[-1] and seen[u] < low[v]:
                    low[v] = seen[u]
                continue
            path.pop()
            up = parents.pop()
            if up < 0:
                cut[v] = branches > 1
            elif up == root:
                branches += 1
            else:
                cut[up] |= low[v] >= seen[up]
            if up >= 0:
                low[up] = min(low[up], low[v])
    return np.flatnonzero(cut[:n_workers])


def _labels(w: np.ndarray, f: np.ndarray, n_firms: int, n_workers: int) -> np.ndarray:
    """The component of each firm: labels pass over the edges, and jump, until none moves."""
    label = np.arange(n_firms)
    while True:
        least = np.full(n_workers, n_firms)
        np.minimum.at(least, w, label[f])
        new = label.copy()
        np.minimum.at(new, f, least[w])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spread_leave_out(matches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(firm), (worker) or None: the firms that stay and the workers that go. Matches lie by worker and are read where they lie: the
    largest component stays and workers that split it go, again and again, until none does. A firm without movers is a component by itself."""
    from .connectivity import forest, roots, splitting_workers

    firms = keep_cut(matches.select("firm", F.xxhash64(F.lit(1), "firm").alias("node")).distinct())
    if firms.groupBy("node").count().where("count > 1").head(1):
        raise RuntimeError("two firms share a hash")
    number, gone = firms.count(), None
    total = number

    def inside() -> DataFrame:
        some = matches.withColumn("node", F.xxhash64(F.lit(1), "firm"))
        some = some if number == total else some.join(counted(firms.select("node"), number), "node", "left_semi")
        return (some if gone is None else some.join(counted(gone, gone.count()), "worker", "left_anti")).sortWithinPartitions("worker")

    while True:
        now = inside()
        now = now if number <= MOST_BROADCAST else keep_cut(now.repartition(matches.rdd.getNumPartitions(), "worker").sortWithinPartitions("worker"))
        links = forest(now)
        groups = roots(links)
        every = firms.join(counted(groups, groups.count()), "node", "left").join(now.groupBy("node").agg(F.sum("t").alias("t")), "node", "left")
        every = keep_cut(every.select("firm", "node", F.coalesce("root", "node").alias("group"), F.coalesce("t", F.lit(0)).alias("t")))
        top = every.groupBy("group").agg(F.count(F.lit(1)).alias("firms"), F.sum("t").alias("t"), F.min("firm").alias("least")).orderBy(F.desc("firms"), F.desc("t"), "least").first()
        firms = keep_cut(every.where(F.col("group") == top["group"]).select("firm", "node"))
        number = top["firms"]
        here = links.join(counted(firms.select(F.col("node").alias("u")), number), "u", "left_semi")
        bad = splitting_workers(inside(), links=here)
        if not bad.head(1):
            return firms.select("firm"), gone
        gone = bad if gone is None else keep_cut(gone.unionByName(bad))


def leave_out_set(df: DataFrame, worker: str, firm: str, weight: str | None = None, spread: bool | None = None) -> DataFrame:
    """The rows whose effects stay estimable when any one worker leaves. spread: search in the cluster (None: beyond MOST_SEARCHED matches).

    The largest component (most firms, then rows, then the smallest firm) is taken; workers that would split the graph of
    movers and firms go, and the largest component of the rest is taken again, until none is left; then workers with one row go.
    """
    import pandas as pd
    import pyarrow as pa

    w = F.col(weight) if weight else F.lit(1)
    df = df.where(F.col(worker).isNotNull() & F.col(firm).isNotNull())
    matches = df.groupBy(F.col(worker).alias("worker"), F.col(firm).alias("firm")).agg(F.sum(w).alias("t"))
    # by worker and in their order, which checkpoints keep: what follows reads them where they lie
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matches = keep_cut(matches.repartition(parts, "worker").sortWithinPartitions("worker"))
    if spread or spread is None and matches.count() > min(MOST_MATCHES, MOST_SEARCHED):
        if not matches.head(1):
            return df
        firms, gone = _spread_leave_out(matches)
        number = firms.count()
        kept = matches.join(counted(firms, number), "firm", "left_semi")
        kept = kept if gone is None else kept.join(counted(gone, gone.count()), "worker", "left_anti")
        stay = kept.groupBy("worker").agg(F.sum("t").alias("t")).where("t > 1").select(F.col("worker").alias(worker))
        # a worker that is left has no match outside the firms that stay
        return df.join(counted(firms.select(F.col("firm").alias(firm)), number), firm, "left_semi").join(stay, worker, "left_semi")
    groups = mobility_groups(matches, "firm", "worker")
    sized = matches.join(groups, "firm").groupBy("group").agg(F.countDistinct("firm").alias("firms"), F.sum("t").alias("t"), F.min("firm").alias("least"))
    top = sized.orderBy(F.desc("firms"), F.desc("t"), "least").first()
    if top is None:
        return df
    inside = keep_cut(matches.join(groups.where(F.col("group") == top["group"]).select("firm"), "firm"))
    degrees = inside.groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    movers = keep_cut(inside.join(degrees.where("n > 1").select("worker"), "worker").select("worker", "firm", "t"))
    movers = _arrow(movers)
    at_firm = _arrow(inside.groupBy("firm").agg(F.sum("t").alias("t")))
    firms = pd.Index(at_firm["firm"].sort_values())
    rows = at_firm.set_index("firm")["t"].reindex(firms).to_numpy(float)
    workers = pd.Index(movers["worker"].unique())
    a, b, t = workers.get_indexer(movers["worker"]), firms.get_indexer(movers["firm"]), movers["t"].to_numpy(float)
    gone, alive = np.zeros(len(workers), bool), np.ones(len(firms), bool)
    while len(a):
        bad = cut_workers(a, b, len(workers), len(firms))
        if not len(bad):
            break
        gone[bad] = True
        out = gone[a]
        rows -= np.bincount(b[out], t[out], len(firms))
        a, b, t = a[~out], b[~out], t[~out]
        label = _labels(a, b, len(firms), len(workers))
        live = np.flatnonzero(alive)
        sizes, mass = np.bincount(label[live], minlength=len(firms)), np.bincount(label[live], rows[live], len(firms))
        best = min(np.unique(label[live]), key=lambda g: (-sizes[g], -mass[g], g))
        alive &= label == best
        stays = alive[b]
        gone[a[~stays]] = True
        a, b, t = a[stays], b[stays], t[stays]
    spark = df.sparkSession
    table = lambda index, name, like: spark.createDataFrame(pa.table({name: pa.array(index)})).select(F.col(name).cast(df.schema[like].dataType))
    kept = inside.join(table(firms[alive], "firm", firm), "firm", "left_semi")
    if gone.any():
        kept = kept.join(table(workers[gone], "worker", worker), "worker", "left_anti")
    kept = kept.groupBy("worker").agg(F.sum("t").alias("t")).where("t > 1").join(kept.drop("t"), "worker").select(F.col("worker").alias(worker), F.col("firm").alias(firm))
    return df.join(keep_cut(kept), [worker, firm], "left_semi")


#: Fixed values of the keyed signs: the multipliers of a draw's number and of a unit's.
_DRAW, _UNIT = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def _mixed(x: np.ndarray) -> np.ndarray:
    """One step of the SplitMix64 generator from each state."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_states(seed: int, draw: int, unit: np.ndarray) -> np.ndarray:
    """The states of a draw's streams, one for each unit (a uint64)."""
    mask = 2**64 - 1
    own = _mixed(np.array([(seed & mask) ^ (_DRAW * (draw + 1) & mask)], np.uint64))
    return _mixed(own ^ np.uint64(_UNIT) * unit)


def _streams(seed: int, draw: int, units: int) -> np.ndarray:
    """The states of a draw's streams for units numbered from 1."""
    return keyed_states(seed, draw, np.arange(1, units + 1, dtype=np.uint64))


def sign_rows(seed: int, draw: int, n: int) -> np.ndarray:
    """n random signs, 64 from each stream, the lowest bit first."""
    bits = _streams(seed, draw, -(-n // 64))
    return ((bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).ravel()[:n] * 2.0 - 1


def sums_of_signs(state: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each stream, from its state, the sum of so many random signs."""
    state, left, out = state.copy(), counts.astype(np.int64).copy(), np.zeros(len(counts))
    live = np.flatnonzero(left > 0)
    while len(live):
        state[live] = _mixed(state[live])
        k = np.minimum(left[live], 64)
        bits = np.where(k == 64, state[live], state[live] & ((np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1)))
        out[live] += 2.0 * np.bitwise_count(bits) - k
        left[live] -= k
        live = live[left[live] > 0]
    return out


def sign_sums(seed: int, draw: int, counts: np.ndarray) -> np.ndarray:
    """For each unit the sum of so many random signs of its own stream."""
    return sums_of_signs(_streams(seed, draw, len(counts)), counts)


class Solver:
    """Solves [Dw B; B' Df] (zw, zf) = (tw, tf) with the last firm's effect at zero, for many right sides at once."""

    def __init__(self, w, f, c, n_workers, n_firms, dense: int = DENSE_FIRMS):
        self.w, self.f, self.c, self.n, self.j = w, f, c, n_workers, n_firms
        self.dw, self.df = np.bincount(w, c, n_workers), np.bincount(f, c, n_firms)
        self.inverse = None
        if n_firms <= dense:
            s = np.diag(self.df)
            order = np.argsort(w, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n_workers))])
            for i in range(n_workers):
                m = order[ends[i] : ends[i + 1]]
                s[np.ix_(f[m], f[m])] -= np.outer(c[m], c[m]) / self.dw[i]
            self.s = s
            self.inverse = np.zeros((n_firms, n_firms))
            if n_firms > 1:
                self.inverse[:-1, :-1] = np.linalg.inv(s[:-1, :-1])

    def reduced(self, x):
        by_worker = np.bincount(self.w, self.c * x[self.f], self.n) / self.dw
        out = self.df * x - np.bincount(self.f, self.c * by_worker[self.w], self.j)
        out[-1] = 0
        return out

    def firms(self, right, tol: float = 1e-12):
        if self.inverse is not None:
            return self.inverse @ right
        x, res = np.zeros(self.j), right.copy()
        res[-1] = 0
        scale = np.maximum(self.df, 1e-300)
        z = res / scale
        p, rz, goal = z.copy(), res @ z, tol * (np.linalg.norm(res) or 1.0)
        for _ in range(20_000):
            if np.linalg.norm(res) <= goal:
                return x
            q = self.reduced(p)
            step = rz / (p @ q)
            x += step * p
            res -= step * q
            z = res / scale
            rz, old = res @ z, rz
            p = z + rz / old * p
        raise RuntimeError("the worker-firm system did not settle")

    def solve(self, tw, tf):
        zf = self.firms(tf - np.bincount(self.f, self.c * (tw / self.dw)[self.w], self.j))
        return (tw - np.bincount(self.w, self.c * zf[self.f], self.n)) / self.dw, zf

    def exact(self, block: int = 512):
        """For each match: leverage of a row, and its weights in the variances of firms, workers and their covariance."""
        if self.inverse is None:
            raise ValueError(f"exact leverages need {DENSE_FIRMS} firms at most")
        n = self.dw.sum()
        order = np.argsort(self.w, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.w, minlength=self.n))])
        inner = np.diag(self.df) - self.s
        out = np.zeros((4, len(self.w)))
        for low in range(0, len(self.w), block):
            m = np.arange(low, min(low + block, len(self.w)))
            q = np.zeros((len(m), self.j))
            for i, k in enumerate(m):
                mine = order[ends[self.w[k]] : ends[self.w[k] + 1]]
                q[i, self.f[mine]] = self.c[mine] / self.dw[self.w[k]]
            r = -q
            r[np.arange(len(m)), self.f[m]] += 1
            z = r @ self.inverse
            d = 1 / self.dw[self.w[m]]
            qz, inside, sums = (q * z).sum(1), ((z @ inner) * z).sum(1), z @ self.df
            out[0, m] = d + (r * z).sum(1)
            out[1, m] = (z * z) @ self.df - sums**2 / n
            out[2, m] = d - 2 * qz + inside - (1 - sums) ** 2 / n
            out[3, m] = qz - inside - (1 - sums) * sums / n
        return out

    def sketched(self, draws: int, seed: int, by_match: bool):
        """As exact(), from random signs; and the factor that corrects the bias of dividing by an estimated 1 - leverage.

        At match level the leverage is that of a match. Signs are keyed by seed, draw and unit: the matches in order of worker and firm,
        for their own signs in blocks of 64. At observation level a match's rows are alike, so what counts is how many have
        which sign; that number comes from another generator, keyed alike.
        """
        n, t, m = self.dw.sum(), self.c, len(self.w)
        whole = t.astype(np.int64)
        p1, p2, m1, m2, pm, fe, pe, cov = np.zeros((8, m))
        for k in range(draws):
            rng = np.random.Generator(np.random.Philox(key=[seed, k]))
            sums = sign_sums(seed, 3 * k + 1, whole)
            if by_match:
                r = sign_rows(seed, 3 * k, m)
                root = np.sqrt(t)
                zw, zf = self.solve(np.bincount(self.w, root * r, self.n), np.bincount(self.f, root * r, self.j))
                z = root * (zw[self.w] + zf[self.f])
                far2, far4 = (r - z) ** 2, (r - z) ** 4
            else:
                r = 2.0 * rng.binomial(whole, 0.5) - t
                zw, zf = self.solve(np.bincount(self.w, r, self.n), np.bincount(self.f, r, self.j))
                z = zw[self.w] + zf[self.f]
                up = (t + r) / 2 / t
                far2, far4 = up * (1 - z) ** 2 + (1 - up) * (1 + z) ** 2, up * (1 - z) ** 4 + (1 - up) * (1 + z) ** 4
            p1 += z**2 / draws
            p2 += z**4 / draws
            m1 += far2 / draws
            m2 += far4 / draws
            pm += z**2 * far2 / draws
            v = (sums - t * sums.sum() / n) / math.sqrt(draws)
            aw, af = self.solve(np.zeros(self.n), np.bincount(self.f, v, self.j))
            bw, bf = self.solve(np.bincount(self.w, v, self.n), np.zeros(self.j))
            a, b = aw[self.w] + af[self.f], bw[self.w] + bf[self.f]
            fe += a * a
            pe += b * b
            cov += a * b
        p = p1 / (p1 + m1)
        left = np.maximum(1 - p, 1e-300)
        var = (left**2 * p2 + p**2 * m2 - 2 * left * p * pm) / draws
        bias = (left * p2 - p * m2 + 2 * (left - p) * pm) / draws
        # a leverage of 1 (a stayer's match) has no correction; it isn't used there
        return np.stack([p / t if by_match else p, fe, pe, cov]), np.where(left > 1e-300, 1 - var / np.maximum(left, 1e-150) ** 2 + bias / left, 1.0)


def quantile_groups(x: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The group of each value, from 0, by cuts at i (N + 1) / groups of the N sorted values, each counted weight times.

    Cuts are interpolated between neighbours; a value equal to a cut is above it.
    """
    order = np.argsort(x, kind="stable")
    ends = np.cumsum(weight[order])
    n = int(ends[-1])
    value = lambda k: x[order][np.searchsorted(ends, k, "left")]  # noqa: E731  the k-th of all, from 1
    at = np.arange(1, groups) * (n + 1) / groups
    low = np.floor(at)
    part = at - low
    low = np.clip(low, 1, max(n - 1, 1))
    cuts = (1 - part) * value(low) + part * value(np.minimum(low + 1, n))
    return np.searchsorted(cuts, x, "right")


def lowess(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A local linear surface of y over two predictors, at each point: tricube weights over the nearest n^(2/3) of the n points.

    Points count weight times; y is the mean of a point. Predictors are scaled first. Quadratic in the points.
    """
    n = weight.sum()

    def scaled(v):
        v = v - (weight * v).sum() / n
        sd = math.sqrt((weight * v * v).sum() / (n - 1)) if n > 1 else 1.0
        return v / sd if sd > 0 else v * 0

    x1, x2 = scaled(x1), scaled(x2)
    near = min(max(math.ceil(n ** (2 / 3)), 3), n)
    out = np.empty(len(y))
    for i in range(len(y)):
        a, b = x1 - x1[i], x2 - x2[i]
        d = np.sqrt(a * a + b * b)
        order = np.argsort(d, kind="stable")
        far = d[order][np.searchsorted(np.cumsum(weight[order]), near, "left")]
        w = weight * (np.clip(1 - (d / far) ** 3, 0, None) ** 3 if far > 0 else (d <= 0))
        z = np.stack([np.ones(len(y)), a, b])
        gram, right = (z * w) @ z.T, (z * w) @ y
        out[i] = np.linalg.solve(gram, right)[0] if np.linalg.matrix_rank(gram) == 3 else right[0] / gram[0, 0] if gram[0, 0] > 0 else y[i]
    return out


def component_errors(k: Solver, m: dict[str, np.ndarray], alpha: np.ndarray, psi: np.ndarray, weights: tuple, by_match: bool, draws: int = 1000, seed: int = 1, smooth: str = "bins", grid: int = 1000) -> dict[str, tuple[float, float]]:
    """(estimate, standard error) of each component, where many effects make it nearly normal.

    With y = X b + e and errors of a variance smoothed over leverage and weight, a component is a quadratic form of y without its
    diagonal blocks; its variance is 4 W' S W less that of the same form of errors alone, which draws simulate. m holds the
    matches' t, s, ss and leverages p; all terms are sums over matches. var_alpha is told for observations only.
    """
    w, f, t, n = k.w, k.f, k.c, k.dw.sum()
    s, ss, fitted = m["s"], m["ss"], alpha[k.w] + psi[k.f]
    stays = np.bincount(w, minlength=k.n)[w] < 2
    p = np.where(stays, 1 / k.dw[w], m["p"])
    block = t if by_match else np.ones(len(t))
    left = 1 - block * p
    gain = np.where(left > 1e-12, p / np.where(left > 1e-12, left, 1), 0.0)
    eta = s - t * fitted  # a match's sum of residuals
    # sums over a match of y times its left-out residual, and of that residual
    raw = ss - s * fitted + gain * eta * s if by_match else (ss - s * fitted) / np.where(left > 1e-12, left, 1)
    eta_h = eta * (1 + t * gain) if by_match else eta / np.where(left > 1e-12, left, 1)
    psi, alpha = psi - k.df @ psi / n, alpha - k.dw @ alpha / n
    key = quantile_groups(p.astype(np.float32).astype(float), t, grid)
    first = {}
    for i in np.flatnonzero(stays & (t > 1)):
        first.setdefault(t[i], i)
    names = ["var_psi", "cov_alpha_psi", *([] if by_match else ["var_alpha"])]
    plain = {"var_psi": k.df @ psi**2, "cov_alpha_psi": (t * alpha[w]) @ psi[f], "var_alpha": k.dw @ alpha**2}
    out = {}
    for name in names:
        base = weights[{"var_psi": 0, "var_alpha": 1, "cov_alpha_psi": 2}[name]].copy()
        if name == "var_alpha":
            base[stays] = [base[first[x]] if x in first else 0.0 for x in t[stays]]
        else:
            base[stays] = 0.0
        theta = (plain[name] - (base * (s * eta_h if by_match else raw)).sum()) / n
        if smooth == "lowess":
            spread = lowess(p, base, raw / t, t)
        else:
            cell = quantile_groups(base.astype(np.float32).astype(float), t, grid) * np.int64(grid + 1) + key
            _, cell = np.unique(cell, return_inverse=True)
            spread = (np.bincount(cell, raw) / np.bincount(cell, t))[cell]

        def form(a, b, c, d):
            """The component's quadratic form of effects (a, b) with (c, d)."""
            centre = lambda x, df: x - df @ x / n
            if name == "var_psi":
                return (k.df * centre(b, k.df) * centre(d, k.df).conj()).sum()
            if name == "var_alpha":
                return (k.dw * centre(a, k.dw) * centre(c, k.dw).conj()).sum()
            return 0.5 * (t * centre(a, k.dw)[w] * centre(d, k.df).conj()[f] + t * centre(c, k.dw).conj()[w] * centre(b, k.df)[f]).sum()

        none_w, none_f = np.zeros(k.n), np.zeros(k.j)
        if name == "var_psi":
            bw, bf = k.solve(none_w, k.df * psi)
        elif name == "var_alpha":
            bw, bf = k.solve(k.dw * alpha, none_f)
        else:
            bw, bf = k.solve(0.5 * np.bincount(w, t * psi[f], k.n), 0.5 * np.bincount(f, t * alpha[w], k.j))
        # what a row gets from the diagonal blocks: of a match's sum of y, or of the row's own y
        turned = np.where(left > 1e-12, left, 1)
        if by_match:
            u = np.where(base == 0, 0.0, base * s / turned)  # the same for all rows of a match
            xw, xf = k.solve(np.bincount(w, t * u, k.n), np.bincount(f, t * u, k.j))
            row = bw[w] + bf[f] - 0.5 * (base * eta_h + u - xw[w] - xf[f])
            total = (t * row**2 * spread).sum()
        else:
            # a row's y and residual differ within a match: row = c + g y + h, with sums of y and its square
            g = -0.5 * (base / turned + base / turned)
            xw, xf = k.solve(np.bincount(w, base * s / turned, k.n), np.bincount(f, base * s / turned, k.j))
            c = bw[w] + bf[f] + 0.5 * (base * fitted / turned + xw[w] + xf[f])
            total = ((t * c**2 + 2 * c * g * s + g**2 * ss) * spread).sum()
        scale = np.sqrt(spread.astype(complex))
        forms = np.zeros(draws, complex)
        for i in range(draws):
            rng = np.random.Generator(np.random.Philox(key=[seed, i]))
            z = rng.standard_normal(len(t))
            v = scale * np.sqrt(t) * z  # a match's sum of errors
            re, im = k.solve(np.bincount(w, v.real, k.n), np.bincount(f, v.real, k.j)), (k.solve(np.bincount(w, v.imag, k.n), np.bincount(f, v.imag, k.j)) if v.imag.any() else (0.0, 0.0))
            ew, ef = re[0] + 1j * im[0], re[1] + 1j * im[1]
            at = ew[w] + ef[f]
            if by_match:
                own = (base * v.conj() * (v - t * at) * (1 + t * gain)).sum()
            else:
                squares = np.abs(spread) * (z**2 + np.where(t > 1, rng.chisquare(np.maximum(t - 1, 1e-9)), 0.0))
                own = (base / turned * (squares - v.conj() * at)).sum()
            forms[i] = form(ew, ef, ew, ef) - own
        below = float((np.abs(forms - forms.mean()) ** 2).sum() / (draws - 1))
        out[name] = (float(theta), math.sqrt(max(4 * total - below, 0.0)) / n)
    return out


def eigen_shares(k: Solver, name: str, top: int = 3, draws: int = 100, seed: int = 1, rounds: int = 200) -> dict:
    """How much of a component few directions make up: its form's greatest eigenvalues (by size) in the metric of the fit, the
    trace of the form's square (by random signs), and each squared eigenvalue's share of it. A share near 1 means that
    the component isn't nearly normal. By subspace iterations."""
    n, w, f, t = k.dw.sum(), k.w, k.f, k.c

    def applied(a, b):
        """The form's matrix on effects (a, b)."""
        if name == "var_psi":
            return 0 * a, k.df * (b - k.df @ b / n)
        if name == "var_alpha":
            return k.dw * (a - k.dw @ a / n), 0 * b
        return 0.5 * np.bincount(w, t * (b - k.df @ b / n)[f], k.n), 0.5 * np.bincount(f, t * (a - k.dw @ a / n)[w], k.j)

    def step(v):
        return np.stack([np.concatenate(k.solve(*applied(x[: k.n], x[k.n :]))) for x in v.T], 1)

    fitted = lambda v: v[: k.n][w] + v[k.n :][f]
    size = min(top + 4, k.j - 1)
    v = np.random.default_rng(seed).standard_normal((k.n + k.j, max(size, 1)))
    values = np.zeros(max(size, 1))
    for _ in range(rounds):
        v = step(v)
        x = np.stack([fitted(c) for c in v.T], 1) * np.sqrt(t)[:, None]
        _, r = np.linalg.qr(x)
        v = v @ np.linalg.pinv(r)
        inner = np.array([[np.concatenate(applied(a[: k.n], a[k.n :])) @ b for a in v.T] for b in v.T])
        e, q = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-np.abs(e))
        v, e = v @ q[:, order], e[order]
        if np.abs(e - values).max() <= 1e-12 * np.abs(e).max():
            values = e
            break
        values = e
    trace = 0.0
    for i in range(draws):
        rng = np.random.Generator(np.random.Philox(key=[seed, i]))
        signs = 2.0 * rng.binomial(t.astype(np.int64), 0.5) - t  # a match's sum of its rows' signs
        a = k.solve(*applied(*k.solve(np.bincount(w, signs, k.n), np.bincount(f, signs, k.j))))
        trace += (t * (a[0][w] + a[1][f]) ** 2).sum() / draws
    return {"values": values[:top].tolist(), "trace": float(trace), "shares": (values[:top] ** 2 / trace).tolist() if trace else []}


@dataclass
class Components:
    """Variances of firm and worker effects and their covariance: plain, corrected, and corrected for one error variance."""

    plugin: dict[str, float]
    kss: dict[str, float]
    agsu: dict[str, float]
    var_y: float
    sigma2_ho: float
    n: int
    workers: int
    firms: int
    matches: int
    leverages: str
    effects: DataFrame
    rows: DataFrame
    beta: dict[str, float] = field(default_factory=dict)
    lincom: list[dict] = field(default_factory=list)
    errors: dict[str, tuple[float, float]] = field(default_factory=dict)
    eigen: dict[str, dict] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        rows = [(k, self.plugin[k], self.kss[k], self.agsu[k], self.kss[k] / self.var_y if self.var_y else float("nan")) for k in self.plugin]
        return self.rows.sparkSession.createDataFrame(rows, "component string, plugin double, kss double, agsu double, share double")

    def export(self, path: str, kind: str = "parquet") -> None:
        """Write <path>_effects, _rows and _components as parquet or csv."""
        if kind not in ("parquet", "csv"):
            raise ValueError(f"export as {kind!r}")
        for name, df in (("effects", self.effects), ("rows", self.rows), ("components", self.frame())):
            df.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(f"{path}_{name}")


def akm_kss(df: DataFrame, y: str, worker: str, firm: str, controls: list[str] = (), z: list[str] = (), level: str = "match", leverages: str = "auto", draws: int = 200, seed: int = 20260705, prune: bool = True, weights: str | None = None, errors: bool = False, smooth: str = "bins", error_draws: int = 1000, eigen: bool = False, progress=None, spread: bool | None = None) -> Components:
    """Variance components of y = worker + firm + controls, leaving out matches or observations (level: match or obs).

    leverages: exact, jla (random signs) or auto. z: columns onto which firm effects are projected. Workers with one row and
    rows that aren't leave-out connected go with prune; without, a row with leverage 1 raises. weights: frequency weights, at
    match level and without z or errors. errors: also component_errors(), with variances smoothed by bins or lowess. eigen: also eigen_shares() of each component.
    progress: called with a line of text at each step. spread: solve in the cluster (None: beyond MOST_MATCHES); there random signs are keyed by
    seed, draw, worker and firm, so they differ from the driver's.
    """
    say = progress or (lambda text: None)
    if weights and (level != "match" or z or errors):
        raise ValueError("frequency weights go with the match level, without projections or standard errors")
    if smooth not in ("bins", "lowess"):
        raise ValueError(f"smooth {smooth!r}")
    if level not in ("match", "obs") or leverages not in ("auto", "exact", "jla"):
        raise ValueError(f"level {level!r}, leverages {leverages!r}")
    picked = df.select(F.col(y).cast("double").alias("y"), F.col(worker).alias("worker"), F.col(firm).alias("firm"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(controls)], *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)], *([F.col(weights).cast("double").alias("wt")] if weights else []))
    if weights:
        if picked.where("wt <= 0 OR wt <> floor(wt)").head(1):
            raise ValueError("weights must be positive whole numbers")
    rows = check(picked, ["y", *(["wt"] if weights else []), *[f"x{i}" for i in range(len(controls))], *[f"z{i}" for i in range(len(z))]], ["worker", "firm"])
    own = "wt" if weights else None
    rows = keep_cut(leave_out_set(rows, "worker", "firm", own) if prune else rows)
    say("the leave-out set is made")
    of = F.col("wt") if weights else F.lit(1.0)
    n, mean_y = rows.agg(F.sum(of), F.sum(of * F.col("y")) / F.sum(of)).first()
    n = int(n or 0)
    var_y = rows.agg(F.sum(of * (F.col("y") - F.lit(mean_y)) ** 2)).first()[0] / (n - 1) if n > 1 else None
    if not n:
        raise ValueError("the leave-out set is empty")
    beta: dict[str, float] = {}
    if controls:
        r = fit(rows, "y", [f"x{i}" for i in range(len(controls))], ["worker", "firm"], drop_singletons_=False, weights=own, fweights=bool(weights))
        beta = dict(zip(controls, r.coef[: len(controls)].tolist(), strict=True))
        rows = rows.withColumn("y", F.col("y") - sum((F.col(f"x{i}") * b for i, b in enumerate(beta.values())), F.lit(0.0)))
    by_match = level == "match"
    table = keep_cut(matches(rows, "y", "worker", "firm", own, [f"z{i}" for i in range(len(z))]))
    if spread or spread is None and table.count() > MOST_MATCHES:
        if errors or eigen:
            raise ValueError("standard errors and eigenvalue shares are for matches that the driver takes")
        return _spread_components(rows, table, z, by_match, leverages, draws, seed, n, mean_y, float(var_y or 0.0), beta, say)
    m = _arrow(table).sort_values(["worker", "firm"], ignore_index=True)
    w, workers = m["worker"].factorize(sort=True)
    f, firms = m["firm"].factorize(sort=True)
    t, s, ss = (m[c].to_numpy(float) for c in ("t", "s", "ss"))
    k = Solver(w, f, t, len(workers), len(firms))
    alpha, psi = k.solve(np.bincount(w, s, k.n), np.bincount(f, s, k.j))
    use = leverages if leverages != "auto" else "exact" if (len(m) if by_match else n) <= EXACT_ROWS and k.inverse is not None else "jla"
    if use == "exact":
        (p, fe, pe, cov), corr = k.exact(), np.ones(len(m))
    else:
        (p, fe, pe, cov), corr = k.sketched(draws, seed, by_match)
    fitted = alpha[w] + psi[f]
    mean = s.sum() / n
    # sums over a match's rows of (y - c) times the residual
    product = lambda c: ss - s * (c + fitted) + t * c * fitted
    if by_match:
        root = np.sqrt(t)
        yt = root * s / t
        left, stays = 1 - t * p, np.bincount(w, minlength=k.n)[w] < 2
        with np.errstate(divide="ignore", invalid="ignore"):
            sigma = t * np.where(stays, product(mean) / (1 - 1 / k.dw[w]) / t, (yt - yt.mean()) * corr * (yt - root * fitted) / left)
        bad = ~stays & (left <= 1e-12)
        squares = t * (yt - root * fitted) ** 2
    else:
        left = 1 - p
        with np.errstate(divide="ignore", invalid="ignore"):
            sigma = product(mean) * corr / left
        bad = left <= 1e-12
        squares = ss - 2 * s * fitted + t * fitted**2
    if bad.any() or not np.isfinite(sigma).all():
        raise ValueError(f"{int(bad.sum())} matches have leverage 1: the sample isn't leave-out connected")
    psi_mean = k.df @ psi / n
    psi, alpha = psi - psi_mean, alpha + psi_mean
    centred = alpha - k.dw @ alpha / n
    names = ("var_psi", "var_alpha", "cov_alpha_psi")
    plain = np.array([k.df @ psi**2, k.dw @ centred**2, (t * centred[w]) @ psi[f]]) / (n - 1)
    weights_ = (fe, pe, cov)
    free = n - (k.n + k.j - 1)
    rss = float((ss - 2 * s * fitted + t * fitted**2).sum())
    one = rss / free if free > 0 else 0.0
    kss = plain - np.array([b @ sigma for b in weights_]) / (n - 1)
    agsu = plain - one * np.array([b @ t for b in weights_]) / (n - 1)
    spark = rows.sparkSession
    import pyarrow as pa

    table = lambda name, index, value, values: spark.createDataFrame(pa.table({name: pa.array(index), value: values})).withColumn(name, F.col(name).cast(rows.schema[name].dataType))
    a, b = table("worker", workers, "alpha", alpha), table("firm", firms, "psi", psi)
    effects = a.select(F.lit("worker").alias("kind"), F.col("worker").cast("string").alias("id"), F.col("alpha").alias("effect")).unionByName(b.select(F.lit("firm").alias("kind"), F.col("firm").cast("string").alias("id"), F.col("psi").alias("effect")))
    told = []
    if z:
        zs = [F.lit(1.0), *[F.col(f"z{i}") for i in range(len(z))]]
        at = _arrow(rows.groupBy("firm").agg(*[F.sum(c).alias(f"z{i}") for i, c in enumerate(zs)])).set_index("firm").reindex(firms).to_numpy(float)
        gram = rows.agg(F.array(*[F.sum(u * v) for u in zs for v in zs])).first()[0]
        inverse = np.linalg.inv(np.array(gram).reshape(len(zs), -1))
        coef = inverse @ (at.T @ psi)
        for i, c in enumerate(z, 1):
            zw, zf = k.solve(np.zeros(k.n), at @ inverse[i])
            x2 = (zw[w] + zf[f]) ** 2
            se = math.sqrt(max(sigma @ x2, 0.0))
            told.append({"term": c, "coef": float(coef[i]), "se": se, "se_white": math.sqrt(squares @ x2), "t": float(coef[i]) / se if se else float("nan")})
    found = component_errors(k, {"t": t, "s": s, "ss": ss, "p": p}, alpha - psi_mean, psi + psi_mean, weights_, by_match, error_draws, seed, smooth) if errors else {}
    say("the components are estimated")
    three = lambda v: dict(zip(names, map(float, v), strict=True))
    return Components(three(plain), three(kss), three(agsu), float(var_y or 0.0), one, n, k.n, k.j, len(m), use, effects, rows.join(a, "worker").join(b, "firm"), beta, told, found, {c: eigen_shares(k, c, seed=seed) for c in names} if eigen else {})


def _spread_components(rows: DataFrame, table: DataFrame, z: list[str], by_match: bool, leverages: str, draws: int, seed: int, n: int, mean: float, var_y: float, beta: dict, say) -> Components:
    """akm_kss() with all that grows in the cluster: effects, leverages and weights are columns of the match table, and components are its sums."""
    from .spread_akm import DENSE_FIRMS, SpreadSystem

    extra: list[str] = []
    zs = [F.lit(1.0), *[F.col(f"z{i}") for i in range(len(z))]]
    if z:
        gram = np.array(rows.agg(F.array(*[F.sum(u * v) for u in zs for v in zs])).first()[0]).reshape(len(zs), -1)
        inverse = np.linalg.inv(gram)
        extra = [f"extra{i}" for i in range(1, len(zs))]
        of_match = [F.col("t").cast("double"), *zs[1:]]
        table = table.withColumns({e: sum((float(inverse[i, j]) * v for j, v in enumerate(of_match)), F.lit(0.0)) for i, e in enumerate(extra, 1)})
    system = SpreadSystem(table, extra)
    use = leverages if leverages != "auto" else "exact" if (system.n_matches if by_match else n) <= EXACT_ROWS else "jla"
    if use == "exact" and system.n_firms > DENSE_FIRMS and system.n_matches > EXACT_ROWS:
        raise ValueError(f"exact leverages need {DENSE_FIRMS} firms or {EXACT_ROWS} matches at most")
    # up to so many firms, all that is told of a match comes from its block
    alone = use == "exact" and system.n_firms <= DENSE_FIRMS and system.few(max(len(extra), 1)) and not system.n_hot
    found = None if alone else system.exact(n) if use == "exact" else system.sketched(draws, seed, by_match, n)
    say("the leverages are made")
    if found is None:
        light, m = system.every(), system.every(n)
    else:
        of_worker = system.matches.groupBy("w").agg(F.sum("t").cast("double").alias("dw"), F.count(F.lit(1)).alias("nw"))
        m = system.matches.drop("worker", "firm").withColumnsRenamed({e: f"e{i}" for i, e in enumerate(extra)}).join(system.effects(), ["w", "f"]).join(found, ["w", "f"]).join(of_worker, "w")
        light = m = keep_cut(m.join(system.of_extra(len(extra)), ["w", "f"]) if z else m)
    t, s, ss, fitted = F.col("t").cast("double"), F.col("s"), F.col("ss"), F.col("alpha") + F.col("psi")
    root_mean, psi_mean, alpha_mean = light.agg(F.avg(F.col("s") / F.sqrt(t)), F.sum(t * F.col("psi")) / n, F.sum(t * F.col("alpha")) / n).first()
    product = ss - s * (F.lit(mean) + fitted) + t * mean * fitted
    squares = ss - 2 * s * fitted + t * fitted**2
    if by_match:
        left, stays, root = 1 - t * F.col("p"), F.col("nw") < 2, F.sqrt(t)
        y = s / root
        sigma = F.when(stays, product / (1 - 1 / F.col("dw"))).otherwise(t * (y - root_mean) * F.col("corr") * (y - root * fitted) / left)
        bad, white = ~stays & (left <= 1e-12), t * (y - root * fitted) ** 2
    else:
        left = 1 - F.col("p")
        sigma, bad, white = product * F.col("corr") / left, left <= 1e-12, squares
    m = m.withColumn("bad", bad).withColumn("sigma", F.when(~F.col("bad"), sigma)).withColumn("white", white)
    psi, alpha = F.col("psi") - psi_mean, F.col("alpha") - alpha_mean
    weights = ("fe", "pe", "cov")
    told = m.agg(F.sum(t * psi**2), F.sum(t * alpha**2), F.sum(t * alpha * psi), *[F.sum(F.col(c) * F.col("sigma")) for c in weights], *[F.sum(F.col(c) * t) for c in weights], F.sum(squares), F.sum(F.when(F.col("bad") | F.col("sigma").isNull() | F.isnan("sigma"), 1).otherwise(0)), *[F.sum(F.col(f"e{i}") * psi) for i in range(len(z))], *[F.sum(F.col(c) * F.col(f"u{i}") ** 2) for i in range(len(z)) for c in ("sigma", "white")]).first()
    if told[10]:
        raise ValueError(f"{told[10]} matches have leverage 1: the sample isn't leave-out connected")
    plain, corrected, one_each = (np.array(told[i : i + 3], float) / (n - 1) for i in (0, 3, 6))
    free = n - (system.n_workers + system.n_firms - 1)
    one = told[9] / free if free > 0 else 0.0
    named = system.matches.select("w", "f", "worker", "firm").join(light.select("w", "f", "alpha", "psi"), ["w", "f"])
    effects_a = named.groupBy("worker").agg((F.first("alpha") + psi_mean).alias("alpha"))
    effects_b = named.groupBy("firm").agg((F.first("psi") - psi_mean).alias("psi"))
    shown = effects_a.select(F.lit("worker").alias("kind"), F.col("worker").cast("string").alias("id"), F.col("alpha").alias("effect")).unionByName(effects_b.select(F.lit("firm").alias("kind"), F.col("firm").cast("string").alias("id"), F.col("psi").alias("effect")))
    lincom = []
    if z:
        coef, spreads = told[11 : 11 + len(z)], told[11 + len(z) :]
        for i, c in enumerate(z):
            se = math.sqrt(max(spreads[2 * i], 0.0))
            lincom.append({"term": c, "coef": float(coef[i]), "se": se, "se_white": math.sqrt(spreads[2 * i + 1]), "t": float(coef[i]) / se if se else float("nan")})
    say("the components are estimated")
    three = lambda v: dict(zip(("var_psi", "var_alpha", "cov_alpha_psi"), map(float, v), strict=True))
    return Components(three(plain), three(plain - corrected), three(plain - one * one_each), var_y, one, n, system.n_workers, system.n_firms, system.n_matches, use, shown, rows.join(effects_a, "worker").join(effects_b, "firm"), beta, lincom)


def bipartite(df: DataFrame, y: str, worker: str, firm: str, order: list[str]) -> DataFrame:
    """Columns i, j, y and t, the number of the row in its worker by the columns of order, from 0."""
    t = F.row_number().over(Window.partitionBy(worker).orderBy(*order)) - 1
    return df.select(F.col(worker).alias("i"), F.col(firm).alias("j"), F.col(y).alias("y"), t.alias("t"))


def leave_out_csv(df: DataFrame, path: str) -> None:
    """Write y, worker, firm of a bipartite() frame without header, in order of worker and t."""
    df.orderBy("i", "t").select("y", "i", "j").write.mode("overwrite").csv(path)


def subsampling(df: DataFrame, y: str, worker: str, firm: str, fractions: list[float] = (0.0, 0.1, 0.3, 0.5), reps: int = 1, seed: int = 1, **options) -> list[dict]:
    """Components of the leave-out set after dropping a fraction of its movers, whole workers drawn without replacement: how they
    move tells how much mobility they need. Fraction 0 is done once. The movers' ids are counted before they go to the driver.
    """
    import pandas as pd
    import pyarrow as pa

    base = keep_cut(leave_out_set(df.where(F.col(worker).isNotNull() & F.col(firm).isNotNull()), worker, firm))
    movers = _arrow(base.groupBy(worker).agg(F.countDistinct(firm).alias("n")).where("n > 1").select(worker))[worker].sort_values().to_numpy()
    out = []
    for share in fractions:
        for rep in range(1 if share == 0 else reps):
            rows = base
            if share:
                draws = np.random.default_rng(np.random.SeedSequence([int(seed), round(share * 1e6), rep]))
                gone = draws.choice(movers, size=round(share * len(movers)), replace=False)
                table = df.sparkSession.createDataFrame(pa.Table.from_pandas(pd.DataFrame({worker: gone}), preserve_index=False)).withColumn(worker, F.col(worker).cast(df.schema[worker].dataType))
                rows = base.join(table, worker, "left_anti")
            if rows.limit(3).count() < 3:
                continue
            r = akm_kss(rows, y, worker, firm, **options)
            n_movers = r.rows.groupBy("worker").agg(F.countDistinct("firm").alias("n")).where("n > 1").count()
            out.append({"fraction": float(share), "rep": rep, "n": r.n, "movers": n_movers, "firms": r.firms, **{f"{kind}_{k}": v for kind, told in (("plugin", r.plugin), ("kss", r.kss), ("agsu", r.agsu)) for k, v in told.items()}})
    return out
