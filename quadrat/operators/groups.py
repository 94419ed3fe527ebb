"""Models of outcomes of groups, whose members' individual effects add up (or average) in each group.

df has a row for each member of a group. The group's own columns are constant in it and are collapsed to one row; the
pairs (group, individual) are the bridge. Individual effects enter a group's row through the bridge, so the
projection is solved on levels by conjugate gradients, whose products go from levels to groups and back. Up to MOST_PAIRS
members, counted first, the driver does so; beyond, tasks do (spread_groups.py). Members are gathered in a row for each group, so neither
the search for singletons nor the projection shuffles the bridge again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import absorbed
from .model import Result, fit
from .sample import check, collapse, counted, keep_cut

MOST_PAIRS = 20_000_000


def shared_singletons(df: DataFrame, group: str, individual: str, fes: list[str], most_rounds: int = 200) -> DataFrame:
    """Drop whole groups until each level of fes and each individual is in two groups or more."""
    pairs = keep_cut(df.select(group, individual, *fes).distinct())
    left = _settled(pairs, group, [*fes, individual], lambda t, key: t.select(group, key), most_rounds)
    if left is pairs:
        return df.where(F.col(group).isNotNull())
    return df.join(left.select(group).distinct(), group, "left_semi")


def _settled(table: DataFrame, group: str, keys: list[str], pairs, most_rounds: int = 200) -> DataFrame:
    """table without the groups of shared_singletons(), itself if there are none; pairs(table, key) are its groups and levels, repeated or not.

    A level is alone if its least group is its greatest, so tasks send one row for each level that they have, and no pair is shuffled."""
    for _ in range(most_rounds):
        before = table
        for key in keys:
            ends = pairs(table, key).groupBy(F.col(key).alias("__key")).agg(F.min(group).alias("__low"), F.max(group).alias("__high"))
            alone = keep_cut(ends.where(F.col("__low").eqNullSafe(F.col("__high"))).select(F.col("__low").alias(group)).distinct())
            if number := alone.count():
                table = keep_cut(table.join(counted(alone, number), group, "left_anti"))
        if table is before:
            return table
    raise RuntimeError("singletons did not settle")


def _gathered(rows: DataFrame, group: str, individual: str, columns: list[str]) -> DataFrame:
    """A row for each group: its columns, whether one varies, and its members (__members), each once."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.min(c) != F.max(c))
    return rows.groupBy(group).agg(*[F.min(c).alias(c) for c in columns], differs.alias("__varies"), F.sort_array(F.collect_set(individual)).alias("__members"))


def _project(table, bridge, columns: list[str], fes: list[str], weight, aggregation: str, tol: float = 1e-13):
    """Columns of table less what individual effects (bridge: row, level) and fes explain; the coefficients, and rounds."""
    row, level = bridge
    n, w = len(table), np.ones(len(table)) if weight is None else table[weight].to_numpy(float)
    size = np.bincount(row, minlength=n)
    share = 1.0 / size[row] if aggregation == "mean" else np.ones(len(row))
    codes = [table[k].factorize()[0] for k in fes]
    starts = np.concatenate([[0], np.cumsum([level.max(initial=-1) + 1, *[c.max(initial=-1) + 1 for c in codes]])])

    def spread(x):
        out = np.bincount(row, share * x[: starts[1]][level], n)
        for d, c in enumerate(codes):
            out += x[starts[d + 1] : starts[d + 2]][c]
        return out

    def gather(v):
        return np.concatenate([np.bincount(level, share * (w * v)[row], starts[1]), *[np.bincount(c, w * v, starts[d + 2] - starts[d + 1]) for d, c in enumerate(codes)]])

    scale = np.maximum(np.concatenate([np.bincount(level, share**2 * w[row], starts[1]), *[np.bincount(c, w, starts[d + 2] - starts[d + 1]) for d, c in enumerate(codes)]]), 1e-300)
    solved, rounds = [], 0
    for c in columns:
        b = gather(table[c].to_numpy(float))
        x, res = np.zeros(len(b)), b.copy()
        z = res / scale
        p, rz, goal, k = z.copy(), res @ z, tol * (np.linalg.norm(b) or 1.0), 0
        for k in range(20_000):
            if np.linalg.norm(res) <= goal or rz <= 0:
                break
            v = spread(p)
            step = rz / (w * v @ v)
            x += step * p
            res -= step * gather(v)
            z = res / scale
            rz, old = res @ z, rz
            p = z + rz / old * p
        if np.linalg.norm(res) > 1e-8 * (np.linalg.norm(b) or 1.0):
            raise RuntimeError("individual effects did not settle")
        rounds = max(rounds, k)
        solved.append(x)
    return [table[c].to_numpy(float) - spread(x) for c, x in zip(columns, solved, strict=True)], np.stack(solved, 1), starts, rounds


def fit_groups(df: DataFrame, y: str, x: list[str], group: str, fes: list[str] = (), individual: str | None = None, aggregation: str = "mean", spread: bool | None = None, weights: str | None = None, clusters: list[str] = (), se_type: str = "unadjusted", na_action: str = "raise", **options) -> Result:
    """Fit y on x over groups, one row each. individual: also absorb members' effects, as their mean or sum in the group.

    y, x, fes, weights and clusters must be constant in a group, or it raises. With individual, result.absorption["individual"]
    is a DataFrame of individual effects (each up to what the other effects leave free), and instruments aren't taken. spread: project in the cluster
    (None: beyond MOST_PAIRS members).
    """
    if aggregation not in ("mean", "sum"):
        raise ValueError(f"aggregation {aggregation!r}")
    fes, clusters = [f for f in fes if f != individual], list(clusters)
    own = list(dict.fromkeys([y, *x, *fes, *clusters, *([weights] if weights else [])]))
    own = [c for c in own if c != group]
    if individual is None:
        return fit(collapse(df, group, own), y, x, fes, weights=weights, clusters=clusters, se_type=se_type, na_action=na_action, **options)
    if options.keys() & {"endogenous", "instruments", "retain_fes"}:
        raise ValueError("individual effects go with neither instruments nor retained effects")
    rows = check(df.select(group, individual, *own), [y, *x, *([weights] if weights else [])], list(dict.fromkeys([group, individual, *fes, *clusters])), na_action)
    gathered = keep_cut(_gathered(rows, group, individual, own))
    members = lambda t, *kept: t.select(*[c for c in kept if c != individual], F.explode("__members").alias(individual))
    gathered = _settled(gathered, group, [*fes, individual], lambda t, key: members(t, group) if key == individual else t.select(group, key))
    if not gathered.where("__varies").isEmpty():
        raise ValueError("a column varies inside a group")
    table = gathered.select(group, *own)
    count, columns = gathered.agg(F.sum(F.size("__members"))).first()[0], list(dict.fromkeys([y, *x]))
    if not count:
        raise ValueError("no groups are left")
    if spread or spread is None and count > MOST_PAIRS:
        left, levels, rounds = _spread_project(gathered, members, columns, group, individual, fes, weights, aggregation)
    else:
        left, levels, rounds = _driver_project(table, members(gathered, group), columns, group, individual, fes, weights, aggregation)
    own_w = F.col(weights).cast("double") if weights else F.lit(1.0)
    sums = table.agg(F.count(F.lit(1)), F.sum(own_w), *[F.sum(own_w * F.col(c)) for c in columns], *[F.sum(F.col(c).cast("double") ** 2) for c in columns]).first()
    means = {c: float(sums[2 + i] / sums[1]) for i, c in enumerate(columns)}
    squares = left.agg(*[F.sum(F.col(c) ** 2) for c in columns]).first()
    nought = {c for i, c in enumerate(columns) if squares[i] <= 1e-9 * sums[2 + len(columns) + i]}
    left = left.select("group", *[(F.lit(0.0) if c in nought else F.col(c)).alias(c) for c in columns])
    kept = [c for c in dict.fromkeys([*clusters, *([weights] if weights else [])]) if c != group]
    made = left.withColumnRenamed("group", group)
    made = keep_cut(made.join(table.select(group, *kept), group) if kept else made)
    r = fit(made, y, x, [], weights=weights, clusters=clusters, se_type=se_type, intercept=False, **options)
    dof = absorbed(members(gathered, *dict.fromkeys([*fes, *clusters])), [*fes, individual], clusters, True)
    k, n, df_a = r.df_model, r.n, dof["df_a"]
    free = n - k - df_a - (int(any(dof["nested"])) if clusters and df_a else 0)
    r.vcov *= (n - k) / free if free > 0 else np.nan
    r.df_resid = min(n - k - df_a, r.df_resid) if clusters else n - k - df_a
    r.df_absorbed, r.dof = df_a, dof
    scale = n / float(sums[1]) if weights and not options.get("fweights") else 1.0
    spread_y = table.agg(F.sum(own_w * (F.col(y) - means[y]) ** 2)).first()[0]
    r.tss_within, r.tss = r.tss, float(spread_y) * scale
    r.terms = [*r.terms, "_cons"]
    slopes = r.coef
    r.coef = np.append(slopes, means[y] - sum(b * means[c] for c, b in zip(x, slopes.tolist(), strict=True)))
    r.vcov = np.pad(r.vcov, ((0, 1), (0, 1)), constant_values=math.nan)
    effect = F.col("x0") - sum((float(v) * F.col(f"x{columns.index(c)}") for c, v in zip(x, slopes.tolist(), strict=True)), F.lit(0.0))
    r.absorption = {"method": "bridge", "iterations": rounds, "individual": levels.where("kind = 0").select(F.col("level").alias(individual), effect.alias("effect"))}
    return r


def _driver_project(table, bridge, columns, group, individual, fes, weights, aggregation):
    """(group, what is left of columns), (kind, level, x0, x1, ...: members' coefficients) and rounds, solved in the driver."""
    import pandas as pd
    import pyarrow as pa

    own_rows = table.toArrow().to_pandas().sort_values(group, ignore_index=True)
    pairs = bridge.toArrow().to_pandas()
    levels, names = pairs[individual].factorize(sort=True)
    codes = pd.Index(own_rows[group]).get_indexer(pairs[group])
    left, solved, starts, rounds = _project(own_rows, (codes, levels), columns, fes, weights, aggregation)
    spark = table.sparkSession
    made = spark.createDataFrame(pa.table({"group": pa.array(own_rows[group])} | {c: v for c, v in zip(columns, left, strict=True)}))
    found = spark.createDataFrame(pa.table({"kind": np.zeros(starts[1], np.int32), "level": pa.array(names)} | {f"x{i}": solved[: starts[1], i] for i in range(len(columns))}))
    return made.withColumn("group", F.col("group").cast(table.schema[group].dataType)), found.withColumn("level", F.col("level").cast(bridge.schema[individual].dataType)), rounds


def _spread_project(gathered, members, columns, group, individual, fes, weights, aggregation):
    """As _driver_project(), in the cluster: groups stay there; levels' vectors are held by the driver if they are few enough, else in buckets."""
    from . import spread_groups

    kinds, levels = [individual, *fes], None
    for d, k in enumerate(kinds):
        # members of any type, other levels as text
        found = (members(gathered) if d == 0 else gathered.select(k)).distinct()
        found = found.select(F.lit(d).alias("kind"), F.col(k).cast("string").alias("level"), F.xxhash64(F.lit(d), k).alias("node"))
        levels = found if levels is None else levels.unionByName(found)
    levels = keep_cut(levels)
    number = levels.count()
    if number * len(columns) <= spread_groups.MOST_VALUES:
        left, solved, rounds = spread_groups.few_levels(gathered, levels, columns, group, fes, weights, aggregation)
    else:
        text = lambda c: F.col(c).cast("string")
        share = 1 / F.size("__members") if aggregation == "mean" else F.lit(1.0)
        entries = gathered.select(F.col(group).alias("group"), F.lit(0).alias("kind"), F.explode("__members").alias("level"), share.cast("double").alias("share")).withColumn("level", text("level"))
        for d, k in enumerate(fes, 1):
            entries = entries.unionByName(gathered.select(F.col(group).alias("group"), F.lit(d).alias("kind"), text(k).alias("level"), F.lit(1.0).alias("share")))
        values = [*columns, *([weights] if weights and weights not in columns else [])]
        system = spread_groups.SpreadGroups(entries, gathered.select(F.col(group).alias("group"), *[c for c in values if c != "group"]), columns, weights)
        left, solved = system.project()
        rounds = system.rounds
    kind = gathered.schema["__members"].dataType.elementType
    return left, keep_cut(solved.withColumn("level", F.col("level").cast(kind))), rounds
