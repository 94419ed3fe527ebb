"""Within projection: columns less what fixed effects explain.

A term is a key, or an Effect: a key whose levels have an intercept, slopes on columns, or both. One effect of intercepts
is its levels' means. Otherwise terms are solved on their levels: with D their columns, A = D'WD and B = D'WV, the level
coefficients solve A t = B. B and A's diagonal blocks are one aggregation for each term; A's other blocks are edge tables,
one aggregation for each pair of terms. While levels and edges are few enough for the driver (MOST_CELLS, counted first)
conjugate gradients solve there, preconditioned by the levels' own blocks and, where these take long, by an incomplete
factorisation of the graph of the two largest effects (factor.py); two effects of intercepts with more than MOST_PAIR_CELLS are solved on blocks of pairs
in the cluster, the larger one eliminated (spread_akm.py), unless that takes many rounds; else, beyond, the same iterations run on those tables in the cluster: rows are read to make the
tables and to be joined with the result, and in no iteration. Either way the
certificate measures what is left: the norm of D'W of the residual, by one aggregation for each term.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.formula import Effect
from .coarse import Coarse
from .factor import LaplacianFactor
from .sample import Unsettled, counted, keep_cut

MOST_CELLS = 20_000_000
#: Rounds by the levels' own blocks alone, after which the graph of two effects is factorised.
FEW_ROUNDS = 60
#: Cells up to which the driver solves two effects of intercepts, and pairs of levels in a block beyond.
MOST_PAIR_CELLS, PAIR_MATCHES = 4_000_000, 1_000_000
#: Edges of one level that a task takes in the cluster's iterations.
HOT_EDGES = 1_000_000


def as_effect(term: str | Effect) -> Effect:
    """A term as an effect of one key column."""
    e = Effect((term,)) if isinstance(term, str) else term
    if len(e.keys) != 1:
        raise ValueError(f"{e.name}: a joint key must be a column first")
    return e


def carriers(e: Effect) -> list:
    """What a term's level coefficients multiply: None for the intercept, then the slope columns."""
    return ([None] if e.intercept else []) + list(e.slopes)


def _col(z: str | None):
    return F.lit(1.0) if z is None else F.col(z)


def within(df: DataFrame, columns: list[str], key: str, weight: str | None = None, suffix: str = "_tilde") -> DataFrame:
    """Columns less their (weighted) mean in each level of key. Means are summed up before they are dealt out and joined back, so no task gets a level's rows."""
    mean = lambda c: F.avg(c) if weight is None else F.sum(F.col(c) * F.col(weight)) / F.sum(weight)
    means = keep_cut(df.groupBy(F.col(key).alias("__level")).agg(*[mean(c).alias(f"__m{i}") for i, c in enumerate(columns)]))
    both = df.join(counted(means, means.count()), F.col(key).eqNullSafe(F.col("__level")), "left")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(c) - F.col(f"__m{i}")).alias(f"{c}{suffix}") for i, c in enumerate(columns)])


def absorb(df: DataFrame, columns: list[str], keys: list, weight: str | None = None, suffix: str = "_tilde", tol: float = 1e-13, effects: bool = False, bound: float = 1e-8, lean: bool = False) -> tuple[DataFrame, dict]:
    """The rows with <column>_tilde for each column, and how it went: method, iterations, certificate, certified.

    bound: the greatest certificate that passes; a greater one raises. lean: the columns themselves may be left out of the rows.

    effects: also <column>_fe1, _fe2, ... with what each term contributes, and in how["terms"] for each term a DataFrame
    of its level coefficients: the key, then <column>_<carrier> (the carrier `const` or the slope's column).
    """
    terms = [as_effect(k) for k in keys]
    if not terms:
        return df.select("*", *[F.col(c).alias(f"{c}{suffix}") for c in columns]), {"method": "none", "iterations": 0, "certificate": 0.0, "certified": True}
    if len(terms) == 1 and not terms[0].slopes:
        out, key = within(df, columns, terms[0].keys[0], weight, suffix), terms[0].keys[0]
        if effects:
            out = out.select("*", *[(F.col(c) - F.col(f"{c}{suffix}")).alias(f"{c}_fe1") for c in columns])
        out = keep_cut(out.drop(*columns, *[f"{c}{suffix}" for c in columns if effects]) if lean else out)
        how = {"method": "means", "iterations": 1, "certificate": 0.0, "certified": True}
        if effects:
            how["terms"] = [out.groupBy(key).agg(*[F.first(f"{c}_fe1").alias(f"{c}_const") for c in columns])]
        return out, how
    w = F.col(weight) if weight else F.lit(1.0)
    cells, edges = [], {}
    for e in terms:
        zs = carriers(e)
        squares = [F.sum(w * _col(zs[i]) * _col(zs[j])).alias(f"g{i}_{j}") for i in range(len(zs)) for j in range(i + 1)]
        cells.append(df.groupBy(e.keys[0]).agg(*squares, *[F.sum(w * _col(z) * F.col(c)).alias(f"b{i}_{n}") for i, z in enumerate(zs) for n, c in enumerate(columns)]))
    pair = len(terms) == 2 and all(carriers(e) == [None] for e in terms)
    for a in range(len(terms)):
        for b in range(a + 1, len(terms)):
            ka, kb = F.col(terms[a].keys[0]).alias("ka"), F.col(terms[b].keys[0]).alias("kb")
            edges[a, b] = df.groupBy(ka, kb).agg(*[F.sum(w * _col(x) * _col(z)).alias(f"w{i}_{j}") for i, x in enumerate(carriers(terms[a])) for j, z in enumerate(carriers(terms[b]))], *[F.sum(w * F.col(c)).alias(f"y{n}") for n, c in enumerate(columns) if pair])
    cells, edges = [keep_cut(c) for c in cells], {k: keep_cut(e) for k, e in edges.items()}
    number = sum(x.count() * max(len(x.columns) - 1, 1) for x in [*cells, *edges.values()])
    if got := _spread_pair(df, columns, terms, cells, edges[0, 1], suffix, effects) if pair and number > min(MOST_CELLS, MOST_PAIR_CELLS) else None:
        out, told = got
    elif number > MOST_CELLS:
        out, told = _spread(df, columns, terms, cells, edges, suffix, effects)
    else:
        out, told = _solve(df, columns, terms, cells, edges, suffix, tol, effects)
    told["certificate"] = certificate(out, [f"{c}{suffix}" for c in columns], columns, terms, weight)
    told["certified"] = told["certificate"] <= bound
    if not told["certified"]:
        raise RuntimeError(f"absorption left {told['certificate']:.3g}")
    return out, told


def _solve(df, columns, terms, cells, edges, suffix, tol, effects):
    import pandas as pd
    import pyarrow as pa

    tables = [c.toArrow().to_pandas() for c in cells]
    index = [pd.Index(t.iloc[:, 0]) for t in tables]
    sizes = [(len(t), len(carriers(e))) for t, e in zip(tables, terms, strict=True)]
    low = np.concatenate([[0], np.cumsum([n * q for n, q in sizes])])
    grams, inverses, right = [], [], []
    for t, (n, q) in zip(tables, sizes, strict=True):
        g = np.zeros((n, q, q))
        for i in range(q):
            for j in range(i + 1):
                g[:, i, j] = g[:, j, i] = t[f"g{i}_{j}"].to_numpy(float)
        # scaled to a unit diagonal, so that the rank doesn't depend on the units of slopes
        d = np.sqrt(np.einsum("nii->ni", g))
        d = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
        grams.append(g)
        inverses.append(np.linalg.pinv(g * d[:, :, None] * d[:, None, :], rcond=1e-12, hermitian=True) * d[:, :, None] * d[:, None, :] if q > 1 else (d * d)[:, :, None])
        right.append(np.stack([t[[f"b{i}_{k}" for k in range(len(columns))]].to_numpy(float) for i in range(q)], 1).reshape(n * q, -1))
    right = np.concatenate(right)
    rows, cols, vals = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for (a, b), e in edges.items():
        e = e.drop(*[c for c in e.columns if c.startswith("y")]).toArrow().to_pandas()
        ia, ib = index[a].get_indexer(e["ka"]), index[b].get_indexer(e["kb"])
        for i in range(sizes[a][1]):
            for j in range(sizes[b][1]):
                rows.append(low[a] + ia * sizes[a][1] + i)
                cols.append(low[b] + ib * sizes[b][1] + j)
                vals.append(e[f"w{i}_{j}"].to_numpy(float))
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)

    def blocks(by, x):
        return np.concatenate([np.einsum("nij,nj->ni", m, x[low[d] : low[d + 1]].reshape(sizes[d])).ravel() for d, m in enumerate(by)])

    def times(x):
        out = blocks(grams, x)
        out += np.bincount(r, v * x[c], len(x))
        return out + np.bincount(c, v * x[r], len(x))

    closer = _pair_solver(terms, sizes, low, (r, c, v), blocks, inverses)
    solved, rounds = np.zeros_like(right), 0
    for k in range(right.shape[1]):
        b = right[:, k]
        goal = tol * (np.linalg.norm(b) or 1.0)
        x, n, left = _gradients(times, lambda y: blocks(inverses, y), b, np.zeros(len(b)), goal, FEW_ROUNDS if closer else 10_000)
        before = np.inf
        while closer and goal < left < before / 2:  # what is left is found anew from x, as long as that helps
            before = left
            x, more, left = _gradients(times, closer(), b, x, goal, 10_000 - n)
            n += more
        rounds = max(rounds, n)
        solved[:, k] = x
    made = []
    for d, e in enumerate(terms):
        key, (n, q) = e.keys[0], sizes[d]
        levels = pd.DataFrame(solved[low[d] : low[d + 1]].reshape(n, -1), columns=[f"__t{d}_{i}_{k}" for i in range(q) for k in range(len(columns))])
        levels.insert(0, key, tables[d].iloc[:, 0])
        made.append(df.sparkSession.createDataFrame(pa.Table.from_pandas(levels, preserve_index=False)).withColumn(key, F.col(key).cast(df.schema[key].dataType)))
    out, kept = _joined(df, columns, terms, made, suffix, effects)
    return out, {"method": "levels", "iterations": rounds, "terms": kept}


def _gradients(times, precondition, b, x, goal, most):
    """Conjugate gradients from x: the solution, the rounds, and the norm of what is truly left."""
    res = b - times(x)
    z = precondition(res)
    p, rz, n = z.copy(), res @ z, 0
    for n in range(most + 1):
        if np.linalg.norm(res) <= goal or rz <= 0 or n == most:
            break
        q = times(p)
        step = rz / (p @ q)
        x = x + step * p
        res -= step * q
        z = precondition(res)
        rz, old = res @ z, rz
        p = z + rz / old * p
    return x, n, float(np.linalg.norm(b - times(x)))


def _pair_solver(terms, sizes, low, edges, blocks, inverses):
    """For two effects of intercepts or more: makes, when first asked, a preconditioner which factorises the graph of the two with most
    levels, and takes other effects' levels by their own blocks. With the second one's signs turned the two are a Laplacian."""
    plain = sorted((d for d, e in enumerate(terms) if carriers(e) == [None]), key=lambda d: -sizes[d][0])[:2]
    if len(plain) < 2:
        return None
    made = []

    def solver():
        if not made:
            first, second = sorted(plain)
            r, c, v = edges
            some = (r >= low[first]) & (r < low[first + 1]) & (c >= low[second]) & (c < low[second + 1])
            n = sizes[first][0]
            made.append(LaplacianFactor(n + sizes[second][0], r[some] - low[first], c[some] - low[second] + n, v[some]))

            def run(y):
                out = blocks(inverses, y)
                mine, its = slice(low[first], low[first + 1]), slice(low[second], low[second + 1])
                z = made[0].solve(np.concatenate([y[mine], -y[its]]))
                out[mine], out[its] = z[:n], -z[n:]
                return out

            made.append(run)
        return made[1]

    return solver


def _joined(df, columns, terms, tables, suffix, effects):
    """The rows less what the terms' level coefficients (key, __t<term>_<carrier>_<column>) add up to, and the coefficients by carrier."""
    out, kept = df, []
    for d, (e, table) in enumerate(zip(terms, tables, strict=True)):
        kept.append(table.select(e.keys[0], *[F.col(f"__t{d}_{i}_{k}").alias(f"{name}_{z or 'const'}") for i, z in enumerate(carriers(e)) for k, name in enumerate(columns)]))
        out = out.join(table, e.keys[0])
    part = lambda d, k: sum((_col(z) * F.col(f"__t{d}_{i}_{k}") for i, z in enumerate(carriers(terms[d]))), F.lit(0.0))
    whole = lambda k: sum((part(d, k) for d in range(len(terms))), F.lit(0.0))
    shown = [part(d, k).alias(f"{c}_fe{d + 1}") for k, c in enumerate(columns) for d in range(len(terms))] if effects else []
    return keep_cut(out.select(*df.columns, *[(F.col(c) - whole(k)).alias(f"{c}{suffix}") for k, c in enumerate(columns)], *shown)), kept


def _inverses(q: int):
    """Adds m<i>_<j>, the generalised inverse of each level's block g<i>_<j>, scaled to a unit diagonal first."""

    def run(parts):
        for part in parts:
            g = np.zeros((len(part), q, q))
            for i in range(q):
                for j in range(i + 1):
                    g[:, i, j] = g[:, j, i] = part[f"g{i}_{j}"].to_numpy(float)
            d = np.sqrt(np.einsum("nii->ni", g))
            d = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
            m = np.linalg.pinv(g * d[:, :, None] * d[:, None, :], rcond=1e-12, hermitian=True) * d[:, :, None] * d[:, None, :]
            for i in range(q):
                for j in range(q):
                    part[f"m{i}_{j}"] = m[:, i, j]
            yield part

    return run


def _spread(df, columns, terms, cells, edges, suffix, effects, tol: float = 1e-12, most_rounds: int = 2000):
    """_solve() in the cluster. A level is a row with its block, its solution x, what is left r and its direction p.

    Levels of all terms are one table, by term and key; edges lie both ways, dealt out by the level they read, as the levels are, so a
    round moves one row for each level and the sums of edges in each task. Edges of a level with more than HOT_EDGES are dealt out
    by lots of so many, each of which gets a copy of the level's direction. After FEW_ROUNDS the preconditioner is the sum of the
    levels' own blocks and of a solution between clusters of the two largest effects' levels (coarse.py).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, cols = max(len(carriers(e)) for e in terms), range(len(columns))
    name = lambda d, c: F.concat(F.lit(f"{d}:"), F.col(c).cast("string"))
    zero = F.lit(0.0)
    levels, both = None, None
    for d, (e, c) in enumerate(zip(terms, cells, strict=True)):
        own = len(carriers(e))
        blocks = [(F.col(f"g{i}_{j}") if i < own else zero).cast("double").alias(f"g{i}_{j}") for i in range(q) for j in range(i + 1)]
        some = c.select(name(d, e.keys[0]).alias("k"), *blocks, *[(F.col(f"b{i}_{n}") if i < own else zero).cast("double").alias(f"r{i}_{n}") for i in range(q) for n in cols])
        levels = some if levels is None else levels.unionByName(some)
    for (a, b), e in edges.items():
        na, nb = len(carriers(terms[a])), len(carriers(terms[b]))
        for u, v, turn in ((name(a, "ka"), name(b, "kb"), False), (name(b, "kb"), name(a, "ka"), True)):
            weight = lambda i, j: (F.col(f"w{j}_{i}") if turn else F.col(f"w{i}_{j}")) if (i < nb and j < na if turn else i < na and j < nb) else zero  # noqa: B023, E731
            some = e.select(u.alias("u"), v.alias("v"), *[weight(i, j).cast("double").alias(f"w{i}_{j}") for i in range(q) for j in range(q)])
            both = some if both is None else both.unionByName(some)
    if q > 1:
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in levels.schema] + [f"m{i}_{j} double" for i in range(q) for j in range(q)])
        levels = levels.mapInPandas(_inverses(q), schema)
    else:
        levels = levels.withColumn("m0_0", F.when(F.col("g0_0") > 0, 1 / F.col("g0_0")).otherwise(zero))
    fixed = ["k", *[f"g{i}_{j}" for i in range(q) for j in range(i + 1)], *[f"m{i}_{j}" for i in range(q) for j in range(q)]]
    gram = lambda i, j: F.col(f"g{max(i, j)}_{min(i, j)}")
    z = lambda i, n, r="r": sum((F.col(f"m{i}_{j}") * F.col(f"{r}{j}_{n}") for j in range(q)), zero)
    state = keep_cut(levels.select(*fixed, *[F.col(f"r{i}_{n}") for i in range(q) for n in cols], *[zero.alias(f"x{i}_{n}") for i in range(q) for n in cols], *[z(i, n).alias(f"p{i}_{n}") for i in range(q) for n in cols]).repartition(parts, "k"))
    lots = None
    if both is not None:
        lots = keep_cut(both.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HOT_EDGES).cast("int").alias("lots")).where("lots > 1"))
        if number := lots.count():
            lots = counted(lots, number)
            both = both.join(lots, "v", "left").withColumn("lot", F.expr("cast(pmod(xxhash64(u), coalesce(lots, 1)) AS int)")).drop("lots")
        else:
            lots, both = None, both.withColumn("lot", F.lit(0))
        both = keep_cut(both.repartition(parts, "v", "lot"))
    dot = lambda a, b: [F.sum(sum((a(i, n) * b(i, n) for i in range(q)), zero)) for n in cols]
    r = lambda i, n: F.col(f"r{i}_{n}")
    plain = sorted((d for d, e in enumerate(terms) if carriers(e) == [None]), key=lambda d: -cells[d].count())[:2]
    coarse, turned = None, F.lit(1.0)
    told = state.agg(*dot(r, r), *dot(r, z)).first()
    goal, rz = tol**2 * np.maximum(np.array(told[: len(cols)], float), 1e-300), np.array(told[len(cols) :], float)
    left, rounds = goal / tol**2, 0
    for rounds in range(1, most_rounds + 1):
        if (left <= goal).all() or (rz <= 0).all():
            break
        p = state.select(F.col("k").alias("v"), *[F.col(f"p{i}_{n}") for i in range(q) for n in cols])
        p = p.withColumn("lot", F.lit(0)) if lots is None else p.join(lots, "v", "left").withColumn("lot", F.explode(F.expr("sequence(0, coalesce(lots, 1) - 1)"))).drop("lots")
        own = [sum((gram(i, j) * F.col(f"p{j}_{n}") for j in range(q)), zero) for i in range(q) for n in cols]
        names = [f"q{i}_{n}" for i in range(q) for n in cols]
        if both is not None:
            met = both.join(p, ["v", "lot"]).groupBy("u").agg(*[F.sum(sum((F.col(f"w{i}_{j}") * F.col(f"p{j}_{n}") for j in range(q)), zero)).alias(f"q{i}_{n}") for i in range(q) for n in cols])
            state = state.join(met.withColumnRenamed("u", "k"), "k", "left")
            state = state.select(*[c for c in state.columns if c not in names], *[(v + F.coalesce(F.col(c), zero)).alias(c) for v, c in zip(own, names, strict=True)])
        else:
            state = state.select("*", *[v.alias(c) for v, c in zip(own, names, strict=True)])
        state = keep_cut(state)
        pq = np.array(state.agg(*dot(lambda i, n: F.col(f"p{i}_{n}"), lambda i, n: F.col(f"q{i}_{n}"))).first(), float)
        step = np.where((pq > 0) & (left > goal), rz / np.where(pq > 0, pq, 1), 0.0)
        state = state.select(*fixed, *[(F.col(f"x{i}_{n}") + float(step[n]) * F.col(f"p{i}_{n}")).alias(f"x{i}_{n}") for i in range(q) for n in cols], *[(F.col(f"r{i}_{n}") - float(step[n]) * F.col(f"q{i}_{n}")).alias(f"r{i}_{n}") for i in range(q) for n in cols], *[F.col(f"p{i}_{n}") for i in range(q) for n in cols])
        told = state.agg(*dot(r, r), *dot(r, z)).first()
        left, new = np.array(told[: len(cols)], float), np.array(told[len(cols) :], float)
        begins = coarse is None and rounds >= FEW_ROUNDS and len(plain) == 2 and not (left <= goal).all()
        if begins:
            a, b = sorted(plain)
            coarse = Coarse(edges[a, b].select(F.xxhash64(name(a, "ka")).alias("u"), F.xxhash64(name(b, "kb")).alias("v"), F.col("w0_0").cast("double").alias("w")))
            turned = F.when(F.col("k").startswith(f"{b}:"), -1.0).otherwise(1.0)
            state = keep_cut(state.withColumn("node", F.xxhash64("k")).join(coarse.places, "node", "left").drop("node"))
            fixed.append("place")
        if coarse:
            # the clusters' solution is added to the blocks' own; the second effect's signs are turned
            more, products = coarse.solve(state, [turned * F.col(f"r0_{n}") for n in cols])
            state, new = state.join(more, "place", "left"), new + products
        turn = np.zeros(len(new)) if begins else np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
        rz = new
        added = lambda i, n: turned * F.coalesce(F.col(f"c{n}"), zero) if coarse and not i else zero  # noqa: B023, E731
        state = state.select(*fixed, *[F.col(f"{v}{i}_{n}") for v in "xr" for i in range(q) for n in cols], *[(z(i, n) + added(i, n) + float(turn[n]) * F.col(f"p{i}_{n}")).alias(f"p{i}_{n}") for i in range(q) for n in cols])
    state = keep_cut(state)
    made = []
    for d, (e, c) in enumerate(zip(terms, cells, strict=True)):
        found = c.select(e.keys[0], name(d, e.keys[0]).alias("k")).join(state, "k")
        made.append(found.select(e.keys[0], *[F.col(f"x{i}_{n}").alias(f"__t{d}_{i}_{n}") for i in range(len(carriers(e))) for n in cols]))
    out, kept = _joined(df, columns, terms, made, suffix, effects)
    return out, {"method": "spread levels", "iterations": rounds, "terms": kept}


def _spread_pair(df, columns, terms, cells, edges, suffix, effects):
    """_spread() of two effects of intercepts: the one with more levels is eliminated inside blocks of pairs (spread_akm.py), so a round moves
    what blocks and the other's levels tell one another, and no pair. None if that takes more than FEW_ROUNDS rounds."""
    from .spread_akm import SpreadSystem

    more, less = sorted((0, 1), key=lambda d: -cells[d].count())
    ends, sums = ("ka", "kb"), [f"y{n}" for n in range(len(columns))]
    matches = edges.where("w0_0 > 0").select(F.col(ends[more]).alias("worker"), F.col(ends[less]).alias("firm"), F.col("w0_0").alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), *sums)
    system = SpreadSystem(matches, sums, block_matches=PAIR_MATCHES)
    try:
        levels = keep_cut(system.levels(len(columns), 1e-12, FEW_ROUNDS))
    except Unsettled:
        return None
    made = []
    for d, c in enumerate(cells):
        side, salt = ("w", 1) if d == more else ("f", 2)
        found = levels.where(f"{side} IS NOT NULL").select(F.col(side).alias("__h"), *[F.col(f"z{n}").alias(f"__z{n}") for n in range(len(columns))])
        key = terms[d].keys[0]
        at = c.select(key, F.xxhash64(F.lit(salt), key).alias("__h")).join(found, "__h", "left")
        at = keep_cut(at.select(key, *[F.coalesce(F.col(f"__z{n}"), F.lit(0.0)).alias(f"__t{d}_0_{n}") for n in range(len(columns))]))
        made.append(counted(at, at.count()))
    out, kept = _joined(df, columns, terms, made, suffix, effects)
    return out, {"method": "spread levels", "iterations": system.rounds, "terms": kept}


def certificate(df: DataFrame, tilde: list[str], columns: list[str], keys: list, weight: str | None = None) -> float:
    """The largest over columns of |D'W residual| / (|D'W| |column|)."""
    w = F.col(weight) if weight else F.lit(1.0)
    left, scale = np.zeros(len(tilde)), 0.0
    for e in map(as_effect, keys):
        for z in carriers(e):
            sums = df.groupBy(e.keys[0]).agg(F.sum((w * _col(z)) ** 2).alias("__cw"), *[F.sum(w * _col(z) * F.col(t)).alias(f"__cs{i}") for i, t in enumerate(tilde)])
            got = sums.agg(F.sum("__cw"), *[F.sum(F.col(f"__cs{i}") ** 2) for i in range(len(tilde))]).first()
            scale += got[0]
            left += np.array(got[1:], float)
    norms = np.array(df.agg(*[F.sum(F.col(c) ** 2) for c in columns]).first(), float)
    return float(np.max(np.sqrt(left) / (np.sqrt(scale) * np.sqrt(np.maximum(norms, 1e-300)))))


def absorb_cached(df: DataFrame, columns: list[str], keys: list, weight: str | None = None, folder: str = "", mode: str = "auto", **options) -> tuple[DataFrame, dict]:
    """absorb(), kept as parquet under a folder that all executors share, by a hash of the rows and of what is asked.

    mode: off, read (raises where nothing is kept), write (makes it anew) or auto. The hash is the count and the sums of two
    hashes of all used columns over the rows, in whatever order they come, and the columns' names, effects and options.
    """
    import hashlib
    import json

    if mode not in ("off", "auto", "read", "write"):
        raise ValueError(f"cache mode {mode!r}")
    if mode == "off" or not folder:
        return absorb(df, columns, keys, weight, **options)
    terms = [as_effect(k) for k in keys]
    cells = [F.col(f"`{c}`") for c in df.columns]
    sums = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *cells).cast("decimal(38,0)"))).first()
    told = [[str(x) for x in sums], df.columns, columns, [[*e.keys, list(e.slopes), e.intercept] for e in terms], weight, sorted((k, str(v)) for k, v in options.items())]
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(told).encode()).hexdigest()}"
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    if mode == "read" and not there:
        raise FileNotFoundError(path)
    if there and mode != "write":
        return spark.read.parquet(path), {"method": "cache", "iterations": 0, "certified": True}
    out, how = absorb(df, columns, keys, weight, **options)
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), how


def normalise(df: DataFrame, parts: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """Recovered intercept effects with their free shifts fixed: one term is centred; of several, the mean of the second in
    each mobility group of the first two goes to the first, then the first and those from the third on are centred."""
    from .graph import mobility_groups

    w = F.col(weight) if weight else F.lit(1.0)
    if len(parts) > 1:
        # sums by level, then by group, which may well be all of them; a level's shift is joined with the rows
        levels = mobility_groups(df, keys[0], keys[1]).join(df.groupBy(keys[0]).agg(F.sum(w * F.col(parts[1])).alias("__s"), F.sum(w).alias("__w")), keys[0])
        levels = keep_cut(levels)
        shifts = keep_cut(levels.groupBy("group").agg((F.sum("__s") / F.sum("__w")).alias("__shift")))
        of_level = keep_cut(levels.select(keys[0], "group").join(counted(shifts, shifts.count()), "group").select(keys[0], "__shift"))
        df = df.join(counted(of_level, of_level.count()), keys[0])
        df = df.withColumns({parts[0]: F.col(parts[0]) + F.col("__shift"), parts[1]: F.col(parts[1]) - F.col("__shift")}).drop("__shift")
    centred = [parts[0], *parts[2:]]
    means = df.agg(*[F.sum(w * F.col(p)) / F.sum(w) for p in centred]).first()
    return df.withColumns({p: F.col(p) - float(m) for p, m in zip(centred, means, strict=True)})
