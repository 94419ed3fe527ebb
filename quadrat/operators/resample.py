"""Bootstrap of contributions: units are drawn with replacement, and all replicates are estimated from one aggregation.

How often each replicate draws a unit is a row of the unit with as many two-byte counts as there are replicates. Rows are summed
up to the moments of each unit once; a replicate's moments are those sums times its
counts, one matrix product for each slice of a task. With one effect, what its levels explain is s s' / w of each level's weighted sums,
so the within moments of all replicates need one more aggregation, by unit and level. Counts that the driver drew are broadcast to it, so
that cells are shuffled by level without them; others are joined with each cell first. Contributions are functions of these moments alone, and only they
reach the driver. With more effects each replicate is a fit of its own, with the same counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decompose import decompose
from .model import kept_columns
from .sample import check, counted, keep_cut

#: Counts (units times replicates) that the driver draws; beyond, they are drawn in the cluster, by another stream.
MOST_COUNTS = 100_000_000
#: Units drawn together in the cluster.
BUCKET = 1024
#: Cells of one level that a task adds up; a level with more is dealt out in lots.
HOT_CELLS = 1024
#: Cells whose counts are unpacked at a time.
SLICE = 512
#: Moments of all replicates that the driver takes.
MOST_MOMENTS = 50_000_000


def draws(units: DataFrame, reps: int, seed: int, most_counts: int | None = None) -> DataFrame:
    """The units (one column, distinct, without nulls) with __draws: reps big-endian two-byte counts. Each replicate draws as many units as there are.

    Up to MOST_COUNTS a replicate is a stream of its own over the sorted units. Beyond, units are dealt to buckets by hash; a tree over
    the buckets splits each replicate's draws binomially, with a generator for each node, and a bucket's are multinomial: the same
    distribution, whatever the partitioning, and no task needs more than the buckets' sizes and its own units.
    """
    import pandas as pd
    import pyarrow as pa

    unit, n, spark = units.columns[0], units.count(), units.sparkSession
    if not n:
        raise ValueError("no units to draw")
    if n * reps <= (MOST_COUNTS if most_counts is None else most_counts):
        ids = units.toArrow().to_pandas()[unit].sort_values().reset_index(drop=True)
        counts = np.zeros((n, reps), ">u2")
        for r, child in enumerate(np.random.SeedSequence(seed).spawn(reps)):
            counts[:, r] = np.bincount(np.random.Generator(np.random.PCG64(child)).integers(0, n, n), minlength=n)
        table = pa.Table.from_pandas(pd.DataFrame({unit: ids, "__draws": [row.tobytes() for row in counts]}), preserve_index=False)
        return keep_cut(spark.createDataFrame(table).withColumn(unit, F.col(unit).cast(units.schema[unit].dataType)))
    buckets = min(-(-n // BUCKET), 1_000_000)
    dealt = keep_cut(units.withColumn("__bucket", F.expr(f"pmod(xxhash64(`{unit}`), {buckets})")))
    ends = np.zeros(buckets + 1, np.int64)
    for row in dealt.groupBy("__bucket").count().toLocalIterator():
        ends[row[0] + 1] = row[1]
    ends = np.cumsum(ends)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by ranges of buckets, so that tasks share few nodes of the tree
    dealt = dealt.repartitionByRange(parts, "__bucket").sortWithinPartitions("__bucket", unit)
    schema = f"`{unit}` {units.schema[unit].dataType.simpleString()}, __draws binary"
    return keep_cut(dealt.mapInPandas(_bucket_draws(unit, ends, reps, seed), schema))


def _bucket_draws(unit, ends, reps, seed):
    """Counts of the units of whole buckets, which come in order."""

    def run(parts):
        import pandas as pd

        path = []  # nodes from the root: number, first bucket, last, totals of the replicates

        def totals(bucket):
            while path and not path[-1][1] <= bucket < path[-1][2]:
                path.pop()
            if not path:
                path.append((1, 0, len(ends) - 1, np.full(reps, ends[-1])))
            while path[-1][2] - path[-1][1] > 1:
                node, low, high, total = path[-1]
                middle = (low + high) // 2
                share = (ends[middle] - ends[low]) / max(ends[high] - ends[low], 1)
                left = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, node]))).binomial(total, share)
                path.append((2 * node, low, middle, left) if bucket < middle else (2 * node + 1, middle, high, total - left))
            return path[-1][3]

        def drawn(bucket, ids):
            n = len(ids)
            # nodes are numbered from 1 and keys are padded with zeros, so no node has a bucket's key
            generator = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, 0, int(bucket) + 1])))
            counts = generator.multinomial(totals(bucket), np.full(n, 1 / n)).T.astype(">u2")
            return pd.DataFrame({unit: ids.to_numpy(), "__draws": [row.tobytes() for row in counts]})

        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            last = held["__bucket"].iloc[-1]
            for bucket, group in held[held["__bucket"] != last].groupby("__bucket", sort=True):
                yield drawn(bucket, group[unit])
            held = held[held["__bucket"] == last]
        if held is not None and len(held):
            yield drawn(held["__bucket"].iloc[0], held[unit])

    return run


def _sent_draws(counts: DataFrame, unit: str, reps: int, most_counts: int | None = None):
    """A broadcast of the units' hashes, in order, and of their counts; None if the counts are more than the driver draws, or two units share a hash."""
    if counts.count() * reps > (MOST_COUNTS if most_counts is None else most_counts):
        return None
    told = counts.select(F.xxhash64(unit).alias("u"), "__draws").toArrow()
    u = told["u"].to_numpy()
    order = np.argsort(u)
    if (u[order][1:] == u[order][:-1]).any():
        return None
    return counts.sparkSession.sparkContext.broadcast((u[order], np.frombuffer(b"".join(told["__draws"].to_pylist()), ">u2").reshape(-1, reps)[order]))


def _replicate_sums(columns: int, reps: int, level: bool, by_rows: bool, sent=None):
    """Adds up over cells of all replicates the moments (__m0..), or what levels explain (__n, __s0.. and, sorted by the first two, __level, __lot, __hot).

    A cell has __draws, or __u, the hash of its unit among those sent.

    Rows are (kind, level, rep, at, value). Kind 0: the moments, from `pairs` on what levels explain, from 2 * pairs on what goes with levels of one row.
    Kind 1: partial sums of a level that is dealt out in lots: at 0 the rows, then the sums.
    """
    i, j = np.triu_indices(columns)
    pairs = len(i)

    def run(parts):
        import pandas as pd

        total, hot, held = np.zeros((3, pairs, reps)), {}, None

        def take(cells):
            starts = None
            if level:
                key, lot = cells["__level"].to_numpy(), cells["__lot"].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lot[1:] != lot[:-1])]))
            low = 0
            while low < len(cells):
                high = min(low + SLICE, len(cells))
                if level and high < len(cells):
                    # whole lots of levels, at least one
                    cut = starts[np.searchsorted(starts, high, "right") - 1]
                    later = starts[starts > low]
                    high = int(cut) if cut > low else int(later[0]) if len(later) else len(cells)
                some = cells.iloc[low:high]
                add(some, starts[(starts >= low) & (starts < high)] - low if level else None)
                low = high

        def add(cells, starts):
            if sent:
                d = sent.value[1][np.searchsorted(sent.value[0], cells["__u"].to_numpy())].astype(float)
            else:
                d = np.frombuffer(b"".join(cells["__draws"]), ">u2").reshape(len(cells), reps).astype(float)
            if not level:
                total[0] += cells[[f"__m{k}" for k in range(pairs)]].to_numpy(float).T @ d
                return
            rows = np.add.reduceat(((d > 0) if by_rows else d) * cells["__n"].to_numpy(float)[:, None], starts, 0)
            s = [np.add.reduceat(d * cells[f"__s{k}"].to_numpy(float)[:, None], starts, 0) for k in range(columns)]
            lots = cells["__hot"].to_numpy()[starts]
            for at in np.flatnonzero(lots):
                name = cells["__level"].iloc[starts[at]]
                hot[name] = hot.get(name, 0) + np.stack([rows[at], *[x[at] for x in s]])
            cold = ~lots
            rows, s = rows[cold], [x[cold] for x in s]
            single, share = rows <= 1, np.divide(1.0, s[0], out=np.zeros_like(s[0]), where=s[0] > 0)
            for k in range(pairs):
                told = s[i[k]] * s[j[k]] * share
                total[1, k] += told.sum(0)
                total[2, k] += np.where(single, told, 0).sum(0)

        def partial():
            for name, sums in hot.items():
                yield pd.DataFrame({"kind": 1, "level": str(name), "rep": np.tile(np.arange(reps), columns + 1), "at": np.repeat(np.arange(columns + 1), reps), "value": sums.ravel()})

        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if not level:
                take(held)
                held = None
                continue
            mine = ((held["__level"] == held["__level"].iloc[-1]) & (held["__lot"] == held["__lot"].iloc[-1])).to_numpy()
            take(held[~mine])
            held = held[mine]
            if len(hot) > 100:
                yield from partial()
                hot.clear()
        if held is not None and len(held):
            take(held)
        yield pd.DataFrame({"kind": 0, "level": "", "rep": np.tile(np.arange(reps), 3 * pairs), "at": np.repeat(np.arange(3 * pairs), reps), "value": total.ravel()})
        yield from partial()

    return run


def _hot_levels(columns: int, pairs: int):
    """What levels dealt out in lots explain, from (rep, sums): rows as those of kind 0."""
    i, j = np.triu_indices(columns)

    def run(parts):
        import pandas as pd

        for part in parts:
            sums = np.stack(part["sums"].to_numpy())
            share = np.divide(1.0, sums[:, 1], out=np.zeros(len(sums)), where=sums[:, 1] > 0)
            told = sums[:, 1 + i] * sums[:, 1 + j] * share[:, None]
            both = np.concatenate([told, np.where(sums[:, :1] <= 1, told, 0)], 1)
            yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), 2 * pairs), "at": np.tile(np.arange(pairs, 3 * pairs), len(part)), "value": both.ravel()})

    return run


def _moments(df: DataFrame, columns: list[str], unit: str, effect: str | None, weights: str | None, counts: DataFrame, reps: int, na_action: str, hot_cells: int, most_counts: int | None = None) -> tuple[np.ndarray, ...]:
    """Of each replicate the moments of the constant and the columns, what the effect's levels explain of them, and what goes with levels of one row."""
    names = [f"__c{k}" for k in range(len(columns))]
    size, pairs = len(columns) + 1, (len(columns) + 1) * (len(columns) + 2) // 2
    if reps * 3 * pairs > MOST_MOMENTS:
        raise ValueError(f"{reps} replicates of {pairs} moments are more than the driver takes")
    picked = df.select(F.col(unit).alias("__unit"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)], *([F.col(weights).cast("double").alias("__w")] if weights else []), *([F.col(effect).alias("__level")] if effect else []))
    rows = check(picked, names + (["__w"] if weights else []), ["__level"] if effect else [], na_action)
    w = F.col("__w") if weights else F.lit(1.0)
    # a shift changes no contribution, but spares digits
    means = rows.agg(*[F.avg(c) for c in names]).first()
    values = [F.lit(1.0), *[F.col(c) - float(m or 0.0) for c, m in zip(names, means, strict=True)]]
    crossed = [(i, j) for i in range(size) for j in range(i, size)]
    drawn = counts.withColumnRenamed(unit, "__unit")
    schema = "kind int, level string, rep int, at int, value double"
    units = rows.groupBy("__unit").agg(*[F.sum(w * values[i] * values[j]).alias(f"__m{k}") for k, (i, j) in enumerate(crossed)])
    sums = units.join(drawn, "__unit").drop("__unit").mapInPandas(_replicate_sums(size, reps, False, bool(weights)), schema)
    if effect:
        cells = keep_cut(rows.groupBy("__unit", "__level").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(w * v).alias(f"__s{k}") for k, v in enumerate(values)]))
        lots = keep_cut(cells.groupBy("__level").agg(F.ceil(F.count(F.lit(1)) / hot_cells).cast("int").alias("__lots")).where("__lots > 1"))
        cells = cells.join(counted(lots, lots.count()), "__level", "left")
        cells = cells.withColumns({"__hot": F.col("__lots").isNotNull(), "__lot": F.expr("cast(pmod(xxhash64(__unit), coalesce(__lots, 1)) AS int)")}).drop("__lots")
        sent = _sent_draws(drawn, "__unit", reps, most_counts)
        cells = (cells.withColumn("__u", F.xxhash64("__unit")) if sent else cells.join(drawn, "__unit")).drop("__unit")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = cells.repartition(parts, "__level", "__lot").sortWithinPartitions("__level", "__lot")
        sums = sums.unionByName(cells.mapInPandas(_replicate_sums(size, reps, True, bool(weights), sent), schema))
    sums = keep_cut(sums.groupBy("kind", "level", "rep", "at").agg(F.sum("value").alias("value")))
    plain = sums.where("kind = 0").select("rep", "at", "value")
    if effect:
        levels = sums.where("kind = 1").groupBy("level", "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
        plain = plain.unionByName(levels.select("rep", "sums").mapInPandas(_hot_levels(size, pairs), "rep int, at int, value double"))
    got = plain.groupBy("rep", "at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros((reps, 3 * pairs))
    flat[got["rep"].to_numpy(), got["at"].to_numpy()] = got["value"].to_numpy()
    whole, (i, j) = np.zeros((3, reps, size, size)), np.triu_indices(size)
    for k in range(3):
        whole[k][:, i, j] = whole[k][:, j, i] = flat[:, k * pairs : (k + 1) * pairs]
    return tuple(whole)


def _contributions(m: np.ndarray, explained: np.ndarray, single: np.ndarray, p: int, spans: list[tuple[int, int]], effect: str) -> np.ndarray:
    """Contributions of one replicate from its moments; what the groups leave of the movement is the added effect's. ValueError if not identified."""
    kept = m - single
    if kept[0, 0] <= 0:
        raise ValueError("no rows are left")
    within = (m - explained)[1:, 1:]
    centred = kept[1:, 1:] - np.outer(kept[0, 1:], kept[0, 1:]) / kept[0, 0]
    full, base = within if effect else centred, within if effect == "common" else centred
    if kept_columns(full[1:, 1:], np.diag(kept)[2:])[1]:
        raise ValueError("not identified in the full model")
    b = np.linalg.solve(full[1:, 1:], full[1:, 0])
    gammas = np.linalg.solve(base[1 : p + 1, 1 : p + 1], base[1 : p + 1, :])
    out = [gammas[:, p + 1 + low : p + 1 + high] @ b[p + low : p + high] for low, high in spans]
    if effect == "added":
        out.append(gammas[:, 0] - b[:p] - sum(out, np.zeros(p)))
    return np.array(out)


def bootstrap(df: DataFrame, unit: str, reps: int = 999, seed: int = 0, conf: float = 0.95, kind: str = "percentile", one_pass: bool | None = None, hot_cells: int = HOT_CELLS, most_counts: int | None = None, **options) -> list[dict]:
    """Intervals of contributions by drawing units (clusters, or a column that is unique) with replacement; options as of decompose().

    A drawn unit's rows count as often as it was drawn: frequency weights of the unadjusted refits, or a factor of analytic weights. Rows
    without a unit raise, or go if na_action says so. Up to one effect all replicates are estimated in one pass; one_pass=False
    refits each, as more effects and absorbed targets do in any case. Replicates that fail are skipped; under nine in ten valid ones raise.
    """
    if options.get("fweights"):
        raise ValueError("bootstrap takes no frequency weights")
    weights = options.pop("weights", None)
    if kind not in ("percentile", "basic"):
        raise ValueError(f"interval {kind!r}")
    if options.keys() & {"vce", "clusters", "level", "alpha"}:
        raise ValueError("intervals come from the draws: vce, clusters, level and alpha have no effect here")
    if reps < 2 or not 0 < conf < 1:
        raise ValueError("two replicates at least, and a level between 0 and 1")
    na_action = options.get("na_action", "raise")
    if df.where(F.col(unit).isNull()).limit(1).count():
        if na_action == "raise":
            raise ValueError("rows have no unit")
        df = df.where(F.col(unit).isNotNull())
    effects = [*options.get("common_fes", ()), *options.get("fes", ())]
    able = len(effects) < 2 and not options.get("absorbed_targets") and not options.get("position")
    if one_pass and not able:
        raise ValueError("one pass takes one effect at most, no absorbed targets and no positions")
    point = decompose(df, weights=weights, **options)
    counts, got = draws(df.select(unit).distinct(), reps, seed, most_counts), []
    if able and one_pass is not False:
        groups, spans = options.get("groups") or {}, []
        for cols in groups.values():
            spans.append((spans[-1][1] if spans else 0, (spans[-1][1] if spans else 0) + len(cols)))
        columns = [options["y"], *options["x1"], *[c for cols in groups.values() for c in cols]]
        place = "common" if options.get("common_fes") else "added" if effects else ""
        for told in zip(*_moments(df, columns, unit, effects[0] if effects else None, weights, counts, reps, na_action, hot_cells, most_counts), strict=True):
            try:
                got.append(_contributions(*told, len(options["x1"]), spans, place))
            except (ValueError, np.linalg.LinAlgError):
                continue
    else:
        for r in range(reps):
            drawn = counts.select(unit, F.conv(F.hex(F.substring("__draws", 2 * r + 1, 2)), 16, 10).cast("double").alias("__drawn")).where("__drawn > 0")
            rows = df.join(drawn, unit)
            if weights:
                rows = rows.withColumn("__drawn", F.col("__drawn") * F.col(weights))
            try:
                got.append(decompose(rows, weights="__drawn", fweights=not weights, **options).delta)
            except (ValueError, np.linalg.LinAlgError):
                continue
    if len(got) < 0.9 * reps:
        raise RuntimeError(f"{len(got)} of {reps} draws are valid")
    got = np.stack(got)
    low, high = np.quantile(got, [(1 - conf) / 2, (1 + conf) / 2], axis=0)
    if kind == "basic":
        low, high = 2 * point.delta - high, 2 * point.delta - low
    return [{"target": t, "group": g, "delta": float(point.delta[i, j]), "se": float(got[:, i, j].std(ddof=1)), "low": float(low[i, j]), "high": float(high[i, j]), "valid": len(got)} for j, t in enumerate(point.targets) for i, g in enumerate(point.groups)]
