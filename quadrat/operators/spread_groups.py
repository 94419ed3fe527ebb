"""Effects of members on the outcomes of their groups, projected in the cluster.

A group's row is the sum of its members' effects, each times its share, and of the effects of the group's own levels. Groups are dealt out to
blocks with their bridge (group, level, share), levels lie in buckets, and gradients go over them as in spread_akm: a block turns
the levels' values into values of its groups and those back into its part of each level's sum. One group's bridge is held by one task.

Up to MOST_VALUES the levels' vectors are held by the driver (few_levels): a round broadcasts a direction, tasks read their groups where these
were written, and what is shuffled are the sums of each task, so that no group or bridge moves in a round.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread_akm
from .sample import keep_cut
from .spread_akm import BLOCK, BUCKET, Block, SpreadSystem, _arrays, _bucket, _table


#: Levels times columns up to which the driver holds the gradients' vectors, and levels in one message of a task.
MOST_VALUES, LEVELS_SENT = 4_000_000, 50_000


def few_levels(gathered: DataFrame, levels: DataFrame, columns: list[str], group: str, fes: list[str], weight: str | None, aggregation: str, tol: float = 1e-12, most_rounds: int = 5000) -> tuple[DataFrame, DataFrame, int]:
    """(group, columns less what levels explain), (kind, level, columns' coefficients) and rounds, from rows of groups with their
    __members and the levels (kind, level, node)."""
    import pyarrow as pa

    spark, width, own = gathered.sparkSession, len(columns), len(fes)
    nodes = np.sort(levels.select("node").toArrow()["node"].to_numpy())
    if (nodes[1:] == nodes[:-1]).any():
        raise RuntimeError("two ids share a hash")
    mean, n, every = aggregation == "mean", len(nodes), spark.sparkContext.broadcast(nodes)
    node = F.concat(F.transform("__members", lambda m: F.xxhash64(F.lit(0), m)), F.array(*[F.xxhash64(F.lit(d), k) for d, k in enumerate(fes, 1)]).cast("array<bigint>"))
    told = gathered.select(F.col(group).alias("g"), node.alias("node"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def packed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            entries, rows = b.column("node"), b.num_rows
            low, high = entries.offsets[0].as_py(), entries.offsets[rows].as_py()
            at = np.searchsorted(every.value, entries.values.to_numpy()[low:high]).astype(np.int32)
            c = np.stack([b.column(f"c{i}").to_numpy() for i in range(width)])
            sizes = np.diff(entries.offsets.to_numpy()[: rows + 1]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), b.column("g"))
            yield pa.record_batch([kept, *(pa.array([v.tobytes()], pa.binary()) for v in (sizes, at, b.column("w").to_numpy(), c))], ["g", "sizes", "at", "w", "c"])

    blocks = keep_cut(told.mapInArrow(packed, f"g array<{gathered.schema[group].dataType.simpleString()}>, sizes binary, at binary, w binary, c binary"))
    tasks = spark.sparkContext.defaultParallelism

    def opened(batches):
        """Of each block its row, each entry's level, share and group, where groups begin, their weights and columns."""
        for b in batches:
            for i in range(b.num_rows):
                sizes, at, w, c = (np.frombuffer(b.column(k)[i].as_py(), kind) for k, kind in (("sizes", np.int32), ("at", np.int32), ("w", float), ("c", float)))
                first = np.cumsum(sizes) - sizes
                share = np.repeat(1.0 / (sizes - own) if mean else np.ones(len(sizes)), sizes)
                for d in range(own):
                    share[first + sizes - 1 - d] = 1.0
                yield b.column("g")[i].values, at, share, np.repeat(np.arange(len(sizes)), sizes), first, w, c.reshape(width, -1)

    def summed(add, height: int) -> np.ndarray:
        """The sums over blocks of what add(out, *block) adds to out, a matrix of height rows and a column for each level."""

        def run(batches):
            out = np.zeros((height, n))
            for _, *b in opened(batches):
                add(out, *b)
            for k in range(0, n, LEVELS_SENT):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(out[:, k : k + LEVELS_SENT]).tobytes()], pa.binary())], ["low", "data"])

        def total(table):
            out = sum(np.frombuffer(x.as_py()) for x in table.column("data"))
            return pa.table({"low": table.column("low").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

        schema, out = "low int, data binary", np.zeros((height, n))
        for row in blocks.coalesce(tasks).mapInArrow(run, schema).groupBy("low").applyInArrow(total, schema).collect():
            some = np.frombuffer(row["data"]).reshape(height, -1)
            out[:, row["low"] : row["low"] + some.shape[1]] = some
        return out

    def given(out, at, share, of, first, w, c):
        for j in range(width):
            np.add.at(out[j], at, share * (w * c[j])[of])
        np.add.at(out[width], at, share**2 * w[of])

    def times(z: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(z)

        def add(out, at, share, of, first, w, c):
            for j in range(width):
                np.add.at(out[j], at, share * (w * np.add.reduceat(share * sent.value[j][at], first))[of])

        out = summed(add, width)
        sent.destroy()
        return out

    *right, scale = summed(given, width + 1)
    right, scale = np.array(right), np.maximum(scale, 1e-300)
    norm = lambda v: np.sqrt((v * v).sum(1))
    size = np.where(norm(right) > 0, norm(right), 1.0)
    x, rest, rounds, before = np.zeros_like(right), right.copy(), 0, np.inf
    while True:
        z = rest / scale
        p, rz = z.copy(), (rest * z).sum(1)
        while rounds < most_rounds and (turns := (norm(rest) > tol * size) & (rz > 0)).any():
            v, rounds = times(p), rounds + 1
            pv = (p * v).sum(1)
            step = np.where(turns & (pv > 0), rz / np.where(pv > 0, pv, 1), 0.0)[:, None]
            x, rest = x + step * p, rest - step * v
            z = rest / scale
            new = (rest * z).sum(1)
            p, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)[:, None] * p, new
        # what is truly left; gradients begin anew from it, as long as that helps
        rest = right - times(x)
        left = float((norm(rest) / size).max())
        if left <= 10 * tol or left > before / 2 or rounds >= most_rounds:
            break
        before = left
    if left > 1e-8:
        raise RuntimeError("individual effects did not settle")
    solution = spark.sparkContext.broadcast(x)

    def less(batches):
        for g, at, share, _, first, _, c in opened(batches):
            yield pa.record_batch([g, *(pa.array(c[j] - np.add.reduceat(share * solution.value[j][at], first)) for j in range(width))], ["group", *columns_out])

    columns_out = [f"c{j}" for j in range(width)]
    out = blocks.mapInArrow(less, f"group {gathered.schema[group].dataType.simpleString()}" + "".join(f", {c} double" for c in columns_out))
    found = spark.createDataFrame(pa.table({"node": nodes} | {f"x{j}": x[j] for j in range(width)}))
    return out.select("group", *[F.col(f"c{j}").alias(c) for j, c in enumerate(columns)]), levels.join(found, "node"), rounds


def _group_block(n_buckets: int, columns: int):
    """A block's row: wi, fi and t are each bridge entry's group, level and share; s is the groups' weight and extra their columns."""

    def run(table):
        c = {k: table.column(k).to_numpy() for k in table.column_names}
        order = np.lexsort((c["node"], c["g"]))
        c = {k: v[order] for k, v in c.items()}
        groups, first, wi = np.unique(c["g"], return_index=True, return_inverse=True)
        nodes = np.unique(c["node"])
        by = np.lexsort((nodes, nodes % n_buckets))
        place = np.empty(len(nodes), np.int64)
        place[by] = np.arange(len(nodes))
        extra = np.concatenate([c[f"c{i}"][first] for i in range(columns)])
        none = np.full(len(order), -1)
        return _table([{"block": int(c["block"][0]), "wi": wi, "fi": place[np.searchsorted(nodes, c["node"])], "hi": none, "t": c["share"], "s": c["weight"][first], "ss": none[:0], "extra": extra, "w": groups, "f": none[:0], "nodes": nodes[by], "of": (nodes % n_buckets)[by]}], BLOCK)

    return run


class GroupBlock(Block):
    def __init__(self, b: dict):
        super().__init__(b)
        self.columns = self.extra.reshape(-1, len(self.s)).T

    def diagonal(self) -> np.ndarray:
        return np.bincount(self.fi, self.t**2 * self.s[self.wi], len(self.nodes))

    def totals(self, low: int, high: int, z: np.ndarray) -> tuple[np.ndarray, slice]:
        """What the levels' values add up to in the groups of a chunk."""
        wi = self.wi[low:high]
        first = np.flatnonzero(np.diff(wi, prepend=-1))
        return np.add.reduceat(self.t[low:high, None] * z[self.fi[low:high]], first), slice(int(wi[0]), int(wi[-1]) + 1)

    def back(self, out: np.ndarray, low: int, high: int, values: np.ndarray, groups: slice) -> None:
        """Add values of a chunk's groups, times weight and share, to their levels."""
        k = self.wi[low:high] - groups.start
        self.add(out, self.fi[low:high], self.t[low:high, None] * (self.s[groups, None] * values)[k])

    def right(self, rhs, width: int) -> np.ndarray:
        out = np.zeros((len(self.nodes), width))
        for low, high in self.chunks():
            groups = slice(int(self.wi[low]), int(self.wi[high - 1]) + 1)
            self.back(out, low, high, self.columns[groups], groups)
        return out

    def times(self, z: np.ndarray) -> np.ndarray:
        out = -self.diagonal()[:, None] * z
        for low, high in self.chunks():
            values, groups = self.totals(low, high, z)
            self.back(out, low, high, values, groups)
        return out

    def effects(self, rhs, x: np.ndarray):
        yield np.concatenate([self.totals(low, high, x)[0] for low, high in self.chunks()])


def _level_parts(batches):
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            b = GroupBlock(_arrays(batch, i))
            yield pa.record_batch([pa.array(b.of, pa.int32()), pa.array(b.nodes), pa.array(np.full(len(b.nodes), b.block, np.int32)), pa.array(b.diagonal())], ["nb", "node", "block", "d"])


class SpreadGroups(SpreadSystem):
    """The normal equations of levels, from entries (group, level, share), both of any type and level with a kind, and rows (group, weight, columns)."""

    block_kind = GroupBlock

    def __init__(self, entries: DataFrame, rows: DataFrame, columns: list[str], weight: str | None):
        keyed = entries.select("group", "kind", "level", "share", F.xxhash64(F.lit(1), "group").alias("g"), F.xxhash64(F.lit(2), "kind", "level").alias("node"))
        values = rows.select(F.col("group"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        self.entries = keep_cut(keyed.join(values, "group"))
        self.levels = keep_cut(self.entries.select("kind", "level", "node").distinct())
        self.groups = keep_cut(self.entries.select("group", "g").distinct())
        for df, key in ((self.levels, "node"), (self.groups, "g")):
            if df.groupBy(key).count().where("count > 1").head(1):
                raise RuntimeError("two ids share a hash")
        n, levels = self.entries.count(), self.levels.count()
        n_blocks, n_buckets = max(1, math.ceil(n / spread_akm.BLOCK_MATCHES)), max(1, math.ceil(levels / spread_akm.BUCKET_NODES))
        placed = self.entries.withColumn("block", F.expr(f"cast(pmod(g, {n_blocks}) AS int)"))
        dealt = placed.select("block", "g", "node", F.col("share").cast("double").alias("share"), "weight", *[f"c{i}" for i in range(len(columns))])
        self.blocks = keep_cut(dealt.groupBy("block").applyInArrow(_group_block(n_buckets, len(columns)), BLOCK))
        self.buckets = keep_cut(self.blocks.mapInArrow(_level_parts, "nb int, node long, block int, d double").groupBy("nb").applyInArrow(_bucket, BUCKET))
        self.rounds, self.columns = 0, columns

    def project(self) -> tuple[DataFrame, DataFrame]:
        """(group, columns less what levels explain) and (kind, level, columns' coefficients, node)."""
        columns, width = self.columns, len(self.columns)
        state = keep_cut(self.solve(None, width))

        def left(b, x):
            import pyarrow as pa

            rest = b.columns - next(b.effects(None, x))
            return pa.table({"g": b.w} | {f"c{i}": rest[:, i] for i in range(width)})

        out = self._to_blocks(state, "x", width, "g long" + "".join(f", c{i} double" for i in range(width)), left)

        def solved(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    k = _arrays(batch, i)
                    x = np.frombuffer(k["x"]).reshape(-1, width)
                    yield pa.record_batch([pa.array(k["nodes"]), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(width))], ["node", *(f"x{i}" for i in range(width))])

        found = state.select("nodes", "x").mapInArrow(solved, "node long" + "".join(f", x{i} double" for i in range(width)))
        return out.join(self.groups, "g").select("group", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]), self.levels.join(found, "node")
