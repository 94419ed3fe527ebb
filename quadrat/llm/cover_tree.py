"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Vectors are normalised, so a least cosine is a greatest distance: |x - y|^2 = 2 - 2 cos. Equal vectors are one class
with a weight. A tree's levels are nested nets with halving radii: the centres of a level are farther apart than its
radius, every point of a node is within it of one, and a node's covering radius is measured over its points.

Traversing a tree against another, level by level, a pair of nodes is dropped if their centres are farther apart than
the distance plus both covering radii, and settled if their centres' distance and both radii together are within it: then all its
pairs are links, which are counted without being made. What is left at the leaves is compared by the cosines themselves, in double precision.

The upper tree comes from a bounded sample of classes; every class belongs to its nearest lowest centre, whose covering
radius is then taken over all of them. A node of the sample whose net would need more than a sixteenth of its points
is left whole there: its points are nearly all apart, and cells of a few points would each meet nearly all others. The
traversal of the upper tree against itself leaves pairs of cells; cells of many classes are dealt out in blocks. For each
pair of blocks a task builds the lower trees, which are split to the end, and traverses them.

A task returns for each class the weight of its links and enough edges to join what its links join, so rows grow with classes, not with links.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_arrow, joined_nodes, settle

SAMPLE, BLOCK = 2000, 10_000
#: More than single-precision products of unit vectors are off by.
ROUGH = 1e-5


@dataclass
class Level:
    """centres: a row for each node; radii: covering radii; parents: nodes of the level above; node: of each row."""

    centres: np.ndarray
    radii: np.ndarray
    parents: np.ndarray
    node: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.node, kind="stable")
        self.sizes = np.bincount(self.node, minlength=len(self.centres))
        self._rows, self._at = order, np.searchsorted(self.node[order], np.arange(len(self.centres) + 1))
        self._own = np.argsort(self.parents, kind="stable")
        self._below = np.searchsorted(self.parents[self._own], np.arange(self.parents.max(initial=-1) + 2))

    def members(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the nodes, laid end to end, and their numbers."""
        return spread(self._rows, self._at, nodes)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of this level below nodes of the one above, and their numbers."""
        return spread(self._own, self._below, nodes)


def spread(values: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = at[k + 1] - at[k]
    return values[np.repeat(at[k] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def net(points: np.ndarray, own: np.ndarray, centre: int, radius: float, most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of `own` that are farther apart than radius, the centre first, and for each of own the one it is within it of.

    None if there would be more than `most` of them.
    """
    least = 1 - radius * radius / 2
    found = [np.array([centre])]
    to = np.full(len(own), -1)
    to[points[own] @ points[centre] >= least] = 0
    to[own == centre] = 0
    left, n = np.flatnonzero(to < 0), 1
    while len(left):
        first = points[own[left[:128]]]
        near = first @ first.T >= least
        free = np.ones(len(first), bool)
        for k in range(len(first)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        new = np.flatnonzero(free)
        if n + len(new) > most:
            return None
        for k in range(0, len(left), 4000):
            some = left[k : k + 4000]
            product = points[own[some]] @ first[new].T
            best = product.argmax(1)
            to[some] = np.where(product[np.arange(len(some)), best] >= least, n + best, -1)
        to[left[new]] = n + np.arange(len(new))
        found.append(own[left[new]])
        n += len(new)
        left = left[to[left] < 0]
    return np.concatenate(found), to


def cover(points: np.ndarray, least_radius: float, leaf: int, share: float = 1.0) -> list[Level]:
    """The levels over unit rows; nodes of up to `leaf` rows are left whole, and those whose net takes more than a share of their rows."""
    rough = points.astype(np.float32)
    centres, node = np.zeros(1, np.int64), np.zeros(len(points), np.int64)
    levels = [Level(centres, covering(points, centres, node), np.full(1, -1), node)]
    radius = float(levels[0].radii[0]) / 2
    while radius > least_radius:
        above = levels[-1]
        order = np.argsort(above.node, kind="stable")
        at = np.searchsorted(above.node[order], np.arange(len(above.centres) + 1))
        whole = (np.diff(at) <= leaf) | (above.radii <= least_radius)
        if whole.all():
            break
        # nodes that stay whole are one child each; the rest are split
        centres, parents = [above.centres[whole]], [np.flatnonzero(whole)]
        number = np.full(len(above.centres), -1)
        number[whole] = np.arange(whole.sum())
        node, n = number[above.node], int(whole.sum())
        for k in np.flatnonzero(~whole).tolist():
            own = order[at[k] : at[k + 1]]
            found = net(rough, own, int(above.centres[k]), radius, max(8.0, share * len(own)))
            new, to = (above.centres[k : k + 1], 0) if found is None else found
            node[own] = n + to
            centres.append(new)
            parents.append(np.full(len(new), k))
            n += len(new)
        centres = np.concatenate(centres)
        levels.append(Level(centres, covering(points, centres, node), np.concatenate(parents), node))
        radius /= 2
    return levels


def covering(points: np.ndarray, centres: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.zeros(len(centres))
    for k in range(0, len(points), 20_000):
        own = node[k : k + 20_000]
        np.maximum.at(out, own, np.sqrt(((points[k : k + 20_000] - points[centres[own]]) ** 2).sum(1)))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def dual(one: list[Level], two: list[Level], a: np.ndarray, b: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Pairs of nodes of the last levels that no bound drops or settles, and by depth the pairs that are settled.

    one is two for a tree against itself; then pairs come in both orders, and no node is settled with itself.
    """
    slack = 1e-7
    a4, b4 = a.astype(np.float32), b.astype(np.float32)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    settled = []
    for depth in range(max(len(one), len(two))):
        p, q = one[min(depth, len(one) - 1)], two[min(depth, len(two) - 1)]
        if depth:
            tried = _tried(p if depth < len(one) else None, q if depth < len(two) else None, i, j)
        else:
            tried = [(i, j)]
        kept = []
        for x, y in tried:
            if x.ndim == 2:  # all of x with all of y; single precision drops no pair that double would keep
                # dot >= 1 - (most + r + s)^2 / 2 for radii r and s, as one product with three more columns
                r, t = p.radii[x[:, 0]], most + q.radii[y[0]]
                left = np.column_stack([a4[p.centres[x[:, 0]]], r, r * r / 2, np.ones(len(r))]).astype(np.float32)
                right = np.column_stack([b4[q.centres[y[0]]], t, np.ones(len(t)), t * t / 2]).astype(np.float32)
                u, v = np.nonzero(left @ right.T >= np.float32(1 - 2 * ROUGH))
                x, y = x[u, 0], y[0, v]
                r = p.radii[x] + q.radii[y]
                rough = np.einsum("ij,ij->i", a4[p.centres[x]], b4[q.centres[y]])
                exact = (r <= most) & (rough >= 1 - (most - r) ** 2 / 2 - ROUGH)
                kept.append((x[~exact], y[~exact]))
                x, y = x[exact], y[exact]
            for k in range(0, len(x), 50_000):
                s = slice(k, k + 50_000)
                d = np.sqrt(((a[p.centres[x[s]]] - b[q.centres[y[s]]]) ** 2).sum(1))
                r = p.radii[x[s]] + q.radii[y[s]]
                inside = (d + r <= most - slack) & ((p is not q) | (x[s] != y[s]))
                near = (d <= most + r + slack) & ((p is not q) | (x[s] != y[s]) | (p.sizes[x[s]] > 1))
                settled.append((depth, x[s][inside], y[s][inside]))
                kept.append((x[s][near & ~inside], y[s][near & ~inside]))
        i, j = (np.concatenate(z) for z in zip(*kept, strict=True)) if kept else (i[:0], j[:0])
    return i, j, settled


def runs(i: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cut = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)] if len(i) else []
    return list(zip(cut[:-1], cut[1:], strict=True))


def _tried(p: Level | None, q: Level | None, i: np.ndarray, j: np.ndarray):
    """Pairs of the children of pairs (i, j), as index arrays or as a column and a row that stand for all their pairs; None: that side stays."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    few: list[tuple] = []
    held = 0
    for lo, hi in runs(i):
        x = i[lo : lo + 1] if p is None else p.children(i[lo : lo + 1])[0]
        y = j[lo:hi] if q is None else q.children(j[lo:hi])[0]
        if len(x) * len(y) <= 64:
            few.append((np.repeat(x, len(y)), np.tile(y, len(x))))
            held += len(x) * len(y)
            if held > 200_000:
                yield tuple(np.concatenate(z) for z in zip(*few, strict=True))
                few, held = [], 0
            continue
        for k in range(0, len(x), 1000):
            yield x[k : k + 1000, None], y[None]
    if few:
        yield tuple(np.concatenate(z) for z in zip(*few, strict=True))


def _cells(centres: np.ndarray):
    """Each class with its nearest lowest centre and the distance to it."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 1000):
                d = distance(x[i : i + 1000], centres)
                cell[i : i + 1000], far[i : i + 1000] = d.argmin(1), d.min(1)
            yield pa.record_batch([batch.column("id"), batch.column("weight"), batch.column("unit"), pa.array(cell), pa.array(far)], ["id", "weight", "unit", "cell", "far"])

    return batches


def _compared(cosine: float, dims: int):
    most = math.sqrt(max(2 - 2 * cosine, 0))

    def links(side, ids, weight, x):
        """(id, weight of its links, a class it is linked with or null) of one pair of blocks."""
        same = not (side == 1).any()
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        if not len(a):
            return None
        xa, xb = x[a], x[b]
        one = cover(xa, most / 8, 1)
        two = one if same else cover(xb, most / 8, 1)
        i, j, settled = dual(one, two, xa, xb, most)
        total = np.zeros(len(ids), np.int64)
        joins: list[tuple] = []

        def join(u, v):
            joins.append((u, v))
            if sum(len(x) for x, _ in joins) > 2_000_000:
                joins[:] = [joined_nodes(*(np.concatenate(z) for z in zip(*joins, strict=True)))]

        # Every member of one node with every member of the other: counted by the nodes' weights.
        for depth, p, q in settled:
            if len(p):
                for side, tree, rows, here, there in ((0, one, a, p, q), (1, two, b, q, p)):
                    if side and same:
                        continue
                    level, other, others = tree[min(depth, len(tree) - 1)], *(((two, b), (one, a))[side])
                    other = other[min(depth, len(other) - 1)]
                    heavy = np.bincount(other.node, weight[others], len(other.centres))
                    gain = np.bincount(here, heavy[there], len(level.centres))
                    total[rows] += np.rint(gain[level.node]).astype(np.int64)
                    met = np.flatnonzero(gain[level.node])
                    join(rows[met], rows[level.centres[level.node[met]]])
                m, n = one[min(depth, len(one) - 1)], two[min(depth, len(two) - 1)]
                join(a[m.centres[p]], b[n.centres[q]])
        ma, mb = one[-1], two[-1]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for lo, hi in runs(i):
            p, q = ma.members(i[lo : lo + 1])[0], mb.members(j[lo:hi])[0]
            for k in range(0, len(p), 500):
                own = p[k : k + 500]
                near = xa[own] @ xb[q].T >= cosine
                if same:
                    near &= a[own][:, None] != b[q][None]
                u, v = np.nonzero(near)
                u, v = a[own[u]], b[q[v]]
                total += np.bincount(u, weight[v], len(ids)).astype(np.int64) if len(u) else 0
                if not same and len(u):
                    total += np.bincount(v, weight[u], len(ids)).astype(np.int64)
                join(u, v)
        to = np.arange(len(ids))
        if joins:
            nodes, roots = joined_nodes(*(np.concatenate(z) for z in zip(*joins, strict=True)))
            to[nodes] = roots
        some = np.flatnonzero((total > 0) | (to != np.arange(len(ids))))
        return ids[some], total[some], ids[to[some]]

    def batches(it):
        import pyarrow as pa

        def out(rows):
            got = links(*rows[1:])
            if got is not None and len(got[0]):
                yield pa.record_batch([pa.array(c) for c in got], ["id", "n", "to"])

        held = None
        for batch in it:
            name = np.empty(batch.num_rows, object)
            name[:] = batch.column("pair").to_pylist()
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, dims)
            rows = [name, *(np.asarray(batch.column(c)) for c in ("side", "id", "weight")), x]
            held = rows if held is None else [np.concatenate(y) for y in zip(held, rows, strict=True)]
            cut = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield from out([y[lo:hi] for y in held])
            held = [y[cut[-1] :] for y in held]
        if held is not None and len(held[0]):
            yield from out(held)

    return batches


def _units(vectors: DataFrame) -> DataFrame:
    """(id, unit): rows with a finite vector that isn't zero; unit: its direction as bytes of doubles, by dimension."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            units = []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.zeros(0)
                top = np.abs(x).max(initial=0.0)
                if not np.isfinite(top) or top == 0:
                    units.append(None)
                    continue
                x = x / top
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.record_batch([batch.column("id"), pa.array(units, pa.binary())], ["id", "unit"])

    return vectors.transform(in_arrow, batches, "id long, unit binary")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector, with 64-bit integer ids.

    Two vectors are linked if their cosine is at least `cosine`. Vectors that are null, empty or zero, or hold null, NaN or infinite
    components, are linked with nothing, nor are vectors of different dimensions. Rows that share an id are vectors of
    their own in the counts. A null id is linked with nothing.
    """
    spark = vectors.sparkSession
    told = settle(_units(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))))
    good = told.where("unit IS NOT NULL AND id IS NOT NULL")
    classes = settle(good.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    found = None
    for (size,) in classes.select(F.length("unit")).distinct().orderBy(F.length("unit")).collect():
        part = _linked(spark, classes.where(F.length("unit") == size), size // 8, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, to long")
    found = settle(found)
    groups = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = told.withColumn("key", F.when(F.col("id").isNotNull(), F.col("unit"))).join(named.withColumnRenamed("unit", "key"), "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _linked(spark, classes: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(id, n, to): the weight of each class's links to others, in parts that add up, and edges that join what they join."""
    import pyarrow as pa

    most = math.sqrt(max(2 - 2 * cosine, 0))
    sample = classes.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).collect()
    points = np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.float64).reshape(-1, dims)
    # Cells of about a block; where the sample has no clusters, the tree stays shallow and blocks do the dealing.
    upper = cover(points, most / 2, max(24, SAMPLE * BLOCK // max(classes.count(), 1)), share=1 / 16)
    centres = points[upper[-1].centres]
    placed = settle(classes.transform(in_arrow, _cells(centres), "id long, weight long, unit binary, cell int, far double"))
    # At most SAMPLE cells; a large one is dealt out in blocks by hash.
    cells = {r["cell"]: (r["far"], -(-r["n"] // BLOCK)) for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    # Covering radii of the upper nodes, over all classes: by the children's.
    upper[-1].radii = np.array([cells.get(k, (0.0, 0))[0] for k in range(len(centres))])
    for above, below in zip(upper[-2::-1], upper[:0:-1], strict=True):
        far = np.sqrt(((points[below.centres] - points[above.centres[below.parents]]) ** 2).sum(1))
        above.radii = np.zeros(len(above.centres))
        np.maximum.at(above.radii, below.parents, below.radii + far)
    blocks = np.array([cells.get(k, (0.0, 0))[1] for k in range(len(centres))], np.int32)
    i, j, settled = dual(upper, upper, points, points, most)
    # Cells whose vectors are all links of each other are counted by the tasks like the rest.
    for depth, p, q in settled:
        down = np.arange(len(upper[depth].centres))
        for level in upper[depth + 1 :]:
            down = down[level.parents]
        for x, y in zip(p.tolist(), q.tolist(), strict=True):
            x, y = np.flatnonzero(down == x), np.flatnonzero(down == y)
            i, j = np.concatenate([i, np.repeat(x, len(y))]), np.concatenate([j, np.tile(y, len(x))])
    keep = (blocks[i] > 0) & (blocks[j] > 0)
    # For each cell: the cells it meets and their blocks; at most the square of the sample, whatever the table.
    meets = pa.table({"cell": pa.array(i[keep], pa.int32()), "blocks": blocks[i[keep]], "other": pa.array(j[keep], pa.int32()), "n": blocks[j[keep]]})
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = placed.join(F.broadcast(spark.createDataFrame(meets)), "cell").withColumn("own", own)
    dealt = dealt.select("cell", "own", "id", "weight", "unit", "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    lower = (F.col("cell") < F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("own") <= F.col("block")))
    pair = F.when(lower, F.concat_ws(":", "cell", "own", "other", "block")).otherwise(F.concat_ws(":", "other", "block", "cell", "own"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(pair.alias("pair"), F.when(lower, 0).otherwise(1).cast("int").alias("side"), "id", "weight", "unit").repartition(parts, "pair").sortWithinPartitions("pair", "id")
    return dealt.transform(in_arrow, _compared(cosine, dims), "id long, n long, to long")
