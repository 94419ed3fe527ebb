"""Components of the graph of two effects, and the degrees of freedom that effects take up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .absorb import as_effect
from .sample import keep_cut


#: Distinct edges up to which one task joins them all.
MOST_EDGES = 2_000_000


def joined_nodes(u: np.ndarray, v: np.ndarray, keys=None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges and the root of each: of the nodes joined with it, the one with the least key.

    keys: a function that gives values to the distinct nodes in ascending order; without it a node is its own key.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.arange(len(nodes)) if keys is None else np.argsort(keys(nodes), kind="stable")
    back = np.empty(len(nodes), np.int64)
    back[order] = np.arange(len(nodes))
    a, b = back[at[: len(u)]], back[at[len(u) :]]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not ((up := root[root]) == root).all():
            root = up
        a, b = root[a], root[b]
        left = a != b
        a, b = a[left], b[left]
    return nodes, nodes[order[root[back]]]


def components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, root): the least node reachable over edges (u, v) of 64-bit numbers, for each node that has an edge to another.

    Up to MOST_EDGES distinct edges one task joins them. Beyond, stars: in turn, each node links its larger neighbours, and then its
    smaller ones and itself, to the least of them. Distances halve, so rounds are logarithmic also on long paths, and links
    that fall together are dropped as they come up.
    """
    links = keep_cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if links.count() <= (MOST_EDGES if most_edges is None else most_edges):
        return keep_cut(links.repartition(1).mapInArrow(_roots, "node long, root long"))
    told = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = keep_cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    return keep_cut(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _roots(batches):
    import pyarrow as pa

    batches = list(batches)
    if batches:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in "uv")
        nodes, roots = joined_nodes(u, v)
        for low in range(0, len(nodes), 100_000):
            yield pa.record_batch([pa.array(nodes[low : low + 100_000]), pa.array(roots[low : low + 100_000])], ["node", "root"])


def mobility_groups(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, group): the connected component of each level of a in the bipartite graph with b, named by its least level of a.

    Up to MOST_EDGES distinct edges, counted first, one task joins them; beyond, components() of 64-bit hashes of the levels (two
    levels that share one raise).
    """
    edges = keep_cut(df.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    if edges.count() <= MOST_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return keep_cut(edges.coalesce(1).mapInArrow(_groups, f"a {kind}, group {kind}")).withColumnRenamed("a", a)
    levels = keep_cut(edges.select("a").distinct().withColumn("node", F.xxhash64(F.lit(1), "a")))
    if levels.groupBy("node").count().where("count > 1").head(1):
        raise RuntimeError(f"two levels of {a} share a hash")
    found = components(edges.select(F.xxhash64(F.lit(1), "a").alias("u"), F.xxhash64(F.lit(2), "b").alias("v")))
    named = keep_cut(levels.join(found, "node").select("a", "root"))
    return keep_cut(named.join(named.groupBy("root").agg(F.min("a").alias("group")), "root").select(F.col("a").alias(a), "group"))


def _groups(batches):
    """The levels of a and their groups, from all edges."""
    import pyarrow as pa
    import pyarrow.compute

    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    kind = table.schema.field("a").type
    codes = []
    for c in ("a", "b"):
        values = table.column(c).combine_chunks().dictionary_encode() if not isinstance(table.column(c).type, pa.DictionaryType) else table.column(c).combine_chunks()
        order = pa.compute.sort_indices(values.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes.append((values.dictionary.take(pa.array(order)), rank[values.indices.to_numpy()]))
    (levels, x), (_, y) = codes
    # levels of a come first in their order, so the least node of a component is its least level of a
    nodes, roots = joined_nodes(x, y + len(levels))
    some = nodes < len(levels)
    out = pa.record_batch([levels.take(pa.array(nodes[some])).cast(kind), levels.take(pa.array(roots[some])).cast(kind)], ["a", "group"])
    for low in range(0, out.num_rows, 100_000):
        yield out.slice(low, 100_000)


def mobility_profile(df: DataFrame, a: str, b: str, weight: str | None = None) -> dict:
    """The graph of a and b: its components, the largest one's share of the rows and of the weight, and its class.

    A graph is highly connected if the largest component has nine tenths of the rows, moderately from a half on.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    groups = mobility_groups(df, a, b)
    told = df.groupBy(a).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w")).join(groups, a).groupBy("group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts, n, total, top, heavy = told.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w"), F.max("n"), F.max("w")).first()
    share = top / n if n else 0.0
    return {"components": parts, "largest_share": share, "largest_weight_share": heavy / total if total else 0.0, "class": "high" if share >= 0.9 else "moderate" if share >= 0.5 else "low"}


def largest_pair(df: DataFrame, keys: list[str]) -> tuple[str, str]:
    """The two keys with the most levels, ties from the left."""
    if len(keys) < 2:
        raise ValueError("a pair needs two keys")
    levels = df.agg(*[F.countDistinct(k) for k in keys]).first()
    order = sorted(range(len(keys)), key=lambda i: (-levels[i], i))[:2]
    return tuple(keys[i] for i in order)


def nested(df: DataFrame, inner: str, outer: str) -> bool:
    """Whether each level of inner lies in one level of outer."""
    return df.groupBy(inner).agg(F.min(outer).alias("lo"), F.max(outer).alias("hi")).where("lo <> hi").isEmpty()


def absorbed(df: DataFrame, keys: list, clusters: list[str] = (), intercept: bool = True, method: str = "all", weight: str | None = None) -> dict:
    """Levels, redundant levels and absorbed degrees of freedom of the effects, for models clustered by `clusters`.

    method: all (or pairwise), firstpair or none: which pairs of effects are searched for mobility groups. exact tells for
    each effect whether its redundant levels are known, not just bounded. Slopes add what slope_coefficients() counts.
    """
    if method not in ("all", "pairwise", "firstpair", "none"):
        raise ValueError(f"degrees of freedom {method!r}")
    effects = [as_effect(k) for k in keys]
    sloped = [slope_coefficients(df, e.keys[0], list(e.slopes), e.intercept, weight) if e.slopes else 0 for e in effects]
    keys = [e.keys[0] for e in effects if e.intercept]
    if not keys:
        return {"levels": [], "redundant": [], "df_a": sum(sloped) if effects else int(intercept), "nested": [], "exact": []}
    levels = list(df.agg(*[F.countDistinct(k) for k in keys]).first())
    redundant = [0] * len(keys)
    inside = [any(k == c or nested(df, k, c) for c in clusters) for k in keys]
    rest = [i for i in range(len(keys)) if not inside[i]]
    for i in range(len(keys)):
        if inside[i]:
            redundant[i] = levels[i]
    coarse = [i for i in rest if any(j != i and levels[j] > levels[i] and nested(df, keys[j], keys[i]) for j in rest)]
    for i in coarse:
        redundant[i] = levels[i]
    rest = [i for i in rest if i not in coarse]
    pairs = {"none": 0, "firstpair": 2}.get(method, len(rest))
    for n, i in enumerate(rest[:pairs]):
        for j in rest[:n]:
            parts = mobility_groups(df, keys[j], keys[i]).select("group").distinct().count()
            redundant[i] = max(redundant[i], parts)
    for n, i in enumerate(rest):
        if n or any(inside):
            redundant[i] = max(redundant[i], 1)
    exact = [i not in rest or rest.index(i) < (2 if pairs else 1) for i in range(len(keys))]
    return {"levels": levels, "redundant": redundant, "df_a": sum(max(0, a - b) for a, b in zip(levels, redundant, strict=True)) + sum(sloped), "nested": inside, "exact": exact}


def slope_coefficients(df: DataFrame, key: str, slopes: list[str], intercept: bool, weight: str | None = None) -> int:
    """How many slope coefficients the levels of key identify: the rank of each level's carriers, less its intercept."""
    w = F.col(weight) if weight else F.lit(1.0)
    zs = [F.lit(1.0)] * intercept + [F.col(z) for z in slopes]
    if len(zs) == 1:
        return df.groupBy(key).agg(F.sum(w * zs[0] ** 2).alias("__a")).where("__a > 1e-12 * greatest(1D, __a)").count()
    if len(zs) == 2:
        told = df.groupBy(key).agg(F.sum(w * zs[0] * zs[0]).alias("__a"), F.sum(w * zs[0] * zs[1]).alias("__b"), F.sum(w * zs[1] * zs[1]).alias("__c"))
        rank = F.when(F.expr("__a * __c - __b * __b > 1e-12 * greatest(1D, __a * __c)"), 2).when(F.expr("greatest(__a, __c) > 0"), 1).otherwise(0)
        return told.agg(F.sum(rank - int(intercept))).first()[0] or 0
    told = df.groupBy(key).agg(F.array(*[F.sum(w * a * b) for a in zs for b in zs]).alias("g"))
    n = len(zs)

    def ranks(parts):
        import numpy as np
        import pandas as pd

        for part in parts:
            g = np.stack(part["g"].to_numpy()).reshape(-1, n, n)
            d = np.sqrt(np.maximum(np.einsum("nii->ni", g), 1e-300))
            yield pd.DataFrame({"rank": np.linalg.matrix_rank(g / d[:, :, None] / d[:, None, :], tol=1e-12, hermitian=True) - int(intercept)})

    return told.mapInPandas(ranks, "rank long").agg(F.sum("rank")).first()[0] or 0
