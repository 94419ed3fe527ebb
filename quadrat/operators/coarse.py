"""The graph of two effects contracted to few clusters of levels, for the cluster's iterations.

Each node joins the neighbour with the heaviest edge (ties by a hash of the edge); what hangs together so is a node of the next graph, whose
edges add up. Every round at least halves the nodes that have edges, so it ends, after rounds that are logarithmic. The last graph is
counted, comes to the driver and is factorised (factor.py). Clusters are only labels: nothing gathers a cluster's levels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factor import LaplacianFactor
from .sample import counted, keep_cut

#: What the driver factorises.
MOST_CLUSTERS = 200_000
MOST_LINKS = 2_000_000


class Coarse:
    """Clusters of the nodes (64-bit numbers) of edges (u, v, w), which may be repeated.

    places: (node, place), the cluster of each node that belongs to one with edges to others, by its number in 0..size-1.
    """

    def __init__(self, edges: DataFrame):
        from .graph import components

        links, nodes, self.rounds = _summed(edges), None, 0
        while True:
            ends = links.select(F.col("u").alias("g")).union(links.select(F.col("v").alias("g"))).distinct()
            if nodes is None:
                nodes = keep_cut(ends.select(F.col("g").alias("node"), "g"))
            n_links, n_ends = links.count(), ends.count()
            if n_ends <= MOST_CLUSTERS and n_links <= MOST_LINKS:
                break
            self.rounds += 1
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
            lot = F.xxhash64(F.lit(self.rounds), F.least("u", "v"), F.greatest("u", "v"))
            chosen = both.groupBy("u").agg(F.max_by("v", F.struct("w", lot)).alias("v"))
            root = components(chosen)
            to = lambda name: root.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: E731, B023
            nodes = keep_cut(nodes.join(to("g"), "g", "left").select("node", F.coalesce("g_root", "g").alias("g")))
            links = _summed(links.join(to("u"), "u").join(to("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"), "w"))
        table = links.toArrow()
        u, v, w = (table.column(c).to_numpy() for c in "uvw")
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.size = len(names)
        self.factor = LaplacianFactor(self.size, at[: len(u)], at[len(u) :], w)
        numbers = _local(edges.sparkSession, {"g": names, "place": np.arange(self.size)})
        self.places = keep_cut(nodes.join(counted(numbers, self.size), "g").select("node", "place"))

    def solve(self, state: DataFrame, left: list) -> tuple[DataFrame, np.ndarray]:
        """For rows with a place: (place, c0, c1, ...) with the coarse solution of each column, and the products of sums and solutions.

        left: for each column what is to be added up by place.
        """
        sums = state.where("place IS NOT NULL").groupBy("place").agg(*[F.sum(c).alias(f"s{n}") for n, c in enumerate(left)]).toArrow()
        at, made, products = sums.column("place").to_numpy(), {"place": np.arange(self.size)}, []
        for n in range(len(left)):
            r = np.zeros(self.size)
            r[at] = sums.column(f"s{n}").to_numpy()
            made[f"c{n}"] = self.factor.solve(r)
            products.append(float(r @ made[f"c{n}"]))
        return counted(_local(state.sparkSession, made), self.size), np.array(products)


def _summed(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, from the smaller to the greater, repeated ones added."""
    some = edges.where("u <> v AND w > 0").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("w").cast("double").alias("w"))
    return keep_cut(some.select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))


def _local(spark, columns: dict) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))
