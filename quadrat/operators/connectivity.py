"""Workers whose leaving splits the graph of movers and firms, found in the cluster.

Rows lie by worker and in order of workers, so a task links each firm of a worker to the next and keeps a spanning forest of its links,
which is no larger than its firms; forests are put together until one is left. Only workers with a link in it can split anything, as the forest
needs no other. Firms that the other workers join are one from then on, and what is left to search are the forest's workers at two such firms or more.

Movers between the same two firms are edges side by side: two of them stand for all, and neither splits anything. Tasks then
reduce the workers they are dealt to a certificate: a scan-first forest, and a spanning forest of the rest. Where
two nodes hang together without a third, they do so in the certificate as well, whatever other edges are added; so certificates of parts are dealt
out anew and reduced again, until one task takes what is left and searches it depth-first. A task has all edges of its workers, so
one with a single edge left splits nothing and goes, and one with two is itself an edge between firms, of which forests
keep two for each firm: what is left grows with the firms, not with the workers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _roots, joined_nodes
from .sample import counted, keep_cut

#: Edges that the last task takes, and about as many as one that reduces them is dealt.
MOST_TASK_EDGES, TASK_EDGES = 5_000_000, 2_000_000
#: Links that a task gathers before it makes its forest anew.
LINKS = 1_000_000


def scan_first_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which edges are in a scan-first forest of nodes 0 to n - 1: breadth first from the least node of each component, nodes of a level in their order."""
    if not len(a):
        return np.zeros(0, bool)
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    other, edge = other[order], order % len(a)
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    nodes, roots = joined_nodes(a, b)
    seen, taken = np.ones(n, bool), np.zeros(len(a), bool)
    seen[nodes] = False
    level = np.unique(roots)
    seen[level] = True
    while len(level):
        sizes = first[level + 1] - first[level]
        at = np.arange(int(sizes.sum())) + np.repeat(first[level] - (np.cumsum(sizes) - sizes), sizes)
        at = at[~seen[other[at]]]
        level, k = np.unique(other[at], return_index=True)  # the first edge to a node is from the node scanned first
        taken[edge[at[k]]] = True
        seen[level] = True
    return taken


def certificate(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which edges to keep so that, without any one node, the same nodes hang together as before: at most 2 (n - 1)."""
    kept = scan_first_forest(a, b, n)
    rest = np.flatnonzero(~kept)
    kept[rest[scan_first_forest(a[rest], b[rest], n)]] = True
    return kept


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which edges are in a spanning forest of nodes 0 to n - 1: each component takes its first edge to another, again and again."""
    root, taken, left = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        u, v = root[a[left]], root[b[left]]
        live = u != v
        left, u, v = left[live], u[live], v[live]
        if not len(left):
            return taken
        first = np.full(n, len(left))
        for x in (u, v):
            own = np.full(n, len(left))
            own[x[::-1]] = np.arange(len(left))[::-1]  # the last one written is the first edge
            first = np.minimum(first, own)
        some = np.flatnonzero(first < len(left))
        at = first[some]
        taken[left[at]] = True
        to = np.arange(n)
        to[some] = u[at] + v[at] - some
        both = (to[to] == np.arange(n)) & (to > np.arange(n))  # two that take the same edge: the lesser is the root
        to[both] = np.flatnonzero(both)
        while not ((up := to[to]) == to).all():
            to = up
        root = to[root]


def _forest(batches):
    """A spanning forest of links (u, v, worker), made anew when as many have come as it has, LINKS at least."""
    import pyarrow as pa

    kept, waiting, size = None, [], 0

    def reduced():
        table = pa.concat_tables(([kept] if kept is not None else []) + waiting).combine_chunks()
        u, v = (table.column(c).to_numpy() for c in "uv")
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        return table.take(np.flatnonzero(spanning(at[: len(u)], at[len(u) :], len(nodes))))

    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= max(LINKS, kept.num_rows if kept is not None else 0):
            kept, waiting, size = reduced(), [], 0
    if waiting:
        kept = reduced()
    if kept is not None:
        yield from kept.to_batches(max_chunksize=200_000)


def _linked(batches):
    """A spanning forest of what workers join, from rows (worker, node) in order of workers: each node of a worker is linked to the next."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def links():
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            w, node = (table.column(c).combine_chunks() for c in ("worker", "node"))
            same = pc.equal(w[1:], w[:-1])
            yield pa.record_batch([node[:-1].filter(same), node[1:].filter(same), w[1:].filter(same)], ["u", "v", "worker"])
            last = batch.slice(batch.num_rows - 1)

    yield from _forest(links())


def forest(rows: DataFrame) -> DataFrame:
    """(u, v, worker): a spanning forest of the nodes that workers join. rows: (worker, node), a worker's in one task and next to each other."""
    schema = f"u long, v long, worker {rows.schema['worker'].dataType.simpleString()}"
    links = keep_cut(rows.select("worker", "node").mapInArrow(_linked, schema))
    n, parts = links.count(), links.rdd.getNumPartitions()
    while parts > 1:
        parts = 1 if n <= MOST_TASK_EDGES else math.ceil(parts / 4)
        links = keep_cut(links.repartition(parts).mapInArrow(_forest, schema))
        n = links.count()
    return links


def roots(links: DataFrame) -> DataFrame:
    """(node, root): the least node joined with each that has a link in a forest."""
    return keep_cut(links.select("u", "v").repartition(1).mapInArrow(_roots, "node long, root long"))


def _coded(batches):
    """All rows of a task: the table, and codes of its workers and firms from 0, with their numbers."""
    import pyarrow as pa

    table = pa.Table.from_batches(batches).combine_chunks()
    codes = []
    for c in ("worker", "firm"):
        d = table.column(c).combine_chunks().dictionary_encode()
        codes += [d.indices.to_numpy().astype(np.int64), len(d.dictionary)]
    return table, codes[0], codes[2], codes[1], codes[3]


def _reduced(batches):
    batches = list(batches)
    if not batches:
        return
    table, w, f, n_workers, n_firms = _coded(batches)
    rows = np.arange(len(w))
    while True:
        degree = np.bincount(w[rows], minlength=n_workers)[w[rows]]
        two, hub = rows[degree == 2], rows[degree > 2]
        two = two[np.argsort(w[two], kind="stable")]
        hubs, at = np.unique(w[hub], return_inverse=True)
        a, b = np.concatenate([f[two[::2]], f[hub]]), np.concatenate([f[two[1::2]], n_firms + at])
        kept = certificate(a, b, n_firms + len(hubs))
        pairs = kept[: len(two) // 2]
        now = np.concatenate([two[::2][pairs], two[1::2][pairs], hub[kept[len(two) // 2 :]]])
        if len(now) == len(rows):
            break
        rows = now
    yield from table.take(np.sort(rows)).to_batches(max_chunksize=200_000)


def _searched(batches):
    from .akm import cut_workers

    batches = list(batches)
    if batches:
        table, w, f, n_workers, n_firms = _coded(batches)
        bad = np.zeros(n_workers, bool)
        bad[cut_workers(w, f, n_workers, n_firms)] = True
        _, one = np.unique(w, return_index=True)
        yield from table.select(["worker"]).take(one[bad]).to_batches(max_chunksize=200_000)


def splitting_workers(movers: DataFrame, most_edges: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """(worker): the workers without whom some firms that hang together now would not. movers: distinct (worker, firm).

    links: a forest() of them, where movers have the firms' nodes and a worker's rows lie in one task and next to each other.
    """
    most = most_edges or MOST_TASK_EDGES
    if links is None:
        nodes = keep_cut(movers.select("firm").distinct().withColumn("node", F.xxhash64(F.lit(1), "firm")))
        if nodes.groupBy("node").count().where("count > 1").head(1):
            raise RuntimeError("two firms share a hash")
        parts = int(movers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        movers = keep_cut(movers.select("worker", F.xxhash64(F.lit(1), "firm").alias("node")).repartition(parts, "worker").sortWithinPartitions("worker"))
        links = forest(movers)
    some = keep_cut(links.select("worker").distinct())
    number = some.count()
    rest = roots(forest(movers.join(counted(some, number), "worker", "left_anti").sortWithinPartitions("worker")))
    own = movers.join(counted(some, number), "worker", "left_semi").select("worker", "node")
    joined = own.join(counted(rest, rest.count()), "node", "left").select("worker", F.coalesce("root", "node").alias("firm")).distinct()
    joined = keep_cut(joined)
    return _searched_edges(keep_cut(joined.join(joined.groupBy("worker").count().where("count > 1").select("worker"), "worker", "left_semi")), most)


def _searched_edges(movers: DataFrame, most: int) -> DataFrame:
    """(worker): those that split, by certificates. movers: distinct (worker, firm), of workers with two firms at least."""
    schema = ", ".join(f"{c} {movers.schema[c].dataType.simpleString()}" for c in ("worker", "firm"))
    sized = movers.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("firm").alias("a"), F.max("firm").alias("b"))
    sides = sized.where("n = 2").groupBy("a", "b").agg(F.min("worker").alias("w1"), F.max("worker").alias("w2"))
    some = sides.select("a", "b", F.explode(F.array_distinct(F.array("w1", "w2"))).alias("worker")).select("worker", F.explode(F.array("a", "b")).alias("firm"))
    hubs = movers.join(sized.where("n > 2").select("worker"), "worker").select("worker", "firm")
    edges = keep_cut(some.unionByName(hubs))
    n, turn = edges.count(), 0
    while n > most:
        # By worker, so that a task has all edges of each of its workers; in every turn they meet others.
        parts = math.ceil(n / min(most, TASK_EDGES)) + 1
        dealt = edges.repartition(parts, F.xxhash64(F.lit(turn), "worker"))
        edges, before = keep_cut(dealt.mapInArrow(_reduced, schema)), n
        n, turn = edges.count(), turn + 1
        if n > 0.98 * before and turn > 4:
            raise ValueError(f"{n} edges of movers and firms are more than one task takes ({most}), and none is spare")
    return keep_cut(edges.repartition(1).mapInArrow(_searched, schema.split(", ")[0]))
