"""Leave-out sets found in the cluster, against the depth-first search of the whole graph."""

import numpy as np

from quadrat.operators import connectivity
from quadrat.operators.akm import cut_workers, leave_out_set
from quadrat.operators.connectivity import certificate, forest, spanning, splitting_workers
from quadrat.operators.graph import joined_nodes


def edges(g, n_workers, n_firms, n):
    return np.array(sorted({(int(a), int(b)) for a, b in zip(g.integers(0, n_workers, n), g.integers(0, n_firms, n), strict=True)}))


def test_certificate():
    """Without any one node, the same nodes hang together, also with other edges added."""
    g = np.random.default_rng(2)
    for _ in range(60):
        n = int(g.integers(4, 14))
        e = np.array([(a, b) for a in range(n) for b in range(a) if g.random() < g.choice([0.2, 0.5, 0.9])], dtype=np.int64).reshape(-1, 2)
        kept = e[certificate(e[:, 0], e[:, 1], n)]
        assert len(kept) <= max(2 * (n - 1), 0)
        more = g.integers(0, n, (3, 2))
        for extra in (more[:0], more):
            for gone in range(n):
                parts = []
                for x in (e, kept):
                    x = np.concatenate([x, extra, np.repeat(np.arange(n)[:, None], 2, 1)])
                    x = x[(x != gone).all(1)]
                    parts.append(joined_nodes(x[:, 0], x[:, 1])[1].tolist())
                assert parts[0] == parts[1]


def test_splitting_workers(spark):
    g = np.random.default_rng(4)
    for n_workers, n_firms, n, most in ((30, 8, 60, 20), (40, 25, 75, 30), (12, 5, 40, 10), (60, 6, 140, 1000)):
        e = edges(g, n_workers, n_firms, n)
        e = e[np.bincount(e[:, 0], minlength=n_workers)[e[:, 0]] > 1]
        want = sorted(cut_workers(e[:, 0], e[:, 1], n_workers, n_firms).tolist())
        df = spark.createDataFrame([(f"w{a:03}", int(b)) for a, b in e], "worker string, firm int")
        try:
            got = sorted(int(r.worker[1:]) for r in splitting_workers(df, most).collect())
        except ValueError:
            assert most < 4 * n_firms + 2 * n_workers  # no spare edge
            continue
        assert got == want


def test_same_set(spark):
    """The cluster's set is the driver's: splits again and again, stayers, a worker with one row, strings as ids."""
    g = np.random.default_rng(9)
    sizes = set()
    for _ in range(2):
        e = np.concatenate([edges(g, 14, 9, 26), edges(g, 3, 9, 3)])
        rows = [(f"w{a}", f"f{b}", float(k)) for k, (a, b) in enumerate(e)] + [("s", "f1", 0.0), ("s", "f1", 1.0)]
        df = spark.createDataFrame(rows, "w string, f string, k double")
        a, b = (sorted(map(tuple, leave_out_set(df, "w", "f", spread=s).collect())) for s in (False, True))
        assert a == b
        sizes.add(len(a))
    assert len(sizes) > 1


def test_many_workers_of_few_firms(spark):
    """Workers at three firms and more, of which no edge is spare while workers are nodes: what is left grows with the firms."""
    g = np.random.default_rng(5)
    rows = [(w, int(f)) for w in range(400) for f in g.choice(7, g.integers(3, 6), replace=False)]
    rows += [(1000, 1), (1000, 90), (1001, 2), (1001, 91), (1002, 2), (1002, 91), (1003, 3), (1003, 92), (1003, 93)]
    got = splitting_workers(spark.createDataFrame(rows, "worker long, firm long"), 120)
    assert sorted(r.worker for r in got.collect()) == [1000, 1003]


def test_forest_joins_what_workers_join(spark, monkeypatch):
    """Forests made anew after a few links, over several tasks, hang together as all rows do, with as few links as that takes."""
    monkeypatch.setattr(connectivity, "LINKS", 7)
    g = np.random.default_rng(6)
    for n_workers, n_firms, n in ((40, 60, 90), (9, 30, 60), (200, 12, 300)):
        e = edges(g, n_workers, n_firms, n)
        df = spark.createDataFrame([(f"w{a}", int(b)) for a, b in e], "worker string, node long").repartition(3, "worker").sortWithinPartitions("worker")
        links = forest(df).collect()
        _, want = joined_nodes(e[:, 0] + 1000, e[:, 1])
        nodes, at = np.unique(e[:, 1], return_inverse=True)
        assert len(links) == len(nodes) - len(np.unique(want))
        u, v = (np.searchsorted(nodes, [getattr(x, c) for x in links]) for c in "uv")
        assert spanning(u, v, len(nodes)).all()
        firms = {w: set(e[e[:, 0] == int(w[1:]), 1].tolist()) for w in {x.worker for x in links}}
        assert all({x.u, x.v} <= firms[x.worker] for x in links)


def test_only_workers_of_the_forest_are_searched(spark, monkeypatch):
    """Most workers can split nothing: a bound on edges that all movers would pass is kept, and matches are not dealt out again."""
    g = np.random.default_rng(8)
    rows = [(w, int(f)) for w in range(300) for f in g.choice(40, 4, replace=False)]
    rows += [(1000, 1), (1000, 90), (1001, 90), (1001, 91), (1002, 91), (1002, 90), (1003, 2), (1003, 3), (1003, 92)]
    seen = []
    monkeypatch.setattr(connectivity, "_searched_edges", lambda movers, most, own=connectivity._searched_edges: (seen.append(movers.count()), own(movers, most))[1])
    got = splitting_workers(spark.createDataFrame(rows, "worker long, firm long"))
    assert sorted(r.worker for r in got.collect()) == [1000, 1003] and seen[0] < 20
