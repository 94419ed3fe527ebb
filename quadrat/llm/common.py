"""Shared pieces: reading tables, cutting lineage, connected components, hashing words of a batch of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.graph import joined_nodes
from quadrat.operators.sample import keep_cut

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_WS = np.zeros(256, bool)
ASCII_WS[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Materialise df in the folder of spark.checkpoint.dir and drop its lineage."""
    return keep_cut(df)


#: Rows of a few bytes, up to which a table that has been counted is broadcast.
MOST_BROADCAST = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """A settled table of ids, to be broadcast if its count allows; else joins shuffle it."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def sealed(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the columns `names` last, made once: a later filter on them stays above the steps that made them.

    Spark would otherwise write those steps out in the filter, each as often as it is used by the next.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    out = df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("__made"))
    return out.select(*rest, *[F.col("__made")[c].alias(c) for c in names])


def keyed_by_text(text) -> list:
    """Two 64-bit hashes of a text column, as __h1 and __h2: equal texts are one, whatever rows they are in."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(7), text).alias("__h2")]


#: Edges that one task joins at a time.
MOST_EDGES = 500_000


def components(edges: DataFrame, most_edges: int = MOST_EDGES, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), for each node that has an edge to another.

    Each round deals the edges out to tasks of about most_edges. A task joins its own and names a root for each node;
    where a node got several roots, edges between those are the next round's. Roots go by a keyed order that changes
    with the round, so that of any path a third of the nodes drops out in a round, however its ids lie. A node is in a
    task's result once, so no node has more rows than there are tasks, and edges that fit into one task are done in one.
    """
    edges = settle(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    steps: list[DataFrame] = []
    for turn in range(most_rounds):
        tasks = -(-edges.count() // most_edges)
        key = None if tasks <= 1 else np.uint64(keyed(31 + turn, 1)[0])

        def batches(it, key=key):
            import pyarrow as pa

            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in it:
                u.append(np.asarray(batch.column("u")))
                v.append(np.asarray(batch.column("v")))
            nodes, roots = joined_nodes(np.concatenate(u), np.concatenate(v), key and (lambda x: mix64(x.astype(np.uint64) ^ key)))
            yield pa.record_batch([pa.array(nodes), pa.array(roots)], ["node", "root"])

        found = edges.repartition(max(tasks, 1)).transform(in_arrow, batches, "node long, root long")
        if tasks <= 1:
            steps.append(found)
            break
        found = settle(found)
        # One of a node's roots stands for it; edges lead from it to the others.
        own = settle(found.groupBy("node").agg(F.min("root").alias("own")))
        steps.append(own.select("node", F.col("own").alias("root")))
        edges = settle(found.join(own, "node").where("root <> own").select(F.col("root").alias("u"), F.col("own").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    out = steps.pop()
    while steps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("final"))
        out = steps.pop().join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
        out = settle(out)
    if key is None and turn == 0:
        return settle(out.withColumnRenamed("root", "component"))
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return settle(out.join(least, "root").select("node", "component"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values for a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))


BYTE_KEYS = keyed(11, 256)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data, from one prefix sum of keyed bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * _powers(_BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, laid end to end, and len + 1 offsets; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = ASCII_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the number of the text each word is in.

    A word is a longest run of bytes outside `space`; texts lie end to end in data at offsets.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]  # a word doesn't run on from the text before
    stops = np.zeros(n + 1, bool)
    stops[1:n] = inside[:-1] & (~inside[1:] | begins[1:])
    stops[n] = inside[-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: What a worker process keeps between tasks, by the name of its maker.
KEPT: dict[str, tuple] = {}


def kept(name: str, key: tuple, make):
    """make(), or what it made last under this name and key. A function of in_arrow() that uses it has the name as attribute `keeps`."""
    if KEPT.get(name, (None,))[0] != key:
        KEPT[name] = key, make()
    return KEPT[name][1]


def released(batches):
    """The function of a mapInArrow; after a task, its worker process gives the memory it has freed back to the system.

    Workers live on between tasks and stages, so what the allocators of one keep would add to the needs of the next.
    """

    def run(it):
        import ctypes

        import pyarrow as pa

        # What workers keep of another operator goes before this one's work begins.
        for name in [k for k in KEPT if k != getattr(batches, "keeps", None)]:
            del KEPT[name]
        try:
            yield from batches(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)

    return run


#: Bytes of rows that Spark hands to a worker at a time, where the session has its own setting's default; texts are
#: large, and each batch is held by the executor, the pipe and the worker.
BATCH_BYTES, DEFAULT_BYTES = "4m", "67108864b"


def in_arrow(df: DataFrame, batches, schema: str) -> DataFrame:
    """df.mapInArrow() with released() and batches of bounded bytes."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, DEFAULT_BYTES) == DEFAULT_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(released(batches), schema)


def text_of(name: str):
    """How to take a text column out of a batch of rows packed in a struct __row."""
    return lambda batch: batch.column("__row").field(name)


def pieces(batch, most_bytes: int = 2 << 20, column: str = "text", text=None):
    """Slices of an Arrow batch whose texts have about most_bytes together; one long text is a slice of its own. text: see text_of()."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(text(batch) if text else batch.column(column)), 0)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
