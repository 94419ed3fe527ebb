"""Importance resampling towards a target, with features in partition-local word tries.

Features are all runs of one to `longest` consecutive words. A task lays the words of a slab of texts in a trie: a node is
a run and holds its count and the CRC-32 state of its bytes, which is its parent's state moved on by a space and a word, so
the bytes of a run are never put together. Counts go to the task's bucket totals and the trie is dropped with its slab, so a task holds one slab's
nodes and one number for each bucket. Totals of all tasks are added up; a bucket's gain is 1000 times the log of its
smoothed share in the target over that in the documents. A second pass lays the same tries with a gain at each node, and a
document's weight is what it meets on its paths. Keyed Gumbel noise makes the highest scores a draw without replacement.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, arrow_bytes, in_arrow, pieces, settle, span_hashes, words_of

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _moved(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


@lru_cache(1)
def _steps() -> list[np.ndarray]:
    """For each k, what moving a CRC on by 2^k zero bytes makes of each value of its four bytes: CRCs are linear over bits."""
    image = 1 << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        image = (image >> 1) ^ np.where(image & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out = []
    for _ in range(32):
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        tables = np.stack([np.bitwise_xor.reduce(np.where(bits, image[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)])
        out.append(tables)
        image = _moved(tables, image)
    return out


def moved_on(state: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part that each CRC state has in the CRC of its bytes followed by so many more."""
    state = state.copy()
    for k in range(int(by.max(initial=0)).bit_length()):
        some = np.flatnonzero(by >> k & 1)
        state[some] = _moved(_steps()[k], state[some])
    return state


class WordTrie:
    """The runs of words of texts laid end to end. By length, from 1: how often each node occurs, its CRC, and the text and node of each occurrence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int):
        low = LOWER[data]
        starts, ends, owner = words_of(low, offsets, NOT_WORD)
        n = len(starts)
        self.n_words = np.bincount(owner, minlength=len(offsets) - 1)
        _, first, word = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        raw, space = low.tobytes(), crc32(b" ")
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        length = (ends - starts)[first] + 1
        state = np.fromiter(map(crc32, words), np.uint32, len(words))
        after_space = np.fromiter((crc32(w, space) for w in words), np.uint32, len(words))
        self.levels = [(np.bincount(word, minlength=len(words)), state, owner, word)] if n else []
        node, at = word, np.arange(n)  # the run that begins at each place of `at`
        for k in range(1, longest):
            good = at + k < n
            good[good] &= owner[at[good] + k] == owner[at[good]]
            at, parent = at[good], node[good]
            if not len(at):
                break
            key, first, node = np.unique(parent * len(words) + word[at + k], return_index=True, return_inverse=True)
            last = key % len(words)
            state = moved_on(self.levels[-1][1][key // len(words)], length[last]) ^ after_space[last]
            self.levels.append((np.bincount(node), state, owner[at], node))

    def add_to(self, totals: np.ndarray) -> None:
        """Add each node's count to that of its bucket."""
        for count, state, _, _ in self.levels:
            totals += np.bincount(state % len(totals), count, len(totals)).astype(np.int64)

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the number of its features and the sum of their gains."""
        number, total = np.zeros(len(self.n_words), np.int64), np.zeros(len(self.n_words), np.int64)
        for _, state, owner, node in self.levels:
            met = np.concatenate([[0], np.cumsum(gains[state % len(gains)][node])])
            edges = np.searchsorted(owner, np.arange(len(number) + 1))
            number += np.diff(edges)
            total += np.diff(met[edges])
        return number, total


def bucket_totals(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(bucket, n): the number of features in each bucket that has any."""

    def batches(it):
        import pyarrow as pa

        totals = np.zeros(buckets, np.int64)
        for batch in it:
            for part in pieces(batch, 4 << 20):
                WordTrie(*arrow_bytes(part.column("text")), longest).add_to(totals)
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"])

    each = docs.select(F.col(text_col).alias("text")).transform(in_arrow, batches, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in `target` over that in `docs`; both are bucket_totals(), so `buckets` rows reach the driver."""
    side = lambda df, name: df.select("bucket", F.col("n").alias(name))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(side(docs, "s")), "bucket", "left").join(F.broadcast(side(target, "t")), "bucket", "left").na.fill(0, ["s", "t"])
    rows = both.collect()
    s, t = (float(sum(r[c] for r in rows)) for c in ("s", "t"))
    own = docs.sparkSession.createDataFrame(rows, both.schema)
    gain = F.floor(1000 * F.log((F.col("t") + 1.0) * (s + buckets) / ((F.col("s") + 1.0) * (t + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in own.select("bucket", gain.alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def ranked(scored: DataFrame, number: int, by: list) -> DataFrame:
    """The rows of a settled table in the order `by`, with rank from 1 to `number` where `drawn` allows, else null.

    Rows are dealt out by ranges of the order. The ranges' sizes tell the rank that each begins at, and only ranges with
    drawn rows are numbered within.
    """
    placed = settle(scored.repartitionByRange(F.col("drawn").desc(), *by).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r.part, r.n) for r in placed.where("drawn").groupBy("part").agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    reached = [p for p, b in before.items() if b < number]
    null = F.lit(None).cast("long")
    if not reached:
        return placed.withColumn("rank", null).drop("part", "drawn")
    begins = F.create_map(*[F.lit(x) for p in reached for x in (p, before[p])])
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by)).cast("long") + begins[F.col("part")]
    in_reach = F.col("drawn") & (F.col("part") <= max(reached))
    first = placed.where(in_reach).withColumn("rank", inside).withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))
    return first.unionByName(placed.where(~in_reach).withColumn("rank", null)).drop("part", "drawn")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3, least_words: int = 20, share: tuple[int, int] = (5, 100), seed: int = 42) -> DataFrame:
    """id_col, n_features, weight, score and rank of each row; rank: 1, 2, ... of the share drawn, null for others.

    Texts are lower-cased in A-Z; words are runs of a-z, 0-9 and whatever is not ASCII. Drawn are floor(share of those
    with least_words) rows of the highest scores, ties to the smaller id (null ids last, then by features). Null and empty texts have no features, weight 0,
    a score, and no rank; a null id draws its noise as an empty one. Repeated rows count and are drawn each by itself; rows with
    one id share their noise. Other columns of docs are left out, so none clashes. Words are told apart by 64 bits of hashes.
    """
    gains = bucket_gains(bucket_totals(docs, text_col, buckets, longest), bucket_totals(target, target_col, buckets, longest), buckets)

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch, 4 << 20):
                trie = WordTrie(*arrow_bytes(part.column("text")), longest)
                yield pa.record_batch([part.column("id"), *map(pa.array, (trie.n_words, *trie.weights(gains)))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.transform(in_arrow, batches, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settle(scored.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("drawn")))
    number = scored.where("drawn").count() * share[0] // share[1]
    out = ranked(scored, number, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
