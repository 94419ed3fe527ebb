"""Near-duplicate groups of documents by an LSH forest of MinHash signatures.

Signatures. A document's set is its distinct word shingles (hashed to 64 bits); POOL permutations give their minima,
of which 16 bits are kept. Documents with equal sets are one class from then on.

Forest. Each of TREES orders reads DEPTH of the minima in an order of its own, and classes are sorted by that reading.
Classes that agree on a prefix of at least `least_depth` form a region; a region of more than REGION classes is split
at a longer prefix, as deep as it must be. Candidates are neighbours in the sorted order, which have the longest
common prefixes, and then any two classes of a region that are still in different groups and whose whole signatures
agree often enough. In a region that stays large at full depth, only classes outside its largest group are compared with
the rest, in blocks, so no task holds it whole and no row is copied for each of its partners.

Decision. Candidates are confirmed on the full shingle sets by exact integer arithmetic, and confirmed links make
connected components. Neighbour links are confirmed first: what they have joined needs no further comparison.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_bytes, bounded, components, in_arrow, keyed, mix64, pieces, settle, span_hashes, words_of

POOL, TREES, DEPTH, REGION, BLOCK = 48, 24, 8, 64, 256
_MULTIPLY, _ADD = keyed(21, POOL) | np.uint64(1), keyed(22, POOL)
ORDERS = np.argsort(keyed(23, TREES * POOL).reshape(TREES, POOL), 1)[:, :DEPTH]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts that lie end to end, sorted in each text, and where each text's begin."""
    n = len(offsets) - 1
    starts, ends, owner = words_of(data, offsets)
    word = span_hashes(LOWER[data], starts, ends)
    number = np.bincount(owner, minlength=n)
    first = np.cumsum(number) - number
    most = np.maximum(number - size + 1, np.minimum(number, 1))  # a short text is one shingle
    text = np.repeat(np.arange(n), most)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most)
    value = np.zeros(len(text), np.uint64)
    keys = keyed(24, size) | np.uint64(1)
    for k in range(size):
        inside = at + k < first[text] + number[text]
        value[inside] += word[at[inside] + k] * keys[k]
    value = mix64(value ^ np.minimum(number[text], size).astype(np.uint64))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(n + 1), "left")


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """POOL 16-bit minima for each text that has shingles."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(some), POOL), np.uint16)
    begin = at[some]
    for k in range(POOL if len(some) else 0):
        h = value * _MULTIPLY[k] + _ADD[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = mix64(np.minimum.reduceat(h, begin)) & np.uint64(0xFFFF)
    return out


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, print, sig): a set's size, a 128-bit print of it and the signature, for every document."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch):
                value, at = shingles(*arrow_bytes(part.column("text")), shingle)
                number = np.diff(at)
                a, b = (np.concatenate([[0], np.cumsum(mix64(value ^ k), dtype=np.uint64)])[at] for k in keyed(25, 2))
                prints = np.stack([np.diff(a), np.diff(b)], 1)
                sigs: list[bytes | None] = [None] * len(number)
                for i, s in zip(np.flatnonzero(number), signatures(value, at), strict=True):
                    sigs[i] = s.tobytes()
                yield pa.record_batch([part.column("id"), pa.array(number), pa.array([p.tobytes() for p in prints]), pa.array(sigs, pa.binary())], ["id", "n", "print", "sig"])

    return docs.transform(in_arrow, batches, "id long, n long, print binary, sig binary")


def _readings(classes: DataFrame) -> DataFrame:
    """(tree, head, key, id): each class once in each order; head: what regions have in common at least."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, POOL)
                key = sig[:, ORDERS].transpose(1, 0, 2).astype(">u2").reshape(-1, DEPTH)
                tree = np.repeat(np.arange(TREES, dtype=np.int32), len(sig))
                ids = pa.array(np.tile(np.asarray(part.column("id")), TREES))
                width = 2 * DEPTH
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                yield pa.record_batch([pa.array(tree), keys, ids], ["tree", "key", "id"])

    return classes.select("id", "sig").transform(in_arrow, batches, "tree int, key binary, id long")


def _common(key: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each reading with the one before it; key: readings, DEPTH wide."""
    return np.concatenate([[0], np.cumprod(key[1:] == key[:-1], 1).sum(1)])


def _regions(keys: np.ndarray, tree: np.ndarray, least: int, before: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading of a sorted run the number of its region, -1 for those alone, and the region's depth.

    before: by depth, how many readings with the first one's prefix went ahead of the run. low: the least depth of each reading's region; over
    DEPTH where the whole key is dealt out to several tasks, so that none is known to be alone.
    """
    shared = _common(keys)
    shared[1:][tree[1:] != tree[:-1]] = 0
    number, depths = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    alone = np.zeros(len(keys), bool)
    for depth in range(least, DEPTH + 1):
        fresh = np.cumsum(shared < depth)
        size = np.bincount(fresh)
        size[1:2] += before[depth]
        size = size[fresh]
        take = (number == 0) & (depth >= np.minimum(low, DEPTH)) & ((size <= REGION) | (depth == DEPTH))
        number[take] = fresh[take] * (DEPTH + 1) + depth + 1
        depths[take] = depth
        alone[take] = (size[take] == 1) & (low[take] <= DEPTH)
    _, number = np.unique(number, return_inverse=True)
    return np.where(alone, -1, number), depths


def _key_names(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The names of regions of whole keys: the same in every task."""
    out = mix64(tree.astype(np.uint64) + np.uint64(1))
    for half in np.ascontiguousarray(key.astype(np.uint16)).view(np.uint64).T:
        out = mix64(out ^ half)
    return out.view(np.int64)


def _prefixed(key: np.ndarray, one: np.ndarray) -> np.ndarray:
    """By depth, how many of the keys share the prefix of `one`."""
    return np.concatenate([[len(key)], np.cumprod(key == one, 1).sum(0)])


def _neighbours(least: int):
    def batches(it):
        """Sorted readings in; out: neighbours (other is the one before), and the name of the region of each that has one."""
        import pyarrow as pa

        held = None
        most = 400_000
        nothing = np.zeros(DEPTH + 1, np.int64)
        # Of the part of this head that is out: what it shares with the readings held, and its last key and id.
        before, last = nothing, None

        def emit(rows, end):
            nonlocal before, last
            tree, key, ids, low = rows
            number, depth = _regions(key, tree, least, before, low)
            shared = _common(key)
            shared[1:][tree[1:] != tree[:-1]] = 0
            other = np.concatenate([ids[:1], ids[:-1]])
            if last is not None:
                shared[0], other[0] = _common(np.stack([last[0], key[0]]))[1], last[1]
            near = shared >= least
            some = np.flatnonzero((number >= 0) | near)
            some = some[some < end]
            first = np.full(number.max(initial=0) + 1, len(number))
            np.minimum.at(first, number[number >= 0], np.flatnonzero(number >= 0))
            # A region has its first id's name; one of a whole key, which may be parted, a name made of the key.
            names = np.where(depth == DEPTH, _key_names(tree, key), ids[np.minimum(first, len(ids) - 1)][np.maximum(number, 0)])
            for i in range(0, len(some), 50_000):
                s = some[i : i + 50_000]
                yield pa.record_batch([pa.array(tree[s]), pa.array(ids[s]), pa.array(other[s], mask=~near[s]), pa.array(names[s], mask=number[s] < 0)], ["tree", "id", "other", "region"])

            if end < len(ids):
                before = _prefixed(key[:end], key[end]) + np.where(_prefixed(key[:1], key[end]) > 0, before, 0)
                last = key[end - 1], ids[end - 1]
            else:
                before, last = nothing, None

        for batch in it:
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(-1, DEPTH)
            low = np.asarray(batch.column("low")) if "low" in batch.schema.names else np.full(len(key), least)
            rows = (np.asarray(batch.column("tree")), key, np.asarray(batch.column("id")), low)
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            # Whole heads go out. Of a run of one head longer than `most`, all goes out but its last group of up to
            # REGION readings: the size of that one isn't known yet, and larger ones are split in any case.
            tree, key, ids, _ = held
            cut = np.flatnonzero((key[1:, :least] != key[:-1, :least]).any(1) | (tree[1:] != tree[:-1]))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield from emit(tuple(x[:end] for x in held), end)
                held = tuple(x[end:] for x in held)
            tree, key, ids, _ = held
            if len(ids) > most:
                own = _prefixed(key, key[-1])
                size = own + np.where(_prefixed(key[:1], key[-1]) > 0, before, 0)
                end = len(ids) - max((int(n) for n, m in zip(own[least:], size[least:], strict=True) if m <= REGION), default=1)
                yield from emit(held, end)
                held = tuple(x[end:] for x in held)
        if held is not None and len(held[0]):
            yield from emit(held, len(held[0]))

    return batches


#: One class in so many tells which prefixes are hot, and of those so many readings make one.
SHARE, HOT = 64, 200


def _sorted(classes: DataFrame, least: int, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """The readings, dealt out by order and head, and sorted; with column low, the least depth of a region, where prefixes are hot.

    A prefix is hot if its readings are a good part of a task's. It has more than REGION then, so its regions lie deeper, and its
    readings are dealt out by a longer prefix, down to the first that isn't hot. Those of a hot whole key, which
    are one region, are dealt out by id as well. So no task gets all of a group of near copies, whatever its size.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    readings = _readings(classes)
    prefix = lambda d: F.expr(f"substring(key, 1, {2 * d})")
    head = prefix(least)
    task = max(classes.count() * TREES // parts, 1)
    some = _readings(classes.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
    counts = some.select("tree", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), prefix(d).alias("prefix")) for d in range(least, DEPTH + 1)])).alias("x"))
    # At most as many of a depth as tasks, and a few times that.
    found = settle(counts.groupBy("tree", "x.d", "x.prefix").count().where(F.col("count") >= max(hot, task // share // 4)))
    if not found.head(1):
        return readings.repartition(parts, "tree", head).sortWithinPartitions("tree", "key", "id")
    low, deal, salts = F.lit(least), head, F.lit(1)
    for d in range(least, DEPTH + 1):
        own = found.where(F.col("d") == d).select(F.col("tree").alias("t"), F.col("prefix").alias(f"hot{d}"), F.greatest(F.lit(2), F.ceil(F.col("count") * share / task)).cast("int").alias(f"n{d}"))
        readings = readings.join(F.broadcast(own), (F.col("tree") == F.col("t")) & (prefix(d) == F.col(f"hot{d}")), "left").drop("t")
        is_hot = F.col(f"hot{d}").isNotNull()
        low, deal, salts = F.when(is_hot, d + 1).otherwise(low), F.when(is_hot, prefix(min(d + 1, DEPTH))).otherwise(deal), F.when(is_hot, F.col(f"n{d}") if d == DEPTH else F.lit(1)).otherwise(salts)
    readings = readings.select("tree", "key", "id", low.cast("int").alias("low"), deal.alias("deal"), F.pmod(F.xxhash64("id"), salts).alias("salt"))
    return readings.repartition(parts, "tree", "deal", "salt").select("tree", "key", "id", "low").sortWithinPartitions("tree", "key", "id")


def _agreeing(side: np.ndarray, comp: np.ndarray, ids: np.ndarray, sig: np.ndarray, least_equal: int):
    """Rows of a block pair whose groups differ and whose signatures agree often enough, as index arrays, in parts."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    for i in range(0, len(left), 64):
        rows = left[i : i + 64]
        good = ((sig[rows][:, None] == sig[right][None]).sum(2) >= least_equal) & (comp[rows][:, None] != comp[right][None])
        if same:
            good &= ids[rows][:, None] < ids[right][None]
        a, b = np.nonzero(good)
        yield rows[a], right[b]


def _runs(it, columns: list[str]):
    """The rows of each block pair, from batches sorted by it: its name, and the columns as arrays."""
    held = None
    for batch in it:
        rows = []
        for c in ["pair", *columns]:
            if c == "sig":
                rows.append(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, POOL))
            elif c == "items":
                out = np.empty(batch.num_rows, object)
                out[:] = batch.column(c).to_pylist()
                rows.append(out)
            else:
                rows.append(np.asarray(batch.column(c)))
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        edges = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield held[0][lo], *(x[lo:hi] for x in held[1:])
        held = [x[edges[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield held[0][0], *held[1:]


def _crossed(least_equal: int):
    """Out: agreeing pairs, to be confirmed one by one; where they are many, only the block pair's name."""

    def batches(it):
        import pyarrow as pa

        for name, side, comp, ids, sig in _runs(it, ["side", "component", "id", "sig"]):
            found, n = [], 0
            for a, b in _agreeing(side, comp, ids, sig, least_equal):
                found.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])))
                n += len(a)
                if n > 2 * len(ids):
                    break
            if n > 2 * len(ids):
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([name])], ["a", "b", "dense"])
            elif n:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(n, pa.int64())], ["a", "b", "dense"])

    return batches


def _matched(least_equal: int, times: int, by: int):
    """Rows of block pairs with their sets in; out: links that join the groups that any links of the block pair join."""

    def batches(it):
        import pyarrow as pa

        for _, side, comp, ids, sig, items in _runs(it, ["side", "component", "id", "sig", "items"]):
            sets = [np.frombuffer(x, np.uint64) for x in items]
            sizes = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            owner, value = np.repeat(np.arange(len(sets)), sizes)[order], every[order]
            root = {int(c): int(c) for c in comp}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            out = []
            for a, b in _agreeing(side, comp, ids, sig, least_equal):
                for lo, hi in zip(*_edges(a), strict=True):
                    i, js = a[lo], b[lo:hi]
                    # what set i shares with all others, from the places of its items among the items of all
                    first, last = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
                    n = last - first
                    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    shared = np.bincount(owner[at], minlength=len(sets))[js]
                    for j in js[times * shared >= by * (sizes[i] + sizes[js] - shared)].tolist():
                        x, y = find(int(comp[i])), find(int(comp[j]))
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            out.append((int(ids[i]), int(ids[j])))
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], ["u", "v"])

    return batches


def _edges(a: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cut = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else [0]
    return cut[:-1], cut[1:]


def _linked(x: np.ndarray, y: np.ndarray, times: int, by: int) -> bool:
    """times * |intersection| >= by * |union| of two sorted sets."""
    if times * min(len(x), len(y)) < by * max(len(x), len(y)) or not len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return times * shared >= by * (len(x) + len(y) - shared)


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the sorted shingle hashes of the documents in ids."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch):
                value, at = shingles(*arrow_bytes(part.column("text")), shingle)
                yield pa.record_batch([part.column("id"), pa.array([value[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "items"])

    return docs.join(bounded(ids), "id", "left_semi").transform(in_arrow, batches, "id long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, times: int, by: int) -> DataFrame:
    """The pairs (u, v) with times * intersection >= by * union, on full sets."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            keep = []
            a, b = batch.column("ia"), batch.column("ib")
            for i in range(batch.num_rows):
                if _linked(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b)), times, by):
                    keep.append(i)
            yield pa.record_batch([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["u", "v"])

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    return both.select("a", "b", "ia", "ib").transform(in_arrow, batches, "u long, v long")


def _dealt(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """(pair, side, component, id): rows to compare, by block pairs, of the regions in which several groups are left.

    A region of REGION classes at most is one block. In a larger one most classes are of one group, as a rule, and that group
    needs no comparison within: the others are compared with it and with each other. The same others meet the
    same group in region after region and tree after tree, so larger regions are put together by their largest group.
    """
    told = regions.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    numbers = told.groupBy("tree", "region", "component").agg(F.count("*").alias("n"))
    mixed = numbers.groupBy("tree", "region").agg(F.sum("n").alias("size"), F.count("*").alias("groups"), F.max(F.struct("n", (-F.col("component")).alias("component"))).alias("main"))
    mixed = mixed.where("groups > 1 AND size > 2").select("tree", "region", "size", (-F.col("main.component")).alias("main"))
    told = settle(told.join(mixed, ["tree", "region"]))
    small = told.where(F.col("size") <= REGION).select(F.xxhash64("tree", "region").alias("pair"), F.lit(0).alias("side"), "component", "id")
    large = told.where(F.col("size") > REGION).select("main", "component", "id").distinct().withColumn("inside", F.col("component") == F.col("main"))
    sizes = large.groupBy("main").agg(F.ceil(F.count_if(~F.col("inside")) / BLOCK).cast("int").alias("others"), F.ceil(F.count_if("inside") / BLOCK).cast("int").alias("mains"))
    # Blocks of the others come first; a block of the main group meets only those.
    large = large.join(sizes, "main").withColumn("own", F.when(F.col("inside"), F.col("others") + F.pmod(F.xxhash64("id"), "mains")).otherwise(F.pmod(F.xxhash64("id"), "others")).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    return small.unionByName(large.select(F.xxhash64("main", low, high).alias("pair"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"), "component", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, times: int = 100, by: int = 80, least_depth: int = 3) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document, with 64-bit integer ids.

    Documents are linked if times * |intersection| >= by * |union| of their shingle sets (words between ASCII white
    space, A-Z lower-cased; a text with fewer words than a shingle is one shingle). component_id is the smallest id
    reachable over links; kept: it is the document's own. A text that is null or has no word has an empty set and is
    linked with nothing. Rows that share an id count as copies: each gets a row, and one text's set speaks for the
    id's links. A null id is linked with nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = settle(_described(rows, shingle))
    some = described.where("n > 0 AND id IS NOT NULL")
    # Equal sets are one class, named by its smallest id; copies are combined before the shuffle.
    classes = settle(some.groupBy("print").agg(F.min(F.struct("id", "sig")).alias("x")).select("print", "x.id", "x.sig"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = settle(_sorted(classes, least_depth).transform(in_arrow, _neighbours(least_depth), "tree int, id long, other long, region long"))
    first = settle(found.where("other IS NOT NULL").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    members = settle(found.where("region IS NOT NULL").select("id").unionByName(first.select(F.col("a").alias("id"))).unionByName(first.select(F.col("b").alias("id"))).distinct())
    sets = settle(_sets(rows, members, shingle))
    links = settle(_confirmed(first, sets, times, by))
    groups = components(links)
    crossed = settle(_dealt(found.where("region IS NOT NULL").select("tree", "region", "id"), groups))
    # Agreements of POOL that a linked pair falls short of about once in 5000.
    share = by / times
    least_equal = int(POOL * share - 3.5 * (POOL * share * (1 - share)) ** 0.5)
    signed = classes.select("id", "sig")
    found = settle(crossed.join(signed, "id").repartition(parts, "pair").sortWithinPartitions("pair").transform(in_arrow, _crossed(least_equal), "a long, b long, dense long"))
    few = found.where("a IS NOT NULL").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    # Where agreeing pairs outnumber the rows, the rows go to the pairs' task with their sets instead.
    dense = crossed.join(found.where("dense IS NOT NULL").select(F.col("dense").alias("pair")).distinct(), "pair").join(signed, "id").join(sets, "id")
    dense = dense.select("pair", "side", "component", "id", "sig", "items").repartition(parts, "pair").sortWithinPartitions("pair")
    links = settle(links.unionByName(_confirmed(settle(few), sets, times, by)).unionByName(dense.transform(in_arrow, _matched(least_equal, times, by), "u long, v long")))
    groups = components(links)
    named = classes.join(groups, classes.id == groups.node, "left").select("print", F.coalesce("component", "id").alias("component_id"))
    known = described.join(named, "print", "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return known.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of which no other is a near copy, and one row of each group of near copies: that of the smallest id.

    Rows that are alike in id and text are copies, whatever their text; of those that differ in other columns, the one
    whose columns come first as JSON stays. Rows without id are larger than others, and take part by their texts. A text without words is like no other.
    """
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    rows = docs.select(key.alias("__key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = near_duplicates(rows, "__key", "text", **how).groupBy("__key").agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    named = settle(groups.join(rows.groupBy("__key").agg(F.min("id").alias("id")), "__key"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("__key").alias("stays"), "n")).alias("x"))
    kept = settle(least.select(F.col("x.stays").alias("__key"), "x.n"))
    gone = settle(named.select("__key").join(kept, "__key", "left_anti"))
    stay = docs.withColumn("__key", key).join(bounded(gone), "__key", "left_anti")
    many = settle(kept.where("n > 1").select("__key"))
    if not many.head(1):
        return stay.select(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = stay.join(bounded(many), "__key", "left_semi").groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return stay.join(bounded(many), "__key", "left_anti").select(docs.columns).unionByName(first)
