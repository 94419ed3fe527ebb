"""Worker-firm systems in the cluster: conjugate gradients with many right sides at once.

Matches (worker, firm) are dealt out to blocks by worker, so that a worker's effect is eliminated inside its block. What
blocks share are nodes: the firms, and workers with so many matches that these are dealt out by match. Nodes lie in buckets. In a round a bucket sends
each block the values of the nodes that it needs, a block answers with its part of the product, and buckets add up
what they get. Up to MOST_VALUES the driver holds the nodes' values instead, and blocks are read where they lie. Values are matrices of a column for each right side, so a round serves all of them, and what
moves is one row for each pair of a bucket and a block. The sums of the gradients are of Chronopoulos and Gear's kind: one reduction a round, and
the driver gets a few numbers for each bucket and right side. No match, worker or firm goes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import Unsettled, keep_cut

#: Matches in a block, nodes in a bucket, matches from which a worker is a node, and matches that are held with all right sides at a time.
BLOCK_MATCHES, BUCKET_NODES, HOT_MATCHES, CHUNK = 200_000, 50_000, 100_000, 8_192
#: Rounds without gain after which the residual is made anew.
STALLED = 25
#: Rows up to which a counted table is broadcast, and firms up to which the firms' system is inverted whole.
MOST_BROADCAST, DENSE_FIRMS = 1_000_000, 1_000
#: Nodes times right sides up to which the driver holds the nodes' values, and nodes in one message of a task.
MOST_VALUES, NODES_SENT = 4_000_000, 50_000

BLOCK = "block int, wi array<int>, fi array<int>, hi array<int>, t array<double>, s array<double>, ss array<double>, extra array<double>, w array<bigint>, f array<bigint>, nodes array<bigint>, of array<int>"
BUCKET = "nb int, nodes array<bigint>, d array<double>, to array<int>, number array<int>, place array<int>"
STATE = BUCKET + ", x binary, r binary, p binary, s binary, v binary, told array<double>"
PART = "nb int, block int, data binary"


def _arrays(table, row: int = 0) -> dict:
    """The cells of a row, lists as NumPy arrays."""
    import pyarrow as pa

    out = {}
    for name in table.column_names:
        value = table.column(name)[row]
        out[name] = value.values.to_numpy(zero_copy_only=False) if pa.types.is_list(value.type) or pa.types.is_large_list(value.type) else value.as_py()
    return out


def _table(rows: list[dict], schema: str):
    """Rows as an Arrow table of a schema of plain columns and arrays of them."""
    import pyarrow as pa

    plain = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    kinds = {}
    for column in schema.split(", "):
        name, kind = column.split(" ")
        kinds[name] = pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]
    return pa.table({name: pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()})


def _block(n_buckets: int, extras: int):
    def run(table):
        c = {k: table.column(k).to_numpy() for k in table.column_names}
        order = np.lexsort((c["f"], c["w"], c["hot"]))
        c = {k: v[order] for k, v in c.items()}
        inner, hot = ~c["hot"], c["hot"]
        nodes = np.unique(np.concatenate([c["f"], c["hw"][hot]]))
        by = np.lexsort((nodes, nodes % n_buckets))
        place = np.empty(len(nodes), np.int64)
        place[by] = np.arange(len(nodes))
        at = lambda v: place[np.searchsorted(nodes, v)]
        wi, hi = np.full(len(order), -1), np.full(len(order), -1)
        wi[inner] = np.unique(c["w"][inner], return_inverse=True)[1]
        hi[hot] = at(c["hw"][hot])
        extra = np.concatenate([np.zeros(0), *(c[f"e{i}"] for i in range(extras))])
        return _table([{"block": int(c["block"][0]), "wi": wi, "fi": at(c["f"]), "hi": hi, "t": c["t"], "s": c["s"], "ss": c["ss"], "extra": extra, "w": c["w"], "f": c["f"], "nodes": nodes[by], "of": (nodes % n_buckets)[by]}], BLOCK)

    return run


def _bucket(table):
    c = {k: table.column(k).to_numpy() for k in table.column_names}
    order = np.lexsort((c["node"], c["block"]))
    nodes, place = np.unique(c["node"], return_inverse=True)
    to, number = np.unique(c["block"], return_counts=True)
    return _table([{"nb": int(c["nb"][0]), "nodes": nodes, "d": np.bincount(place, c["d"]), "to": to, "number": number, "place": place[order]}], BUCKET)


def _diagonals(batches):
    """(nb, node, block, d): what each block adds to the diagonal of its nodes."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            b = _arrays(batch, i)
            d, hot = np.bincount(b["fi"], b["t"], len(b["nodes"])), b["hi"] >= 0
            d += np.bincount(b["hi"][hot], b["t"][hot], len(d))
            yield pa.record_batch([pa.array(b["of"], pa.int32()), pa.array(b["nodes"]), pa.array(np.full(len(d), b["block"], np.int32)), pa.array(d)], ["nb", "node", "block", "d"])


class Block:
    """A block's matches, those of a worker next to each other; chunks are whole workers' or of hot ones."""

    def __init__(self, b: dict):
        self.__dict__.update(b)
        self.inner = int((b["wi"] >= 0).sum())
        self.dw = np.bincount(b["wi"][: self.inner], b["t"][: self.inner])

    def chunks(self):
        edges = np.append(np.flatnonzero(np.diff(self.wi[: self.inner], prepend=-1)), self.inner)
        low = 0
        while low < self.inner:
            high = int(edges[max(np.searchsorted(edges, low + CHUNK, "right") - 1, np.searchsorted(edges, low, "right"))])
            yield low, high
            low = high
        yield from ((k, min(k + CHUNK, len(self.wi))) for k in range(self.inner, len(self.wi), CHUNK))

    def by_worker(self, low: int, high: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums of x by the workers of an inner chunk, the workers' totals, and each match's number of its worker in it."""
        wi = self.wi[low:high]
        first = np.flatnonzero(np.diff(wi, prepend=-1))
        return np.add.reduceat(x, first), self.dw[wi[first]], wi - wi[0]

    def spread_of(self, low: int, high: int, firms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of an inner chunk by worker and firm, the workers' totals, and each match's number of its worker in it."""
        wi = self.wi[low:high]
        first = np.flatnonzero(np.diff(wi, prepend=-1))
        out = np.zeros((len(first), len(firms)))
        out[wi - wi[0], np.searchsorted(firms, self.nodes[self.fi[low:high]])] = self.t[low:high]
        return out, self.dw[wi[first]], wi - wi[0]

    def add(self, out: np.ndarray, place: np.ndarray, x: np.ndarray) -> None:
        """Add rows of x to the rows of out at place."""
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        out[place[order][first]] += np.add.reduceat(x[order], first)

    def right(self, rhs, width: int) -> np.ndarray:
        """The right sides of the nodes: rhs gives each match's part in its worker's equation and in its firm's."""
        out = np.zeros((len(self.nodes), width))
        for low, high in self.chunks():
            a, c = rhs(self, low, high)
            if low < self.inner:
                sums, dw, k = self.by_worker(low, high, a)
                c = c - self.t[low:high, None] * (sums / dw[:, None])[k]
            else:
                self.add(out, self.hi[low:high], a)
            self.add(out, self.fi[low:high], c)
        return out

    def times(self, z: np.ndarray) -> np.ndarray:
        """The system's product with z, but for the diagonal."""
        out = np.zeros_like(z)
        for low, high in self.chunks():
            t, at = self.t[low:high, None], z[self.fi[low:high]]
            if low < self.inner:
                sums, dw, k = self.by_worker(low, high, t * at)
                self.add(out, self.fi[low:high], -t * (sums / dw[:, None])[k])
            else:
                self.add(out, self.fi[low:high], t * z[self.hi[low:high]])
                self.add(out, self.hi[low:high], t * at)
        return out

    def effects(self, rhs, x: np.ndarray):
        """By chunk: where it is, the right sides' parts, and the effects of each match's worker and firm."""
        for low, high in self.chunks():
            a, c = rhs(self, low, high)
            zf = x[self.fi[low:high]]
            if low < self.inner:
                sums, dw, k = self.by_worker(low, high, a - self.t[low:high, None] * zf)
                zw = (sums / dw[:, None])[k]
            else:
                zw = x[self.hi[low:high]]
            yield low, high, a, c, zw, zf


def _sent(nb, block, x: np.ndarray) -> dict:
    return {"nb": int(nb), "block": int(block), "data": np.ascontiguousarray(x).tobytes()}


def _gathered(table, width: int) -> np.ndarray:
    """The matrices of the messages to a block, in order of their buckets."""
    order = np.argsort(table.column("nb").to_numpy())
    data = table.column("data")
    return np.concatenate([np.frombuffer(data[int(i)].as_py()).reshape(-1, width) for i in order])


def _answers(b: Block, out: np.ndarray):
    edges = np.append(np.flatnonzero(np.diff(b.of, prepend=-1)), len(b.of))
    return _table([_sent(b.of[i], b.block, out[i:j]) for i, j in zip(edges, edges[1:], strict=False)], PART)


def _together(left: DataFrame, right: DataFrame, key: str, made, schema: str) -> DataFrame:
    """made(row, messages) for each key: a row of left and the rows of right, which have data.

    By a union, whose estimated size is a sum. That of a cogroup is a product, and estimates outlive checkpoints: after some
    rounds their digits alone would take longer than the work.
    """
    columns = left.columns, right.columns

    def run(table):
        import pyarrow.compute as pc

        sent = pc.is_valid(table.column("data"))
        return made(table.filter(pc.invert(sent)).select(columns[0]), table.filter(sent).select(columns[1]))

    return left.unionByName(right, allowMissingColumns=True).groupBy(key).applyInArrow(run, schema)


class SpreadSystem:
    """Gradients over blocks and buckets. matches are read several times. Its own system is [Dw B; B' Df] (zw, zf) = (tw, tf) over matches (worker, firm, t, s, ss and extra columns), for right sides in its range."""

    block_kind = Block

    def __init__(self, matches: DataFrame, extra: list[str] = (), block_matches: int | None = None, bucket_nodes: int | None = None, hot_matches: int | None = None):
        block_matches, bucket_nodes, hot_matches = block_matches or BLOCK_MATCHES, bucket_nodes or BUCKET_NODES, hot_matches or HOT_MATCHES
        keys = {"w": F.xxhash64(F.lit(1), "worker"), "f": F.xxhash64(F.lit(2), "firm"), "hw": F.xxhash64(F.lit(3), "worker")}
        self.matches = m = matches.withColumns(keys)
        told = {}
        for key, of in (("w", "worker"), ("f", "firm")):
            by = m.groupBy(key).agg(F.min(of).alias("a"), F.max(of).alias("b"), F.count(F.lit(1)).alias("n"))
            told[key] = by.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.expr("int(a <> b)")), F.sum((F.col("n") > hot_matches).cast("int"))).first()
            if told[key][2]:
                raise RuntimeError(f"two ids of {of} share a hash")
        (self.n_workers, self.n_matches, _, number), self.n_firms = told["w"], told["f"][0]
        self.n_matches, number = self.n_matches or 0, number or 0
        self.n_hot, self.n_nodes = number, self.n_firms + number
        hot = keep_cut(m.groupBy("w").count().where(F.col("count") > hot_matches).select("w", F.lit(True).alias("hot"))) if number else m.sparkSession.createDataFrame([], "w long, hot boolean")
        n_blocks, n_buckets = max(1, math.ceil(self.n_matches / block_matches)), max(1, math.ceil(self.n_nodes / bucket_nodes))
        placed = m.join(F.broadcast(hot) if number <= MOST_BROADCAST else hot, "w", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        placed = placed.withColumn("hw", F.when(F.col("hot"), F.col("hw")).otherwise(F.lit(0)))
        placed = placed.withColumn("block", F.expr(f"cast(pmod(if(hot, xxhash64(w, f), w), {n_blocks}) AS int)"))
        double = [F.col(c).cast("double").alias(c) for c in ("t", "s", "ss")]
        rows = placed.select("block", "w", "f", "hw", "hot", *double, *[F.col(c).cast("double").alias(f"e{i}") for i, c in enumerate(extra)])
        self.n_extra = len(extra)
        self.blocks = keep_cut(rows.groupBy("block").applyInArrow(_block(n_buckets, len(extra)), BLOCK))
        self.rounds, self._buckets, self._nodes = 0, None, None

    @property
    def buckets(self) -> DataFrame:
        if self._buckets is None:
            parts = self.blocks.mapInArrow(_diagonals, "nb int, node long, block int, d double")
            self._buckets = keep_cut(parts.groupBy("nb").applyInArrow(_bucket, BUCKET))
        return self._buckets

    @buckets.setter
    def buckets(self, made: DataFrame) -> None:
        self._buckets = made

    def few(self, width: int) -> bool:
        """Whether the driver holds the nodes' values, so that no block moves in a round."""
        return self.n_nodes * width <= MOST_VALUES

    def nodes(self):
        """The nodes in order, and the same sent to all tasks."""
        if self._nodes is None:
            spark = self.blocks.sparkSession
            found = self.matches.select(F.col("f").alias("node")).distinct().toArrow()["node"].to_numpy()
            if self.n_hot:
                hot = self.blocks.select(F.explode("nodes").alias("node")).distinct().toArrow()["node"].to_numpy()
                found = np.union1d(found, hot)
            self._nodes = np.sort(found), spark.sparkContext.broadcast(np.sort(found))
        return self._nodes

    def _summed(self, part, width: int) -> np.ndarray:
        """The sum over blocks of part(block, at), a matrix of a row for each of the block's nodes; at tells where those are in nodes()."""
        (nodes, every), kind, spark = self.nodes(), self.block_kind, self.blocks.sparkSession
        n = len(nodes)

        def run(batches):
            out = np.zeros((n, width))
            for batch in batches:
                for i in range(batch.num_rows):
                    b = kind(_arrays(batch, i))
                    at = np.searchsorted(every.value, b.nodes)
                    out[at] += part(b, at)
            yield from _table([{"low": k, "data": out[k : k + NODES_SENT].tobytes()} for k in range(0, n, NODES_SENT)], "low int, data binary").to_batches(1)

        def total(table):
            out = sum(np.frombuffer(x.as_py()) for x in table.column("data"))
            return _table([{"low": table.column("low")[0].as_py(), "data": out.tobytes()}], "low int, data binary")

        out, parts = np.zeros((n, width)), self.blocks.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "low int, data binary")
        for row in parts.groupBy("low").applyInArrow(total, "low int, data binary").collect():
            some = np.frombuffer(row["data"]).reshape(-1, width)
            out[row["low"] : row["low"] + len(some)] = some
        return out

    def solve_few(self, rhs, width: int, tol: float = 1e-10, most_rounds: int = 5000) -> np.ndarray:
        """solve() with the nodes' values held by the driver: a round sends a direction to all tasks, which read blocks where these
        lie, and what is shuffled are the sums of each task."""
        context = self.blocks.sparkSession.sparkContext

        def begun(b, at):
            d, hot = np.bincount(b.fi, b.t, len(b.nodes)), b.hi >= 0
            d += np.bincount(b.hi[hot], b.t[hot], len(d))
            return np.concatenate([b.right(rhs, width), d[:, None]], axis=1)

        def times(z):
            sent = context.broadcast(z)
            out = d * z + self._summed(lambda b, at: b.times(sent.value[at]), width)
            sent.destroy()
            return out

        right = self._summed(begun, width + 1)
        right, d = right[:, :width], right[:, width:]
        norm = lambda v: np.sqrt((v * v).sum(0))
        size = np.where(norm(right) > 0, norm(right), 1.0)
        x, rest, rounds, before = np.zeros_like(right), right.copy(), 0, np.inf
        while True:
            z = rest / d
            p, rz = z.copy(), (rest * z).sum(0)
            best, since = np.inf, 0
            while (turns := (norm(rest) > tol * size) & (rz > 0)).any() and since <= STALLED:
                if rounds >= most_rounds:
                    raise Unsettled("the worker-firm system did not settle")
                v, rounds = times(p), rounds + 1
                pv = (p * v).sum(0)
                step = np.where(turns & (pv > 0), rz / np.where(pv > 0, pv, 1), 0.0)
                x, rest = x + step * p, rest - step * v
                z = rest / d
                new = (rest * z).sum(0)
                p, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0) * p, new
                worst = float((norm(rest) / size).max())
                since = 0 if worst < 0.999 * best else since + 1
                best = min(best, worst)
            # what is truly left; gradients begin anew from it, as long as that helps
            rest, rounds = right - times(x), rounds + 1
            left = float((norm(rest) / size).max())
            if left <= 2 * tol:
                break
            if left > before / 2:
                raise Unsettled("the worker-firm system did not settle")
            before = left
        self.rounds += rounds
        return x

    def _mapped(self, x: np.ndarray, schema: str, made) -> DataFrame:
        """made(block, values) of each block and the values of its nodes, of which x has a row for each of nodes()."""
        every, sent, kind = self.nodes()[1], self.blocks.sparkSession.sparkContext.broadcast(x), self.block_kind

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = kind(_arrays(batch, i))
                    yield from made(b, sent.value[np.searchsorted(every.value, b.nodes)]).to_batches()

        return self.blocks.mapInArrow(run, schema)

    def _to_blocks(self, state: DataFrame, column: str, width: int, schema: str, made) -> DataFrame:
        """made(block, values) of each block and the values of its nodes in column x, or of z = r / d."""

        def sent(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    k = _arrays(batch, i)
                    values = np.frombuffer(k[column]).reshape(-1, width)
                    edges = np.concatenate([[0], np.cumsum(k["number"])])
                    values = values / k["d"][:, None] if column == "r" else values
                    for to, a, b in zip(k["to"], edges, edges[1:], strict=False):
                        yield from _table([_sent(k["nb"], to, values[k["place"][a:b]])], PART).to_batches()

        messages = state.select("nb", "d", "to", "number", "place", column).mapInArrow(sent, PART)
        kind = self.block_kind
        run = lambda left, right: made(kind(_arrays(left)), _gathered(right, width))
        return _together(self.blocks, messages, "block", run, schema)

    def solve(self, rhs, width: int, tol: float = 1e-10, most_rounds: int = 5000) -> DataFrame:
        """The nodes' part of the solution, as a table of buckets with x."""
        kind = self.block_kind

        def given(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = kind(_arrays(batch, i))
                    yield from _answers(b, b.right(rhs, width)).to_batches()

        def summed(k: dict, right) -> np.ndarray:
            out, edges = np.zeros((len(k["nodes"]), width)), np.concatenate([[0], np.cumsum(k["number"])])
            data = right.column("data")
            for i, block in enumerate(right.column("block").to_numpy()):
                j = int(np.searchsorted(k["to"], block))
                out[k["place"][edges[j] : edges[j + 1]]] += np.frombuffer(data[i].as_py()).reshape(-1, width)
            return out

        def begun(left, right):
            k = _arrays(left)
            none = np.zeros((len(k["nodes"]), width))
            x = np.frombuffer(k["x"]).reshape(-1, width) if "x" in k else none
            r = summed(k, right) - k["d"][:, None] * x
            return _table([k | {"r": r.tobytes(), "x": x.tobytes(), "told": np.zeros(0)} | dict.fromkeys("psv", none.tobytes())], STATE)

        def advanced(alpha, beta):
            def run(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        k = _arrays(batch, i)
                        x, r, p, s, v = (np.frombuffer(k[c]).reshape(-1, width) for c in "xrpsv")
                        p, s = r / k["d"][:, None] + beta * p, v + beta * s
                        moved = {"x": x + alpha * p, "r": r - alpha * s, "p": p, "s": s}
                        yield from _table([k | {c: y.tobytes() for c, y in moved.items()}], STATE).to_batches()

            return run

        def product(left, right):
            k = _arrays(left)
            r = np.frombuffer(k["r"]).reshape(-1, width)
            z = r / k["d"][:, None]
            v = k["d"][:, None] * z + summed(k, right)
            return _table([k | {"v": v.tobytes(), "told": np.concatenate([(r * z).sum(0), (v * z).sum(0), (r * r).sum(0)])}], STATE)

        def turned(state):
            answers = self._to_blocks(state, "r", width, PART, lambda b, z: _answers(b, b.times(z)))
            state = keep_cut(_together(state, answers, "nb", product, STATE))
            return state, *np.sum([x.told for x in state.select("told").collect()], axis=0).reshape(3, width)

        right = keep_cut(self.blocks.mapInArrow(given, PART))
        state = keep_cut(_together(self.buckets, right, "nb", begun, STATE))
        state, gamma, delta, left = turned(state)
        goal, best, since, before = tol * tol * np.maximum(left, 1e-300), np.inf, 0, np.inf
        first = lambda: np.where(delta > 0, gamma / np.where(delta > 0, delta, 1), 0.0)
        alpha, beta, open_ = first(), np.zeros(width), left > goal
        for _ in range(most_rounds):
            self.rounds += 1
            if not open_.any():
                return state
            state, new, delta, left = turned(state.mapInArrow(advanced(np.where(open_, alpha, 0.0), np.where(open_, beta, 0.0)), STATE))
            beta = np.where(gamma > 0, new / np.where(gamma > 0, gamma, 1), 0.0)
            below = delta - beta * new / np.where(alpha != 0, alpha, np.inf)
            alpha = np.where(below > 0, new / np.where(below > 0, below, 1), 0.0)
            gamma = new
            open_ &= left > goal
            worst = float((left / goal)[open_].max(initial=0))
            since = 0 if worst < 0.999 * best else since + 1
            best = min(best, worst)
            if since > STALLED:
                # The residual that is carried along has drifted off: begin anew from the true one, as long as that helps.
                product_x = self._to_blocks(state, "x", width, PART, lambda b, x: _answers(b, -b.times(x)))
                state = keep_cut(_together(state, right.unionByName(product_x), "nb", begun, STATE))
                state, gamma, delta, left = turned(state)
                open_ = left > goal
                worst = float((left / goal)[open_].max(initial=0))
                if worst > 0.25 * before:
                    break
                alpha, beta, best, since, before = first(), np.zeros(width), worst, 0, worst
        raise Unsettled("the worker-firm system did not settle")

    def each(self, rhs, width: int, schema: str, made) -> DataFrame:
        """made(block, chunks of Block.effects()) of each block, for the solution of rhs."""
        if self.few(width):
            return self._mapped(self.solve_few(rhs, width), schema, lambda b, x: made(b, b.effects(rhs, x)))
        state = self.solve(rhs, width)
        return self._to_blocks(state, "x", width, schema, lambda b, x: made(b, b.effects(rhs, x)))

    def effects(self) -> DataFrame:
        """(w, f, alpha, psi) of each match: the least-squares effects of its worker and its firm."""

        def made(b, chunks):
            import pyarrow as pa

            zw, zf = (np.concatenate(v)[:, 0] for v in zip(*((zw, zf) for *_, zw, zf in chunks), strict=True))
            return pa.table({"w": b.w, "f": b.f, "alpha": zw, "psi": zf})

        sums = lambda b, low, high: (b.s[low:high, None], b.s[low:high, None])
        return self.each(sums, 1, "w long, f long, alpha double, psi double", made)

    def of_extra(self, number: int) -> DataFrame:
        """(w, f, u0, u1, ...): each match's fitted value where the extra columns are the firms' right sides, less their part that no effect explains."""

        def made(b, chunks):
            import pyarrow as pa

            u = np.concatenate([zw + zf for *_, zw, zf in chunks])
            return pa.table({"w": b.w, "f": b.f} | {f"u{i}": u[:, i] for i in range(number)})

        own = lambda b, low, high: (np.zeros((high - low, number)), b.extra.reshape(number, -1)[:, low:high].T)
        return self.each(own, number, "w long, f long" + "".join(f", u{i} double" for i in range(number)), made)

    def levels(self, number: int, tol: float, most_rounds: int) -> DataFrame:
        """(w, f, z0, z1, ...): the effects of workers (f is null) and of firms (w is null), the extra columns being the matches' sums."""
        own = lambda b, low, high: (b.extra.reshape(number, -1)[:, low:high].T,) * 2

        def made(b, x):
            import pyarrow as pa

            ends = [np.concatenate([zw, b.w[low:high, None].view(np.float64)], axis=1) for low, high, _, _, zw, _ in b.effects(own, x)]
            both = np.concatenate(ends)
            w, first = np.unique(np.ascontiguousarray(both[:, number]).view(np.int64), return_index=True)
            z = np.concatenate([both[first, :number], x])
            k, j = len(w), len(b.nodes)
            return pa.table({"w": pa.array(np.concatenate([w, np.zeros(j, np.int64)]), mask=np.arange(k + j) >= k), "f": pa.array(np.concatenate([np.zeros(k, np.int64), b.nodes]), mask=np.arange(k + j) < k)} | {f"z{i}": z[:, i] for i in range(number)})

        schema = "w long, f long" + "".join(f", z{i} double" for i in range(number))
        if self.few(number) and not self.n_hot:
            import pyarrow as pa

            x = self.solve_few(own, number, tol, most_rounds)
            firms = self.blocks.sparkSession.createDataFrame(pa.table({"f": self.nodes()[0]} | {f"z{i}": x[:, i] for i in range(number)}))
            return self._mapped(x, schema, made).where("w IS NOT NULL").unionByName(firms.select(F.lit(None).cast("long").alias("w"), "*"))
        found = self._to_blocks(self.solve(own, number, tol, most_rounds), "x", number, schema, made)
        # a firm is in many blocks, and a worker with very many matches too; all have the same values
        return found.groupBy("w", "f").agg(*[F.first(f"z{i}").alias(f"z{i}") for i in range(number)])

    def every(self, n: float | None = None) -> DataFrame:
        """(w, f, t, s, ss, e0, ..., dw, nw, alpha, psi, u0, ...) of each match, made from its block without a join; with n also what exact() tells.
        For up to DENSE_FIRMS firms, whose values the driver holds and of which no worker has very many."""
        k = self.n_extra
        sums = lambda b, low, high: (b.s[low:high, None], b.s[low:high, None])
        own = lambda b, low, high: (np.zeros((high - low, k)), b.extra.reshape(k, len(b.t))[:, low:high].T)
        if not hasattr(self, "_solved"):
            self._solved = np.concatenate([self.solve_few(sums, 1), *([self.solve_few(own, k)] if k else [])], axis=1)
            self._inverted = self._inverse()
        leverage = ["p", "fe", "pe", "cov", "corr"]
        names = ["w", "f", "t", "s", "ss", *[f"e{i}" for i in range(k)], "dw", "nw", "alpha", "psi", *[f"u{i}" for i in range(k)], *(leverage if n else [])]
        told = self._leverages(n, *self._inverted) if n else None

        def made(b, x):
            import pyarrow as pa

            zw, zf = (np.concatenate(v)[:, 0] for v in zip(*((zw, zf) for *_, zw, zf in b.effects(sums, x[:, :1])), strict=True))
            u = [np.concatenate([a + c for *_, a, c in b.effects(own, x[:, 1:])])] if k else []
            columns = [b.w, b.f, b.t, b.s, b.ss, *b.extra.reshape(k, len(b.t)), b.dw[b.wi], np.bincount(b.wi)[b.wi], zw, zf, *[v for m in u for v in m.T]]
            if n:
                columns += [*np.concatenate([told(b, *c) for c in b.chunks()], axis=1), np.ones(len(b.w))]
            return pa.table(dict(zip(names, columns, strict=True)))

        return self._mapped(self._solved, ", ".join(f"{c} {'long' if c in ('w', 'f', 'nw') else 'double'}" for c in names), made)

    def _inverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The firms in order, the inverse of their system with the last at zero, the workers' part of it, and its diagonal."""
        firms = np.sort(np.concatenate([x.nodes for x in self.buckets.select("nodes").collect()]))
        of = np.zeros(len(firms))
        for x in self.buckets.select("nodes", "d").collect():
            of[np.searchsorted(firms, x.nodes)] = x.d

        def summed(batches):
            import pyarrow as pa

            inner = np.zeros((len(firms), len(firms)))
            for batch in batches:
                for i in range(batch.num_rows):
                    b = Block(_arrays(batch, i))
                    for low, high in b.chunks():
                        q, dw, _ = b.spread_of(low, high, firms)
                        inner += q.T @ (q / dw[:, None])
            i, j = np.nonzero(inner)
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(inner[i, j])], ["i", "j", "v"])

        inner = np.zeros((len(firms), len(firms)))
        # at most the square of DENSE_FIRMS rows
        for x in self.blocks.mapInArrow(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            inner[x.i, x.j] = x.v
        out = np.zeros_like(inner)
        if len(firms) > 1:
            out[:-1, :-1] = np.linalg.inv((np.diag(of) - inner)[:-1, :-1])
        return firms, out, inner, of

    def exact(self, n: float) -> DataFrame:
        """(w, f, p, fe, pe, cov, corr): each match's leverage of a row and its weights in the three components.

        Up to DENSE_FIRMS firms by the inverse of their system, which goes to all tasks, with any number of matches; else
        by a right side for each match.
        """
        if self.n_firms > DENSE_FIRMS:
            return self.exact_by_match(n)
        of_chunk = self._leverages(n, *self._inverse())

        def told(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    b = Block(_arrays(batch, i))
                    for low, high in b.chunks():
                        yield pa.record_batch([pa.array(b.w[low:high]), pa.array(b.f[low:high]), *map(pa.array, of_chunk(b, low, high)), pa.array(np.ones(high - low))], ["w", "f", "p", "fe", "pe", "cov", "corr"])

        return self.blocks.mapInArrow(told, "w long, f long, p double, fe double, pe double, cov double, corr double")

    def _leverages(self, n: float, firms: np.ndarray, inverse: np.ndarray, inner: np.ndarray, of: np.ndarray):
        """From a block and a chunk to the chunk's leverages and weights, by the inverse of the firms' system."""

        def of_chunk(b, low, high):
            q, dw, k = b.spread_of(low, high, firms)
            q, firm = q / dw[:, None], np.searchsorted(firms, b.nodes[b.fi[low:high]])
            out = np.zeros((4, high - low))
            for a in range(0, high - low, 1024):
                m = slice(a, min(a + 1024, high - low))
                own, d = q[k[m]], 1 / dw[k[m]]
                r = -own
                r[np.arange(len(r)), firm[m]] += 1
                z = r @ inverse
                qz, inside, sums = (own * z).sum(1), ((z @ inner) * z).sum(1), z @ of
                out[:, m] = d + (r * z).sum(1), (z * z) @ of - sums**2 / n, d - 2 * qz + inside - (1 - sums) ** 2 / n, qz - inside - (1 - sums) * sums / n
            return out

        return of_chunk

    def exact_by_match(self, n: float, width: int = 256) -> DataFrame:
        """As exact(), by a right side for each match."""
        sizes = {r.block: r.n for r in self.blocks.select("block", F.size("t").alias("n")).collect()}
        begins = dict(zip(sizes, np.concatenate([[0], np.cumsum(list(sizes.values()))]).tolist(), strict=False))
        parts = []
        for begin in range(0, self.n_matches, width):

            def unit(b, low, high, begin=begin):
                out = np.zeros((high - low, width))
                column = begins[b.block] + np.arange(low, high) - begin
                some = np.flatnonzero((column >= 0) & (column < width))
                out[some, column[some]] = 1.0
                return out, out

            def made(b, chunks, begin=begin):
                import pyarrow as pa

                sums, p, names = np.zeros((5, width)), np.zeros(width), np.zeros((2, width), np.int64)
                for low, high, a, _, zw, zf in chunks:
                    t = b.t[low:high, None]
                    sums += [(t * zf * zf).sum(0), (t * zf).sum(0), (t * zw * zw).sum(0), (t * zw).sum(0), (t * zw * zf).sum(0)]
                    row, column = np.nonzero(a)
                    p[column] = (zw + zf)[row, column]
                    names[:, column] = b.w[low:high][row], b.f[low:high][row]
                return pa.table({"column": np.arange(begin, begin + width), "w": names[0], "f": names[1], "p": p} | {f"a{i}": v for i, v in enumerate(sums)})

            parts.append(keep_cut(self.each(unit, width, "column long, w long, f long, p double, a0 double, a1 double, a2 double, a3 double, a4 double", made)))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # a column's names and leverage are zero but in the block that has its match
        own = every.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("w", "f", "p", "a0", "a1", "a2", "a3", "a4")]).where(F.col("column") < self.n_matches)
        weights = [F.expr(f"a0 - a1 * a1 / {n}").alias("fe"), F.expr(f"a2 - a3 * a3 / {n}").alias("pe"), F.expr(f"a4 - a3 * a1 / {n}").alias("cov")]
        return own.select("w", "f", "p", *weights, F.lit(1.0).alias("corr"))

    def sketched(self, draws: int, seed: int, by_match: bool, n: float, at_once: int = 20) -> DataFrame:
        """As exact(), from random signs keyed by seed, draw, worker and firm, however rows are dealt out; corr corrects the bias of dividing by 1 - p."""
        sums = None
        for begin in range(0, draws, at_once):
            number = min(at_once, draws - begin)
            signs = _Signs(seed, begin, number, by_match)
            total = self.blocks.mapInArrow(signs.totals, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
            signs.mean = np.array([x.total for x in sorted(total, key=lambda x: x.k)]) / n

            def made(b, chunks, signs=signs, number=number):
                return _table([{"block": int(b.block), "data": np.concatenate([signs.moments(b, draws, *c) for c in chunks], axis=1).tobytes()}], "block int, data binary")

            own = keep_cut(self.each(signs, 3 * number, "block int, data binary", made))
            sums = own if sums is None else sums.unionByName(own)

        def told(left, right):
            import pyarrow as pa

            b = _arrays(left)
            p1, p2, m1, m2, pm, fe, pe, cov = sum(np.frombuffer(x.as_py()).reshape(8, -1) for x in right.column("data"))
            p = p1 / (p1 + m1)
            gone = np.maximum(1 - p, 1e-300)
            var = (gone**2 * p2 + p**2 * m2 - 2 * gone * p * pm) / draws
            bias = (gone * p2 - p * m2 + 2 * (gone - p) * pm) / draws
            corr = np.where(gone > 1e-300, 1 - var / np.maximum(gone, 1e-150) ** 2 + bias / gone, 1.0)
            return pa.table({"w": b["w"], "f": b["f"], "p": p / b["t"] if by_match else p, "fe": fe, "pe": pe, "cov": cov, "corr": corr})

        return _together(self.blocks, sums, "block", told, "w long, f long, p double, fe double, pe double, cov double, corr double")


class _Signs:
    """The right sides of some draws: for the leverages, and for firms and workers alone."""

    def __init__(self, seed: int, begin: int, number: int, by_match: bool):
        self.seed, self.begin, self.number, self.by_match, self.mean = seed, begin, number, by_match, np.zeros(number)

    def sums(self, b: Block, low: int, high: int, kind: int) -> np.ndarray:
        """For each match and draw, the sum of as many signs as it has rows; kind 2: of one."""
        from .akm import keyed_states, sums_of_signs

        unit = b.w[low:high].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.f[low:high].astype(np.uint64)
        count = np.ones(high - low) if kind == 2 else b.t[low:high]
        return np.stack([sums_of_signs(keyed_states(self.seed, 3 * (self.begin + k) + kind, unit), count) for k in range(self.number)], axis=1)

    def totals(self, batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(_arrays(batch, i))
                total = sum(self.sums(b, low, high, 1).sum(0) for low, high in b.chunks())
                yield pa.record_batch([pa.array(np.arange(self.number, dtype=np.int32)), pa.array(total)], ["k", "total"])

    def __call__(self, b: Block, low: int, high: int):
        t = b.t[low:high, None]
        r = np.sqrt(t) * self.sums(b, low, high, 2) if self.by_match else self.sums(b, low, high, 0)
        v = self.sums(b, low, high, 1) - t * self.mean
        none = np.zeros_like(v)
        return np.concatenate([r, none, v], axis=1), np.concatenate([r, v, none], axis=1)

    def moments(self, b: Block, draws: int, low, high, a, c, zw, zf) -> np.ndarray:
        """Of each match, what the draws add to the moments of its leverage and to its weights."""
        k, t = self.number, b.t[low:high, None]
        r, z = a[:, :k], zw[:, :k] + zf[:, :k]
        if self.by_match:
            r, z = r / np.sqrt(t), np.sqrt(t) * z
            far2, far4 = (r - z) ** 2, (r - z) ** 4
        else:
            up = (t + r) / 2 / t
            far2, far4 = up * (1 - z) ** 2 + (1 - up) * (1 + z) ** 2, up * (1 - z) ** 4 + (1 - up) * (1 + z) ** 4
        of = zw + zf
        firm, worker = of[:, k : 2 * k], of[:, 2 * k :]
        return np.stack([x.sum(1) / draws for x in (z**2, z**4, far2, far4, z**2 * far2, firm**2, worker**2, firm * worker)])
