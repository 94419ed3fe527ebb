"""The estimation sample: columns, missing values, ids, singletons, collapsed groups."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unsettled(RuntimeError):
    """Iterations that didn't reach their goal."""


def keep_cut(df: DataFrame) -> DataFrame:
    """Write df to the folder of spark.checkpoint.dir and read it back, without its lineage.

    Where the setting is empty, a folder is made for the process, but only with a local master: executors of a cluster
    don't share one, so there it raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return df.checkpoint()


def check(df: DataFrame, numbers: list[str], ids: list[str], na_action: str = "raise") -> DataFrame:
    """Drop rows with missing values, or raise; infinite values and negative integer ids always raise. One pass."""
    kinds = dict(df.dtypes)
    missing = [F.col(c).isNull() | F.isnan(c) for c in numbers] + [F.col(c).isNull() for c in ids]
    bad = F.lit(False)
    for m in missing:
        bad = bad | m
    wrong = F.lit(False)
    for c in numbers:
        wrong = wrong | (F.abs(F.col(c)) == float("inf"))
    for c in ids:
        if kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float"):
            wrong = wrong | (F.col(c) < 0)
    n_bad, n_wrong = df.agg(F.sum(bad.cast("int")), F.sum(F.coalesce(wrong, F.lit(False)).cast("int"))).first()
    if n_wrong:
        raise ValueError(f"{n_wrong} rows have infinite numbers or negative ids")
    if n_bad and na_action == "raise":
        raise ValueError(f"{n_bad} rows have missing values")
    return df.where(~bad) if n_bad else df


#: Distinct cells up to which one task drops all singletons.
MOST_CELLS = 2_000_000


def drop_singletons(df: DataFrame, keys: list[str], weight: str | None = None, most_cells: int | None = None) -> DataFrame:
    """Drop rows alone in a level of any key, again and again until none is; weight: frequency weights, counted as rows.

    Works on the distinct cells of the keys with their counts; the rows are read for those, and once at the end. Up to MOST_CELLS
    cells one task drops them one after the other. Beyond, a round takes all cells alone in a level and whatever
    goes with them: if two cells are alone together in a level, and one goes, so does the other, so
    whole chains go at once and rounds are logarithmic in the cells.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    names = [f"__k{i}" for i in range(len(keys))]
    cells = keep_cut(df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(size.cast("double").alias("__n")))
    if len(keys) == 1:
        lost = cells.where("__n <= 1").select(*names)
    elif cells.count() <= (MOST_CELLS if most_cells is None else most_cells):
        schema = ", ".join(f"{n} {cells.schema[n].dataType.simpleString()}" for n in names)
        lost = cells.repartition(1).mapInArrow(_alone, schema)
    else:
        lost = _spread_alone(cells, names)
    lost = keep_cut(lost)
    number = lost.count()
    if not number:
        return keep_cut(df)
    # A cell that goes has one row or several, of which each is alone at some time.
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return keep_cut(df.join(counted(lost, number), same, "left_anti"))


def _alone(batches):
    """The cells that go, of all cells: levels with one row left wait in a queue, and what goes makes others wait."""
    import numpy as np
    import pyarrow as pa

    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    n, sides = table.column("__n").to_numpy().tolist(), []
    for name in table.column_names[:-1]:
        d = table.column(name).combine_chunks().dictionary_encode()
        code = d.indices.fill_null(len(d.dictionary)).to_numpy().astype(np.int64)
        order, levels = np.argsort(code, kind="stable"), len(d.dictionary) + 1
        left = np.bincount(code, n, levels)
        sides.append((code.tolist(), order.tolist(), np.concatenate([[0], np.cumsum(np.bincount(code, minlength=levels))]).tolist(), left.tolist()))
    here = [True] * len(n)
    waiting = [(k, level) for k, (_, _, first, left) in enumerate(sides) for level in range(len(left)) if left[level] <= 1 and first[level] < first[level + 1]]
    while waiting:
        k, level = waiting.pop()
        _, order, first, _ = sides[k]
        for cell in order[first[level] : first[level + 1]]:
            if here[cell]:
                here[cell] = False
                for other, (code, _, _, left) in enumerate(sides):
                    at = code[cell]
                    before = left[at]
                    left[at] -= n[cell]
                    if left[at] <= 1 < before:
                        waiting.append((other, at))
    yield from table.drop_columns(["__n"]).take(np.flatnonzero(~np.array(here))).to_batches(max_chunksize=200_000)


def _spread_alone(cells: DataFrame, names: list[str]) -> DataFrame:
    """The cells that go, in the cluster."""
    from .graph import components

    every = cells = keep_cut(cells.withColumn("__c", F.monotonically_increasing_id()))
    while True:
        starts, links = None, None
        for name in names:
            levels = cells.groupBy(name).agg(F.sum("__n").alias("t"), F.max("__n").alias("most"), F.count(F.lit(1)).alias("c"), F.min("__c").alias("u"), F.max("__c").alias("v"))
            levels = keep_cut(levels.where("t <= 1 OR c = 2 AND most <= 1"))
            alone = levels.where("t <= 1").select(F.col(name).alias("__level"))
            own = cells.join(alone, F.col(name).eqNullSafe(F.col("__level")), "left_semi").select("__c")
            pairs = levels.where("c = 2").select("u", "v")
            starts, links = (own, pairs) if starts is None else (starts.unionByName(own), links.unionByName(pairs))
        starts = keep_cut(starts.distinct())
        if not starts.head(1):
            break
        found = components(links)
        with_start = found.join(starts.withColumnRenamed("__c", "node"), "node").select("root").distinct()
        going = starts.unionByName(found.join(with_start, "root").select(F.col("node").alias("__c"))).distinct()
        cells = keep_cut(cells.join(going, "__c", "left_anti"))
    return every.join(cells.select("__c"), "__c", "left_anti").select(*names)


#: Rows of a few ids up to which a table that has been counted is broadcast.
MOST_BROADCAST = 1_000_000


def counted(ids: DataFrame, n: int) -> DataFrame:
    """A table of ids with n rows, to be broadcast if that is few enough; else joins shuffle it."""
    return F.broadcast(ids) if n <= MOST_BROADCAST else ids


def collapse(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row for each group; raises unless each column is constant in it."""
    out = df.groupBy(group).agg(*[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"__max_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(c) != F.col(f"__max_{c}"))
    if not out.where(differs).isEmpty():
        raise ValueError("a column varies inside a group")
    return out.select(group, *columns)
