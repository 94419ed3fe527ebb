"""Two effects on blocks of pairs in the cluster."""

import numpy as np

from quadrat.operators import absorb as a
from quadrat.operators import spread_akm


def _refused(*args, **kwargs):
    raise AssertionError("blocks are moved")


def test_few_levels_move_no_block(spark, monkeypatch):
    """Where the driver holds the smaller effect's values no round moves blocks, and the result is the driver's."""
    rows = [(i % 13, i % 5, float(i * i % 17), float(i * 7 % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "p long, s long, y double, x double").repartition(2)
    want = a.absorb(df, ["y", "x"], ["p", "s"])[0].orderBy("p", "s", "y", "x").toPandas()
    monkeypatch.setattr(a, "MOST_PAIR_CELLS", 0)
    monkeypatch.setattr(spread_akm.SpreadSystem, "_to_blocks", _refused)
    out, how = a.absorb(df, ["y", "x"], ["p", "s"])
    got = out.orderBy("p", "s", "y", "x").toPandas()
    assert how["method"] == "spread levels" and how["certified"]
    assert np.allclose(got[["y_tilde", "x_tilde"]], want[["y_tilde", "x_tilde"]], atol=1e-8)
