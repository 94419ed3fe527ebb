"""Data of a waterfall plot."""

from types import SimpleNamespace

import numpy as np
import pytest

from quadrat.functions.tables import plot_data

MOVED = SimpleNamespace(targets=["x"], groups=["tax", "firm", "year"], base=np.array([2.0]), full=np.array([-0.5]), delta=np.array([[0.5], [3.0], [-1.0]]), total=np.array([2.5]))


def test_bars_lead_from_base_to_full():
    got = plot_data(MOVED, "x", labels={"firm": "Firms"})
    assert [b["label"] for b in got["bars"]] == ["base", "tax", "Firms", "year", "full"]
    assert [(b["bottom"], b["height"]) for b in got["bars"]] == [(0, 2), (1.5, 0.5), (-1.5, 3), (-1.5, 1), (-0.5, 0.5)]
    assert all(line["left"] == pytest.approx(line["right"]) for line in got["lines"]) and len(got["lines"]) == 4
    assert sum(b["share"] for b in got["bars"] if b["share"] is not None) == pytest.approx(1)


def test_filtered_groups_are_one_bar():
    got = plot_data(MOVED, "x", drop="^t|year")
    assert [(b["label"], b["kind"]) for b in got["bars"][1:-1]] == [("firm", "group"), ("Other (filtered)", "other")]
    assert got["bars"][2]["share"] == pytest.approx(-0.2) and got["lines"][-1]["left"] == got["lines"][-1]["right"] == -0.5
    gap = plot_data(MOVED, "x", keep="firm", other=False)["lines"][-1]
    assert gap["left"] == -1 and gap["right"] == -0.5


def test_no_movement_has_no_shares():
    still = SimpleNamespace(**(vars(MOVED) | {"full": np.array([2.0]), "delta": np.array([[0.0], [0.0], [0.0]]), "total": np.array([0.0])}))
    assert all(b["share"] is None for b in plot_data(still, "x")["bars"])
