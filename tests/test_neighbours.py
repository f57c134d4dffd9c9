"""Nearest rows and radius neighbours of clouds whose density varies, against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from kelpie.operators import joins

AXES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def cloud(spark):
    """Even points, a third of all in a cell of a thousandth, in it a closer one, a place shared by many, and a far point."""
    r = np.random.default_rng(7)
    parts = [r.uniform(-1, 1, (300, 3)), 0.3 + r.uniform(0, 1e-3, (250, 3)), 0.3 + r.uniform(0, 1e-5, (150, 3)), np.full((90, 3), 0.3), [[60.0, -3.0, 2.0]]]
    xyz = np.concatenate(parts)[r.permutation(791)]
    rows = pd.DataFrame({"id": np.arange(len(xyz)), "pos": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    return xyz, spark.createDataFrame(rows)


def _ranked(xyz, k, radius=np.inf, gap=0, own=True):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    at = np.arange(len(xyz))
    d = np.where((d <= radius) & (np.abs(at[:, None] - at[None]) >= gap) & (own | (at[:, None] != at[None])), d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i, int(j), n + 1) for i in range(len(xyz)) for n, j in enumerate(best[i]) if d[i, j] < np.inf}


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_of_uneven_cloud(spark, cloud, k):
    xyz, df = cloud
    got = joins.nearest(df, df, AXES, k, dense=16)
    assert {(r.q_id, r.b_id, r["rank"]) for r in got.collect()} == _ranked(xyz, k)


@pytest.mark.parametrize("gap", [0, 9])
def test_radius_of_uneven_cloud(spark, cloud, gap):
    xyz, df = cloud
    got = joins.radius_top_k(df, AXES, 0.4, 3, min_gap=gap, dense=16)
    assert {(r.a_id, r.b_id, r["rank"]) for r in got.collect()} == _ranked(xyz, 3, 0.4, gap, own=False)


def test_dense_cells_do_not_meet_whole(spark, monkeypatch):
    """3,000 points in one cell: 9 million pairs within its size, of which a search sees as many as rows and `dense` bound."""
    r = np.random.default_rng(8)
    xyz = np.concatenate([r.uniform(0, 100, (1000, 3)), 50 + r.uniform(0, 1e-2, (3000, 3))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})).cache()
    seen, plain = [], joins.within_radius

    def counted(*a, **k):
        out = plain(*a, **k)
        seen.append(out.count())
        return out

    monkeypatch.setattr(joins, "within_radius", counted)
    assert joins.nearest(df, df, AXES, 2, dense=32).count() == 8000
    assert sum(seen) < 4000 * 8 * 32


def test_nearest_of_few_and_equal_rows(spark):
    one = spark.createDataFrame([(1, 5.0, 5.0)], "id long, x double, y double")
    assert [tuple(r) for r in joins.nearest(one, one, ["x", "y"], 3).collect()] == [(1, 1, 0.0, 1)]
    same = spark.createDataFrame([(i, 0.0, 0.0) for i in range(40)], "id long, x double, y double")
    got = joins.nearest(same, same, ["x", "y"], 2, dense=4).collect()
    assert {(r.q_id, r.b_id, r["rank"]) for r in got} == {(i, j, j + 1) for i in range(40) for j in (0, 1)}
    assert joins.nearest(one.limit(0), one, ["x", "y"], 1).count() == 0
    assert joins.radius_top_k(one.limit(0).selectExpr("*", "id AS pos"), ["x", "y"], 1.0, 2).count() == 0


@pytest.mark.parametrize("kind", ["spread", "lattice", "two places", "one place", "pair", "none"])
def test_median_of_all_pairs(spark, monkeypatch, kind):
    """The exact median and number of pairs from tiles and leaves, and most pairs of rows are never compared."""
    rng = random.Random(2)
    make = {"spread": lambda i: [rng.gauss(0, 1) for _ in range(3)], "lattice": lambda i: [i % 7, i % 5, i % 3], "two places": lambda i: [i % 2, 0, 0], "one place": lambda i: [1, 2, 3], "pair": lambda i: [i, 0, 0], "none": lambda i: [0, 0, 0]}[kind]
    places = [[float(v) for v in make(i)] for i in range({"pair": 2, "none": 0}.get(kind, 1200))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, math.nan, 0.0, 0.0), (-2, None, 0.0, 0.0)], "id int, x double, y double, z double")
    d = sorted(x for i, a in enumerate(places) for b in places[:i] if (x := math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)) > 1e-9)
    want = None if not d else (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2
    for few in (100_000, 10):
        monkeypatch.setattr(joins, "FEW", few)
        got = joins.median_pair_distance(df, ["x", "y", "z"], block=500).first()
        assert got["pairs"] == len(d) and (got["median_distance"] == want or abs(got["median_distance"] - want) < 1e-15)


def test_far_leaves_are_counted_whole():
    """Bounds hold the distances of their leaves, and tell the side of the median for many."""
    at = np.random.default_rng(1).normal(size=(16_384, 3))
    at = at[joins._leaf_order(at)]
    least, most, n, distances = joins._leaf_distances(at, None)
    assert n.sum() == 16_384 * 16_383 // 2 and n[(least <= 2.17) & (most >= 2.17)].sum() < 0.65 * n.sum()
    for i in range(0, len(n), 5000):
        d = next(distances(np.array([i])))
        assert np.count_nonzero(~np.isnan(d)) == n[i] and least[i] <= np.nanmin(d) and np.nanmax(d) <= most[i]
