"""One-to-one pairs within a tolerance against the greedy choice."""

import random

import pytest

from kelpie.operators import joins


def greedy(left, right, tolerance):
    found = sorted((abs(a - b), a, b, i, j, g) for g, i, a in left for h, j, b in right if g == h and abs(a - b) <= tolerance)
    ls, rs, out = set(), set(), set()
    for _, _, _, i, j, g in found:
        if (g, i) not in ls and (g, j) not in rs:
            ls.add((g, i))
            rs.add((g, j))
            out.add((g, i, j))
    return out


@pytest.mark.parametrize("chain", [1_000_000, 3])
def test_greedy_pairs(spark, chain):
    rng = random.Random(chain)
    side = lambda n: [(rng.choice("ab"), i, rng.randrange(3000)) for i in range(n)]
    left, right = side(120), side(100)
    df = lambda rows: spark.createDataFrame(rows, "g string, id long, t long")
    got = {(r["g"], r["l_id"], r["r_id"]) for r in joins.tolerance_pairs(df(left), df(right), 25, ["g"], chain).collect()}
    assert got == greedy(left, right, 25)
    assert joins.tolerance_pairs(df(left), df(right).limit(0), 25, ["g"], chain).count() == 0


def test_drifting_clock(spark):
    """Gaps that shrink along time: each pair waits for the one after it, which rounds settle one at a time."""
    left = [("x", i, 1000 * i - i * i) for i in range(300)]
    right = [("x", i, 1000 * i - i * i + 500 - i) for i in range(300)]
    df = lambda rows: spark.createDataFrame(rows, "g string, id long, t long").drop("g")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = {("x", r["l_id"], r["r_id"]) for r in joins.tolerance_pairs(df(left), df(right), 1000).collect()}
    assert got == greedy(left, right, 1000)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 60
