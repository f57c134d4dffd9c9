"""Poses, eigenvectors, windows in parts and dilation, each against a plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import eigen, geometry
from kelpie.operators import joins, poses, windows


def quaternion(axis, angle):
    s = math.sin(angle / 2)
    return (s * (axis == "x"), s * (axis == "y"), s * (axis == "z"), math.cos(angle / 2))


def anchors(spark, rows):
    data = [(t, *at, {"x": q[0], "y": q[1], "z": q[2], "w": q[3]}, pt, pr) for t, at, q, pt, pr in rows]
    return spark.createDataFrame(data, "t long, x double, y double, z double, q struct<x:double,y:double,z:double,w:double>, pair_translation double, pair_rotation double")


def linear(i):
    return (i * 100, (i * 0.01, i * -0.002, i * 0.001), quaternion("z", i * 0.005), 0.0, 0.0)


def test_linear_correction_is_recovered(spark):
    times = spark.createDataFrame([(i * 100,) for i in range(-1, 15)], "t long")
    got = poses.corrected(anchors(spark, [linear(i) for i in (0, 3, 6, 9, 12)]), times, "t").collect()
    for r in got:
        _, at, q, _, _ = linear(min(max(r["t"] // 100, 0), 12))
        assert max(abs(r[a] - v) for a, v in zip("xyz", at)) < 1e-12
        assert max(abs(r["q"][k] - v) for k, v in zip("xyzw", q)) < 1e-12
    assert len(got) == 16


@pytest.mark.parametrize("spread", [True, False])
def test_outlier_is_rejected_before_interpolation(spark, spread):
    rows = [linear(i) for i in range(0, 21, 2)]
    t, at, _, _, _ = rows[5]
    rows[5] = (t, (at[0] + 1, at[1] - 0.8, at[2] + 0.6), quaternion("y", 0.8), 0.0, 0.0)
    rows[2] = (*rows[2][:3], 0.02, 0.2)
    got = {r["t"]: r for r in poses.filtered_anchors(anchors(spark, rows), (), "t", spread=spread).collect()}
    assert got[1000]["reasons"] == ["temporal_translation_outlier", "temporal_rotation_outlier"]
    assert got[400]["reasons"] == ["pair_translation_disagreement", "pair_rotation_disagreement"]
    assert got[0]["accepted"] and got[0]["translation_residual"] == 0 and not got[0]["inner"]
    fixed = {r["t"]: r for r in poses.corrected(anchors(spark, rows), spark.createDataFrame([(1000,)], "t long"), "t").collect()}
    assert abs(fixed[1000]["x"] - at[0]) < 1e-12
    with pytest.raises(ValueError, match="anchors"):
        poses.corrected(anchors(spark, rows[:3]), spark.createDataFrame([(1,)], "t long"), "t")
    with pytest.raises(Exception, match="must increase"):
        poses.residuals(anchors(spark, [linear(1), linear(1), linear(1)]), (), "t").collect()


def test_grouped_limits_and_pairs(spark):
    two = anchors(spark, [linear(i) for i in range(8)]).withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert poses.filtered_anchors(two, ["k"], "t").filter("accepted").count() == 16
    pair = two.limit(1).select(*[F.col(c).alias(f"{s}_{c}") for s in "lr" for c in ("x", "y", "z", "q")]).withColumn("r_x", F.col("l_x") + 0.5)
    r = poses.pair_anchors(pair).first()
    assert abs(r["pair_translation"] - 0.5) < 1e-12 and r["pair_rotation"] < 1e-6 and abs(r["x"] - 0.25 - pair.first()["l_x"]) < 1e-12


def test_mean_and_principal_rotation(spark):
    rng = np.random.default_rng(4)
    q = np.array([0.1, 0.2, 0.3, 0.9]) + rng.normal(0, 0.05, (50, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    q[::3] *= -1
    rows = [("a", i, *map(float, v)) for i, v in enumerate(q)] + [("b", 0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, qx double, qy double, qz double, qw double")
    df = df.select("k", "i", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"), F.struct(*[F.col(f"q{k}").alias(k) for k in "xyzw"]).alias("q"))
    mean = {r["k"]: r for r in poses.mean_poses(df, ["k"], "i").collect()}
    want = (q * np.sign(q @ q[0])[:, None]).mean(axis=0)
    assert np.allclose([mean["a"]["q"][k] for k in "xyzw"], want / np.linalg.norm(want)) and mean["a"]["n"] == 50
    assert tuple(mean["b"]["q"]) == (0.0, 0.0, 0.0, 1.0) and mean["b"]["y"] == 2
    top = {r["k"]: r for r in poses.principal_rotations(df, ["k"]).collect()}
    values, vectors = np.linalg.eigh(q.T @ q / 50)
    v = vectors[:, -1] * np.sign(vectors[3, -1])
    assert np.allclose([top["a"]["q"][k] for k in "xyzw"], v) and abs(top["a"]["share"] - values[-1]) < 1e-12
    assert poses.mean_poses(df, [], "i").first()["n"] == 51


@pytest.mark.parametrize("n", [2, 3, 4])
def test_eigenvectors(spark, n):
    rng = np.random.default_rng(n)
    some = [m @ m.T for m in rng.normal(0, 1, (20, n, n))] + [np.zeros((n, n)), np.eye(n), np.diag(np.arange(n) * 1.0), np.ones((n, n)) * 1e6]
    names = [f"m{i}{j}" for i in range(n) for j in range(i, n)]
    df = spark.createDataFrame([(k, *(float(m[i, j]) for i in range(n) for j in range(i, n))) for k, m in enumerate(some)], "k int, " + ", ".join(f"{x} double" for x in names))
    got = df.select("k", eigen.symmetric({(i, j): F.col(f"m{i}{j}") for i in range(n) for j in range(i, n)}, n).alias("e")).collect()
    for r in got:
        m = some[r["k"]]
        size = max(1.0, np.abs(m).max())
        values, vectors = np.array([e["value"] for e in r["e"]]), np.array([e["vector"] for e in r["e"]])
        assert np.allclose(values, np.linalg.eigvalsh(m), atol=1e-9 * size)
        assert np.allclose(m @ vectors.T, vectors.T * values, atol=1e-9 * size) and np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-9)
    lead = spark.range(1).select(eigen.led_positive(F.array(F.lit(-0.6), F.lit(0.8), F.lit(-0.8)), 3).alias("v"), eigen.led_positive(F.array(F.lit(0.1), F.lit(-0.9), F.lit(0.2)), 3).alias("w")).first()
    assert lead["v"] == [-0.6, 0.8, -0.8] and lead["w"] == [-0.1, 0.9, -0.2]


def test_too_few_points(spark):
    with pytest.raises(ValueError):
        joins.local_geometry(spark.range(2).select("id", *[F.lit(0.0).alias(a) for a in "xyz"]), 16)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_parts_carry_their_ends(spark, by):
    """Windows over ranges give what one window over the group gives."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, rng.random()])) for t in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    plain = lambda d: sorted(map(str, map(tuple, d.select("k", "t", *[c for c in d.columns if c not in "kt"]).collect())))
    for one in (
        lambda s: windows.beside(df, by, ["t"], F.col("v"), "lo", "hi", spread=s),
        lambda s: windows.known_around(df, by, "t", F.col("v"), "lo", "hi", spread=s),
        lambda s: windows.step_jumps(df, by, F.coalesce("v", F.lit(0.0)), ["t"], 0.5, spread=s),
        lambda s: joins.leave_one_out(df.withColumn("v", F.coalesce("v", F.lit(0.0))), by, "t", "v", spread=s),
        lambda s: joins.bracketed(df.filter("v is not null"), df.filter("v is null").select("k", "t"), "t", ["v"], by, spread=s),
    ):
        assert plain(one(True)) == plain(one(False))
    plan = windows.beside(df, [], ["t"], F.col("v"), "lo")._jdf.queryExecution().executedPlan().toString()
    assert "spark_partition_id" in plan or "__part" in plan
    assert windows.beside(df.limit(0), by, ["t"], F.col("v"), "lo", spread=True).count() == 0


def test_dilation_of_every_radius(spark):
    rng = random.Random(9)
    pixels = {("a", rng.randrange(60), rng.randrange(50)) for _ in range(40)} | {("a", x, 7) for x in range(10, 30)} | {("b", 0, 0), ("b", 59, 49)}
    df = spark.createDataFrame([*pixels, ("b", 0, 0)], "image string, px int, py int")
    for radius in range(21):
        got = joins.dilated(df, "image", radius, 60, 50).collect()
        want = {(i, x, y) for i in "ab" for x in range(60) for y in range(50) if any(j == i and (px - x) ** 2 + (py - y) ** 2 <= radius * radius for j, px, py in pixels)}
        assert len(got) == len(want) and {(r["image"], r["px"], r["py"]) for r in got} == want
    assert joins.dilated(df.limit(0), "image", 3, 60, 50).count() == 0


def test_composed_transforms(spark):
    m = [0.0, -1.0, 0, 1.0, 1.0, 0, 0, 2.0, 0, 0, 1.0, 3.0, 0, 0, 0, 1.0]
    one = spark.range(1).select(F.array(*map(F.lit, map(float, m))).alias("m"))
    got = one.select(geometry.composed(F.col("m"), geometry.inverse(F.col("m"))).alias("i"), geometry.composed(F.col("m"), F.col("m")).alias("s")).first()
    assert np.allclose(np.reshape(got["i"], (4, 4)), np.eye(4)) and np.allclose(np.reshape(got["s"], (4, 4)), np.linalg.matrix_power(np.reshape(m, (4, 4)), 2))
