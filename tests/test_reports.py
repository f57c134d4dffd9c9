import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import gates, images, integrity, reports


def snapshot(spark, errors, focal=1.0, shift=0.0, scale=1.0, **moved):
    rigs = [(i, [float(v) for v in (1, 0, 0, 0.1 + shift, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)], scale * i, 0.0, 0.0) for i in range(6)]
    camera = {"fl_x": 800.0 * focal, "fl_y": 805.0 * focal, "cx": 400.0, "cy": 401.0, "k1": 0.01, "k2": -0.001, "k3": 0.0, "k4": 0.0}
    right = {k: v + moved.get(k, 0.0) for k, v in camera.items()}
    return {
        "errors": spark.createDataFrame([(float(e),) for e in errors], "error double"),
        "rigs": spark.createDataFrame(rigs, "id int, m array<double>, x double, y double, z double"),
        "cameras": spark.createDataFrame([("left", *camera.values()), ("right", *right.values())], "key string, " + ", ".join(f"{k} double" for k in camera)),
    }


BEFORE, AFTER = [1.8, 1.9, 2.0, 2.1], [0.8, 0.9, 1.0, 1.1]


def failed(spark, after, stage, solved=True, **own):
    return {r["name"] for r in reports.bundle_report(snapshot(spark, BEFORE), after, stage, solved, **own).filter("not passed").collect()}


def test_bundle_stages(spark):
    """What each stage may change of the cameras, with the policy's own limits."""
    assert failed(spark, snapshot(spark, AFTER, focal=1.01), 2) == set()
    assert failed(spark, snapshot(spark, AFTER, focal=1.03), 2) == set()  # 3 % is under the limit of 5 %
    assert failed(spark, snapshot(spark, AFTER, focal=1.06), 2) == {"camera_parameter_bounds"}
    assert failed(spark, snapshot(spark, AFTER, focal=1.01), 1) == {"camera_parameter_bounds"}
    assert failed(spark, snapshot(spark, AFTER, k1=0.005, k2=-0.003), 3) == set()
    assert failed(spark, snapshot(spark, AFTER, k1=0.03), 3) == {"camera_parameter_bounds"}
    assert failed(spark, snapshot(spark, AFTER, k3=0.001), 3) == {"camera_parameter_bounds"}
    assert failed(spark, snapshot(spark, AFTER, cx=1e-9), 3) == {"camera_parameter_bounds"}  # over 1e-10
    with pytest.raises(ValueError, match="stages"):
        failed(spark, snapshot(spark, AFTER), 4)


def test_bundle_gates(spark):
    assert failed(spark, snapshot(spark, AFTER, scale=1.02), 1) == {"scene_scale_fixed"}
    assert failed(spark, snapshot(spark, [1.7, 1.9, 2.0], shift=0.01), 1, False) == {"solver_success", "reprojection_p50_improvement", "rig_baseline_fixed"}
    assert failed(spark, snapshot(spark, AFTER, shift=0.01), 1, maximum_rig_translation_drift_m=0.02) == set()
    good = snapshot(spark, AFTER)
    for bad in ({"rigs": good["rigs"].limit(3)}, {"errors": good["errors"].limit(0)}, {"errors": snapshot(spark, [float("nan")])["errors"]}, {"cameras": good["cameras"].limit(1)}):
        with pytest.raises(ValueError):
            failed(spark, good | bad, 1)
    for own in ({"unknown": 1.0}, {"maximum_scale_drift_fraction": -1.0}, {"minimum_reprojection_p50_improvement_fraction": 1.0}, {"fixed_parameter_tolerance": float("nan")}):
        with pytest.raises(ValueError, match="limit"):
            reports.checked_policy(**own)
    assert gates.stage_options(2) == {"refine_rig_from_world": True, "refine_sensor_from_rig": False, "refine_focal_length": True, "refine_principal_point": False, "refine_extra_params": False}


def test_bundle_report_is_signed(spark):
    gated = reports.bundle_report(snapshot(spark, BEFORE), snapshot(spark, AFTER), 1, True)
    report = reports.signed_bundle_report(gated, 1, "a" * 64, "b" * 64)
    reports.verify_bundle_report(report)
    assert report["candidate_accepted"] and report["published_model"] == "after" and not report["stage_options"]["refine_focal_length"]
    from kelpie.functions import scalar

    for change in ({"published_model": "before"}, {"gates": report["gates"] | {"solver_success": {"status": "FAIL"}}}, {"gates": {}}):
        with pytest.raises(ValueError):
            reports.verify_bundle_report(scalar.signed(report | change, "ba_report_sha256"))
    with pytest.raises(ValueError, match="signature"):
        reports.verify_bundle_report(report | {"stage": 2})


def test_pair_leaks(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val"), ("d", "train"), ("e", "train"), ("e", "val")], "key string, split string")
    pairs = lambda *p: spark.createDataFrame(p, "a string, b string")
    got = {tuple(r) for r in integrity.pair_leaks(pairs(("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("a", "x"), ("b", "e"), ("a", None)), split).collect()}
    assert got == {("b", "not_canonical"), ("a", "not_canonical"), ("a", "repeated_pair"), ("c", "leaks"), ("x", "unknown_item"), ("e", "several_splits"), ("d", "unpaired")}
    assert integrity.pair_leaks(pairs(("a", "b"), ("b", "d")), split.filter("key <> 'e'")).count() == 0


def test_images(spark):
    p = spark.range(32 * 32).select(F.lit("i").alias("image"), (F.col("id") % 32).cast("int").alias("px"), F.floor(F.col("id") / 32).cast("int").alias("py"), ((F.col("id") * 7919) % 251 / 251.0).alias("a"))
    p = p.withColumn("b", F.col("a")).withColumn("m", F.col("px").between(8, 23) & F.col("py").between(8, 23))
    assert abs(images.gaussian_ssim(p, "image", "a", "b", "m").first()["ssim"] - 1) < 1e-9
    assert images.gaussian_ssim(p.withColumn("b", 1 - F.col("a")), "image", "a", "b", "m").first()["ssim"] < 0.5
    out = images.cropped(p, 4, 8, 16, 8, 2)
    assert out.count() == 32 and out.agg(F.max("px")).first()[0] == 7
    with pytest.raises(ValueError):
        images.cropped(p, 0, 0, 15, 8, 2)


@pytest.mark.parametrize("to", [(5, 4), (13, 9), (7, 11), (30, 3), (1, 1)])
def test_resizes(spark, to):
    w, h = 13, 9
    img = np.random.default_rng(3).integers(0, 256, (h, w)).astype(float)
    p = spark.createDataFrame([("i", x, y, float(img[y, x])) for y in range(h) for x in range(w)], "image string, px int, py int, v double")

    def grid(rows):
        out = np.full((to[1], to[0]), -1.0)
        for r in rows.collect():
            assert out[r.py, r.px] == -1
            out[r.py, r.px] = r.v
        return out

    at = lambda n, m: ((2 * np.arange(m) + 1) * n) // (2 * m)
    assert (grid(images.resized(p, (w, h), to)) == img[np.ix_(at(h, to[1]), at(w, to[0]))]).all()

    def kernel(n, m):
        out = np.zeros((m, n))
        for i, x, v in ((i, x, v) for x, i, v in images.kernel_weights(n, m)):
            out[i, x] = v
        return out

    levels = lambda v: np.clip(np.floor(np.round(v, 9) + 0.5), 0, 255)
    got = grid(images.resampled(p, ["image"], ["v"], (w, h), to))
    assert (got == levels(kernel(h, to[1]) @ levels(img @ kernel(w, to[0]).T))).all()
    free = grid(images.resampled(p, ["image"], ["v"], (w, h), to, None))
    assert np.allclose(free, kernel(h, to[1]) @ img @ kernel(w, to[0]).T)
    if to == (w, h):
        assert (got == img).all()  # a size of its own changes nothing


def test_kernel_weights():
    """Constant sides stay constant; by hand: two pixels to one see each other's halves of one stretched lobe."""
    for n, to in ((10, 3), (3, 10), (1, 4), (51, 20)):
        sums = np.zeros(to)
        for _, i, v in images.kernel_weights(n, to):
            sums[i] += v
        assert np.allclose(sums, 1)
    assert images.kernel_weights(2, 1) == [(0, 0, 0.5), (1, 0, 0.5)]
    same = images.kernel_weights(4, 4)
    assert [(x, i) for x, i, _ in same] == [(i, i) for i in range(4)] and np.allclose([v for *_, v in same], 1)


def test_refinement_and_repair(spark):
    losses = spark.createDataFrame([(1.0, 0.9)], "before double, after double")
    moves = spark.createDataFrame([(0.1, 3.0)], "metres double, degrees double")
    assert [r["name"] for r in reports.refinement_gates(losses, moves).filter("not passed").collect()] == ["rotation_deg"]
    still, moved = snapshot(spark, [1])["rigs"], snapshot(spark, [1], shift=0.01)["rigs"]
    assert reports.refinement_gates(losses, moves, 1, 9, rigs=(still, still)).filter("not passed").count() == 0
    assert [r["name"] for r in reports.refinement_gates(losses, moves, 1, 9, rigs=(still, moved)).filter("not passed").collect()] == ["rig_translation_drift_m"]
    same = spark.createDataFrame([(1.0, 1.0)], "before double, after double")
    assert [r["name"] for r in reports.refinement_gates(same, moves, 1, 9, 0.0).filter("not passed").collect()] == ["loss_gain"]
    for bad in ([(0.0, 0.0)], [(1.0, -0.1)], [(1.0, float("nan"))], []):
        with pytest.raises(ValueError):
            reports.refinement_gates(spark.createDataFrame(bad, "before double, after double"), moves)
    r = spark.createDataFrame([("c", f"p{i}", f"i{i}", i / 10) for i in range(9)], "camera string, path string, id string, fraction double")
    have, lack = reports.review_repair(r, r.filter("id in ('i8', 'i0')").select("id"), "camera", "path", "fraction", "id", 6)
    assert have.count() == 2 and have.count() + lack.count() == 6
