"""Exports, configuration files, manifests and digests against small fixtures."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import scalar
from kelpie.operators import joins, manifests, stats, windows
from kelpie.sources import capture, exports


def frames(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    same = [1.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("b/1.jpg", turn, 20.0), ("a/1.jpg", same, 21.0), ("a/2.jpg", same, 20.0)]
    df = spark.createDataFrame(rows, "path string, m array<double>, fl_x double")
    return df.withColumns({"w": F.lit(64), "h": F.lit(48), "fl_y": F.lit(19.5), "cx": F.lit(31.5), "cy": F.lit(23.5), **{f"k{i}": F.lit(i / 1000) for i in (1, 2, 3, 4)}})


def test_model_text_and_transforms(spark, tmp_path):
    f = frames(spark)
    exports.write_model_text(f, str(tmp_path))
    assert (tmp_path / "cameras.txt").read_text().splitlines()[1:] == [
        "1 OPENCV_FISHEYE 64 48 21 19.5 31.5 23.5 0.001 0.002 0.003 0.004", "2 OPENCV_FISHEYE 64 48 20 19.5 31.5 23.5 0.001 0.002 0.003 0.004",
    ]
    got = capture.model_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(r["image_id"], r["camera_id"], r["name"]) for r in got] == [(1, 1, "a_1.jpg"), (2, 2, "a_2.jpg"), (3, 2, "b_1.jpg")]
    assert (got[0]["qw"], got[0]["tx"], got[0]["ty"]) == (1.0, 1.0, -0.5)
    # The turn by 90 degrees about z, world to camera: -R' t.
    assert math.isclose(got[2]["qw"], math.sqrt(0.5), abs_tol=1e-9) and np.allclose([got[2][t] for t in ("tx", "ty", "tz")], [-2, 1, -3])
    exports.write_transforms(f, str(tmp_path / "transforms.json"), "points.ply")
    back = {r["file_path"]: list(r["m"]) for r in capture.transforms(spark, str(tmp_path / "transforms.json")).collect()}
    assert back == {r["path"]: list(r["m"]) for r in f.collect()}
    with pytest.raises(ValueError, match="more than"):
        exports.write_transforms(f, str(tmp_path / "x.json"), most=2)


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 3, "tolerance": 0.1}, indent=1))
    assert exports.config(spark, str(tmp_path / "c.json"), ["seed", "tolerance"]) == {"seed": 3, "tolerance": 0.1}
    with pytest.raises(ValueError, match="tolerance"):
        exports.config(spark, str(tmp_path / "c.json"), ["seed"])
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        exports.config(spark, str(tmp_path / "l.json"), [])


def test_coordinates_and_decisions(spark):
    m = manifests.coordinate_manifest("a" * 64)
    manifests.verify_coordinates(m, "a" * 64)
    for bad in (m | {"units": "feet"}, m | {"coordinate_transform_sha256": "0" * 64}):
        with pytest.raises(ValueError):
            manifests.verify_coordinates(bad, "a" * 64)
    with pytest.raises(ValueError):
        manifests.coordinate_manifest("z" * 64)
    images = spark.createDataFrame([("a",), ("b",)], "image string")
    for rows in ([("a", "ok")], [("a", "ok"), ("a", "no"), ("b", "ok")], [("a", "ok"), ("b", "perhaps")], [("a", "ok"), ("b", None)]):
        with pytest.raises(ValueError):
            manifests.decided(images, spark.createDataFrame(rows, "image string, decision string"), "image", ["ok", "no"])


def test_pose_set(spark):
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    rows = [("a", "r", "left", eye), ("b", "r", "right", eye), ("", "s", "left", eye), (None, "s", "right", eye), ("c", None, "left", None), ("c", "t", None, eye)]
    got = manifests.pose_set_violations(spark.createDataFrame(rows, "image_id string, rig_id string, side string, m array<double>")).collect()
    want = [("", "empty_image"), (None, "empty_image"), ("c", "repeated_image"), ("c", "not_rigid"), ("c", "invalid_side"), ("c", "invalid_side"), ("t", "incomplete_rig")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_narrowed_percentile(spark):
    rng = np.random.default_rng(9)
    for values in (rng.normal(size=4001), np.repeat([1.0, 2.0, 5.0], [700, 1, 699]), np.array([3.0]), np.r_[np.full(900, 7.0), rng.exponential(size=900) * 1e9]):
        rows = [(float(x),) for x in values] + [(None,), (float("nan"),), (float("inf"),)]
        df = spark.createDataFrame(rows, "v double")
        for q in (0.0, 0.5, 0.95, 1.0):
            got, n = stats.narrowed_percentile(df, "v", q, bins=16, few=5)
            assert n == len(values) and math.isclose(got, np.percentile(values, 100 * q), rel_tol=1e-12)
    assert stats.narrowed_percentile(df.limit(0), "v", 0.5) == (None, 0)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(60, 2)))] + [(98, None, 0.0), (99, 0.0, float("nan"))]
    want = [math.dist(a[1:], b[1:]) for i, a in enumerate(rows[:60]) for b in rows[:i]]
    got = joins.median_pair_distance(spark.createDataFrame(rows, "id int, x double, y double"), ["x", "y"], block=9).first()
    assert got["pairs"] == len(want) and math.isclose(got["median_distance"], np.median(want), rel_tol=1e-12)
    assert tuple(joins.median_pair_distance(spark.createDataFrame(rows[:1], "id int, x double, y double"), ["x", "y"]).first()) == (None, 0)


def test_decisions_and_masks(spark):
    gates = {"a": {"status": "PASS"}, "b": {"status": "NOT_RUN"}}
    good = scalar.signed({"gates": gates, "accepted": False, "published": "before"}, "sha")
    manifests.verify_decision(good, "sha", "accepted", "published", ("after", "before"))
    for bad in (good | {"published": "after"}, scalar.signed(good | {"accepted": True}, "sha"), scalar.signed(good | {"published": "after"}, "sha")):
        with pytest.raises(ValueError):
            manifests.verify_decision(bad, "sha", "accepted", "published", ("after", "before"))
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    images = spark.createDataFrame([("a", "r", "left", eye), ("b", "r", "right", eye)], "image_id string, rig_id string, side string, m array<double>")
    curve, counts = spark.createDataFrame([("r",)], "rig_id string"), {"image_count": 2, "rig_count": 1}
    manifests.verify_pose_set(images, counts, curve, True)
    for args in ((images, counts | {"rig_count": 2}, curve, True), (images, counts, curve.limit(0), True), (images, counts, curve, False), (images.limit(1), counts, curve, True)):
        with pytest.raises(ValueError):
            manifests.verify_pose_set(*args)
    shots = spark.createDataFrame([("1", "l"), ("2", "l"), ("3", "r")], "image_id string, camera string")
    masks = spark.createDataFrame([("l", "l.png", "x"), ("r", "r.png", "y"), ("t", "t.png", "z")], "camera string, path string, sha256 string")
    got = manifests.image_masks(shots, masks).orderBy("image_id").collect()
    assert [(r["path"], r["shared_by"]) for r in got] == [("l.png", 2), ("l.png", 2), ("r.png", 1)]
    for bad in (masks.limit(1), masks.unionByName(masks)):
        with pytest.raises(ValueError):
            manifests.image_masks(shots, bad)


def test_digest_and_running_sums(spark):
    rng = np.random.default_rng(4)
    xyz, rgb = rng.normal(size=(500, 3)), rng.integers(0, 256, (500, 3))
    rows = [(i, *map(float, xyz[i]), *map(int, rgb[i])) for i in range(500)]
    p = spark.createDataFrame(rows, "idx long, x double, y double, z double, red int, green int, blue int")
    want = hashlib.sha256(xyz.astype("<f8").tobytes() + rgb.astype(np.uint8).tobytes()).hexdigest()
    assert stats.array_digest(p.repartition(7)) == want and stats.array_digest(p.limit(0)) == hashlib.sha256().hexdigest()
    got = windows.running_before(p.repartition(7), ["idx"], "red").orderBy("idx").collect()
    assert [r["before"] for r in got] == [0, *np.cumsum(rgb[:, 0])[:-1].tolist()] and {r["__total"] for r in got} == {int(rgb[:, 0].sum())}


def test_manifest_verifiers(spark):
    h = "a" * 64
    person = lambda i, **own: {"image_id": f"i{i}", "person_mask_path": f"m/{i}.png", "source_image_path": "s/0.jpg", "person_mask_sha256": h, "source_image_sha256": h} | own
    model = {"model_identity": dict.fromkeys(manifests.SEGMENTER, "x") | {"weights_sha256": h}}
    check = lambda kind, rows, more=model: manifests.verify_manifest(spark, scalar.signed({manifests.LISTS[kind]: rows} | more, manifests.SIGNATURES[kind]), kind)
    check("person", [person(0), person(1)])  # images may share a source
    check("mask", [{"image_id": 1, "combined_mask_path": "a"}, {"image_id": 2, "combined_mask_path": "b"}])
    check("depth", [{"image_id": "1", "path": "a"}])
    check("review", [{"image_id": "1", "status": "PASS"}, {"image_id": "2", "status": "FAIL"}])
    manifests.verify_manifest(spark, scalar.signed({"images": []}, "manifest_sha256"), "dataset")
    bad = [
        ("mask", [{"image_id": 1, "combined_mask_path": "a"}, {"image_id": 2, "combined_mask_path": "a"}]), ("mask", [{"image_id": 1}]), ("mask", []), ("depth", [{"path": "a"}]),
        ("depth", [{"image_id": "1", "path": "a"}, {"image_id": "1", "path": "b"}]), ("review", [{"image_id": "1", "status": "MAYBE"}]), ("review", [{"image_id": "1", "status": None}]),
        *[("person", [person(0), person(1, **own)]) for own in ({"image_id": "i0"}, {"person_mask_path": "m/0.png"}, {"source_image_path": "../s"}, {"source_image_path": "."}, {"person_mask_path": "c:\\m"}, {"source_image_sha256": h[1:]}, {"person_mask_sha256": "g" + h[1:]})],
    ]
    for kind, rows in bad:
        with pytest.raises(ValueError):
            check(kind, rows)
    with pytest.raises(ValueError):
        manifests.verify_manifest(spark, {"images": [person(0)], "person_mask_manifest_sha256": h} | model, "person")
    for more in ({}, {"model_identity": {"weights_sha256": h}}, {"model_identity": model["model_identity"] | {"weights_sha256": h[1:]}}):
        with pytest.raises(ValueError):
            check("person", [person(0)], more)


def test_record_violations_by_manifest(spark):
    rows = spark.createDataFrame([("a", "1", "p"), ("a", "2", "p"), ("b", "1", "p"), ("b", None, "q"), ("b", "", "r")], "m string, image_id string, path string")
    got = {tuple(r) for r in manifests.record_violations(rows, "depth", ["m"]).collect()}
    assert got == {("a", "path", "p", "repeated"), ("b", "image_id", "", "missing")}
    assert manifests.record_violations(rows.limit(0), "depth", ["m"]).count() == 0
    lacking = {(r.m, r.field) for r in manifests.record_violations(rows, "mask", ["m"]).collect() if r.problem == "missing"}
    assert lacking == {("a", "combined_mask_path"), ("b", "combined_mask_path"), ("b", "image_id")}
