import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import geometry, scalar
from kelpie.operators import voxel
from kelpie.sources import capture, clouds, sinks
from kelpie.streaming import voxels


def las_file(path, xyz, rgb):
    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<HI", head, 105, 26, len(xyz))
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 1.0, 2.0, 3.0)
    body = np.zeros((len(xyz), 26), np.uint8)
    body[:, :12] = np.round((xyz - [1, 2, 3]) / 0.001).astype("<i4").view(np.uint8).reshape(-1, 12)
    body[:, 20:] = rgb.astype("<u2").view(np.uint8).reshape(-1, 6)
    path.write_bytes(bytes(head) + body.tobytes())


def test_las_and_ply(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz, rgb = rng.uniform(-2, 2, (1000, 3)).round(3), rng.integers(0, 65536, (1000, 3))
    las_file(tmp_path / "a.las", xyz, rgb)
    p = clouds.las(spark, str(tmp_path / "a.las"), rows=300)
    got = p.orderBy("idx").toPandas()
    assert np.allclose(got[["x", "y", "z"]], xyz, atol=1e-6) and (got[["red", "green", "blue"]].to_numpy() == rgb).all()
    assert clouds.colour_mode(p) == "uint16"
    coloured = p.withColumns({c: scalar.rgb_to_bytes(F.col(c), False) for c in ("red", "green", "blue")})
    cells = voxel.representatives(coloured.select("idx", "x", "y", "z"), 1.0, (-2.0, -2.0, -2.0)).join(coloured.select("idx", "red", "green", "blue"), "idx")
    n = clouds.write_ply(cells, str(tmp_path / "b.ply"))
    back = clouds.ply(spark, str(tmp_path / "b.ply"))
    assert back.count() == n == cells.count() and clouds.load_xyz(spark, str(tmp_path / "a.las"), 100).count() == 100
    assert sinks.write_points3d(cells, str(tmp_path / "points3D.bin")) == n
    (tmp_path / "c.ply").write_bytes((tmp_path / "b.ply").read_bytes() + b"x")
    with pytest.raises(Exception, match="canonical"):
        clouds.ply(spark, str(tmp_path / "c.ply")).count()


def test_scans_and_loader(spark, tmp_path):
    rng = np.random.default_rng(2)
    xyz, rgb = rng.uniform(-2, 2, (500, 3)).round(3), rng.integers(0, 200, (500, 3))
    rgb[:20] = 0
    at = tmp_path / "a.las"
    las_file(at, xyz, rgb)
    raw = bytearray(at.read_bytes())
    struct.pack_into("<6d", raw, 179, *(v for a in range(3) for v in (xyz[:, a].max(), xyz[:, a].min())))
    at.write_bytes(raw)
    got, pooled = clouds.las_scan(spark, str(at)), np.sort(rgb.ravel())
    figures = {"n": 1500, "min": 0, "median": pooled[749], "p99": pooled[1484], "max": pooled[-1], "mode": "uint8"}
    assert got["n_points"] == 500 and np.allclose(got["bounds_min"], xyz.min(0)) and got["colours"] == figures
    p = clouds.las(spark, str(at))
    by = {r["channel"]: r for r in clouds.channel_colours(p).collect()}
    assert all((by[c]["median"], by[c]["max"]) == (np.sort(rgb[:, i])[249], rgb[:, i].max()) for i, c in enumerate(clouds.CHANNELS))
    s = clouds.scan_summary(p).first()
    assert s["black_fraction"] == 0.04 and np.isclose(s["extent_x"], np.ptp(xyz[:, 0]))
    assert clouds.scan_summary(p.limit(0)).first()["black_fraction"] == 0.0
    assert clouds.pooled_colours(p.limit(0)).first().asDict() == {"n": 0, "min": 180, "median": 180, "p99": 180, "max": 180, "mode": "none"}
    at.write_bytes(bytes(raw[:-1]))
    with pytest.raises(ValueError, match="room for 499"):
        clouds.las_scan(spark, str(at))
    struct.pack_into("<d", raw, 179, 0.0)
    at.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="bounds"):
        clouds.las_scan(spark, str(at))

    np.save(tmp_path / "a.npy", xyz)
    np.savez(tmp_path / "a.npz", xyz=xyz, other=rgb)
    for name in ("a.npy", "a.npz"):
        rows = clouds.load_xyz(spark, str(tmp_path / name), 100).orderBy("idx").collect()
        assert np.array_equal([[r[a] for a in "xyz"] for r in rows], xyz[::5])
    np.save(tmp_path / "flat.npy", xyz.ravel())
    np.save(tmp_path / "none.npy", xyz[:0])
    for name, said in (("flat.npy", "shape"), ("none.npy", "empty"), ("a.laz", "laz")):
        with pytest.raises(Exception, match=said):
            clouds.load_xyz(spark, str(tmp_path / name))


def test_search_and_merge(spark):
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(4000, 3)))], "idx long, x double, y double, z double")
    size, passes = voxel.search_size(p, 300)
    cells = voxel.occupied(p, size, [voxel.bounds(p).first()[f"min_{a}"] for a in "xyz"])
    assert cells <= 300 and (cells >= 270 or len(passes) > 32)
    voxel.check_budget(cells, 300, 350)
    with pytest.raises(ValueError):
        voxel.check_budget(301, 300, 350)


def test_capture_files(spark, tmp_path):
    cam = {"name": "left", "type": "fisheye", "width": 64, "height": 64, "intrinsic": {"fl_x": 20, "fl_y": 20, "cx": 31.5, "cy": 31.5},
           "distortion": {"camera_model": "KB4", "params": {"k1": 0.02, "k2": -0.003, "k3": 0.0002, "k4": 0}},
           "transform_from_lidar": {"rotation": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "position": [0, 0, 0]}}
    (tmp_path / "cal.json").write_text(json.dumps({"cameras": [cam, cam | {"name": "right"}]}))
    assert [r["side"] for r in capture.cameras(spark, str(tmp_path / "cal.json")).collect()] == ["left", "right"]
    (tmp_path / "one.json").write_text(json.dumps({"cameras": [cam]}))
    with pytest.raises(ValueError):
        capture.cameras(spark, str(tmp_path / "one.json"))
    line = lambda p, w: f"{p} 1 2 3 0 0 0 0 0 0 {w} 5"
    (tmp_path / "pose.txt").write_text("\n".join([" ".join(capture.POSE_COLUMNS), line("left/扫 描/100.jpg", 1), line("right/扫 描/150.jpg", -2)]))
    got = capture.poses(spark, str(tmp_path / "pose.txt")).orderBy("side").collect()
    assert [(r["path"], r["side"], r["timestamp_ns"], r["m"][3]) for r in got] == [("left/扫 描/100.jpg", "left", 100, 1.0), ("right/扫 描/150.jpg", "right", 150, 1.0)]
    loose = lambda *lines: capture.poses(spark, str(tmp_path / "loose.txt"), strict=False) if (tmp_path / "loose.txt").write_text("\n".join(["any header", *lines])) else None
    got = loose(line("left/100.jpg", 1) + " 7 8 more", line("right\\150.jpg", -2)).orderBy("side").collect()
    assert [(r["path"], r["side"], r["timestamp_ns"], r["m"][3]) for r in got] == [("left/100.jpg", "left", 100, 1.0), ("right/150.jpg", "right", 150, 1.0)]
    with pytest.raises(ValueError):
        loose("left/100.jpg 1 2 3 0 0 0 0 0 0 1")
    with pytest.raises(ValueError):
        loose("left/100.jpg 1 2 3 0 0 0 0 0 0 one 5")
    pairs = spark.createDataFrame([("b", "c"), ("a", "b")], "a string, b string")
    capture.write_pair_list(pairs, str(tmp_path / "pairs"))
    assert sorted(map(tuple, capture.pair_list(spark, str(tmp_path / "pairs")).collect())) == [("a", "b"), ("b", "c")]
    las_file(tmp_path / "x_colorized.las", np.zeros((1, 3)), np.zeros((1, 3)))
    las_file(tmp_path / "x_ecef_colorized.las", np.zeros((1, 3)), np.zeros((1, 3)))
    assert capture.find_cloud(capture.inventory(spark, str(tmp_path)), str(tmp_path)).endswith("/x_colorized.las")
    m = [[1.0, 0, 0, 7], [0, 1, 0, 8], [0, 0, 1, 9], [0, 0, 0, 1]]
    (tmp_path / "t.json").write_text(json.dumps({"frames": [{"file_path": "a.png", "transform_matrix": m}]}))
    r = capture.transforms(spark, str(tmp_path / "t.json")).first()
    assert r["m"][5] == -1 and r["m"][3] == 7


def test_manifest(tmp_path):
    path = sinks.write_manifest({"b": 1, "a": "é"}, str(tmp_path / "m"))
    m = json.loads(open(path).read())
    scalar.verify(m)
    with pytest.raises(ValueError):
        scalar.verify(m | {"b": 2})
    with pytest.raises(FileExistsError):
        sinks.write_manifest({}, str(tmp_path / "m"))


def test_rotations(spark):
    df = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.3)).alias("v"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("p"))
    r = df.select(geometry.about_pivot(F.col("v"), F.array(*map(F.lit, (0.0, 0.0, 0.0))), F.col("p")).alias("m"), "p")
    got = r.select(geometry.is_rigid(F.col("m")).alias("ok"), geometry.to_camera(F.col("p"), F.col("m")).alias("c")).first()
    assert got["ok"] and abs(got["c"][0] - 1) < 1e-9 and abs(got["c"][1]) < 1e-9


def test_stream(spark, tmp_path):
    p = spark.createDataFrame([(i, i * 0.01 % 1, 0.5, 0.5) for i in range(400)], "idx long, x double, y double, z double")
    for k in range(2):
        p.filter(F.col("idx") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = voxels.stream_representatives(s, 0.25, (0.0, 0.0, 0.0)).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, voxel.representatives(p, 0.25, (0.0, 0.0, 0.0)).collect()))


def test_pose_files_are_strict(spark, tmp_path):
    line = lambda p: f"{p} 1 2 3 0 0 0 0 0 0 1 5"
    head = " ".join(capture.POSE_COLUMNS)

    def read(lines, **more):
        (tmp_path / "p.txt").write_text("\n".join(lines))
        return capture.poses(spark, str(tmp_path / "p.txt"), **more).collect()

    assert [(r["path"], r["side"]) for r in read([head, line("right/7.jpg"), line("left/9.jpg")])] == [("left/9.jpg", "left"), ("right/7.jpg", "right")]
    for bad in ([line("left/9.jpg"), head], [head, line("leftover/right/9.jpg")]):
        with pytest.raises(ValueError):
            read(bad)
    have = spark.createDataFrame([("left/9.jpg",)], "path string")
    assert len(read([head, line("left/9.jpg")], images=have)) == 1
    with pytest.raises(ValueError, match="missing"):
        read([head, line("right/7.jpg")], images=have)


def test_cloud_names(spark):
    files = lambda *names: spark.createDataFrame([(f"file:/run/{n}",) for n in names], "path string")
    assert capture.find_cloud(files("a_colorized.las", "colorized.laz", "uncolorized.las"), "/run") == "file:/run/colorized.laz"
    assert capture.find_cloud(files("colorized_filtered.las", "b_uncolorized.las", "x_ecef_colorized.las"), "/run") == "file:/run/b_uncolorized.las"
    assert capture.find_cloud(files("sub/colorized.las"), "/run") is None
