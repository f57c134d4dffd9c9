"""Files written in stages, resumed runs, digests, array files and masks."""

import hashlib
import io
import json
import os
import random
import resource
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.sources import arrays, staged


def rows(spark, names, bad=()):
    df = spark.createDataFrame([(n, f"content of {n}".encode(), i) for i, n in enumerate(names)], "name string, content binary, k int").repartition(4, "name")
    if bad:
        df = df.withColumn("content", F.when(F.col("name").isin(*bad), F.raise_error("broken").cast("binary")).otherwise(F.col("content")))
    return df


def listing(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_manifest_comes_last(spark, tmp_path):
    path = str(tmp_path / "out")
    names = [f"a/{i}.bin" for i in range(9)] + ["b.bin"]
    manifest = staged.write_files(rows(spark, names), path, meta={"kind": "test"})
    assert listing(path) == sorted([*names, "manifest.json"]) and manifest["kind"] == "test"
    assert [r["name"] for r in manifest["files"]] == sorted(names)
    for r in manifest["files"]:
        raw = (tmp_path / "out" / r["name"]).read_bytes()
        assert raw == f"content of {r['name']}".encode() and r["sha256"] == hashlib.sha256(raw).hexdigest() and r["bytes"] == len(raw) and names[r["k"]] == r["name"]
    with pytest.raises(Exception, match="isn't empty"):
        staged.write_files(rows(spark, ["c.bin"]), path)
    again = staged.write_files(rows(spark, ["c.bin"]), path, force=True)
    assert listing(path) == ["c.bin", "manifest.json"] and len(again["files"]) == 1
    now = lambda: staged.changed_files(staged.file_digests(spark, path), again)
    assert now().count() == 0
    (tmp_path / "out" / "c.bin").write_bytes(b"other")
    (tmp_path / "out" / "d.bin").write_bytes(b"")
    assert {tuple(r) for r in now().collect()} == {("c.bin", "changed"), ("d.bin", "unlisted")}
    raw = (tmp_path / "out" / "manifest.json").read_bytes()
    (tmp_path / "out" / "manifest.json").write_bytes(raw.replace(b"c.bin", b"e.bin"))
    with pytest.raises(ValueError, match="signature"):
        staged.read_manifest(path)


def test_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        staged.write_files(rows(spark, [f"{i}.bin" for i in range(20)], bad=["7.bin"]), path)
    assert listing(path) == []
    for name in ("../x", "/x", "a/../b", "a\\b", "", "manifest.json", ".x", "C:/x", None):
        with pytest.raises(Exception, match="unsafe name"):
            staged.write_files(rows(spark, ["ok.bin"]).withColumn("name", F.lit(name).cast("string")), path)
    with pytest.raises(Exception, match="repeat"):
        staged.write_files(rows(spark, ["a.bin"]).unionByName(rows(spark, ["a.bin"])), path)
    assert listing(path) == []
    empty = staged.write_files(rows(spark, ["a.bin"]).limit(0), path)
    assert empty["files"] == [] and listing(path) == ["manifest.json"]


def test_resumed_run_takes_what_is_missing(spark, tmp_path):
    path, identity = str(tmp_path / "out"), staged.identity_of(inputs="abc", size=3)
    names = [f"{i}.bin" for i in range(20)]
    # The bad row comes last, when other tasks have finished.
    late = spark.sparkContext.parallelize([(n, bytearray(f"content of {n}".encode()), i) for i, n in enumerate(names)], 20).toDF("name string, content binary, k int")
    late = late.withColumn("content", F.when(F.col("k") == 19, F.raise_error("broken").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        staged.write_files(late, path, identity, resume=True)
    assert "manifest.json" not in listing(path) and "ledger.json" in listing(path)
    first = staged.read_manifest(path, staged.LEDGER)["files"]
    before = {r["name"]: os.stat(os.path.join(path, r["name"])).st_mtime_ns for r in first}
    assert 0 < len(first) < 20
    rest = staged.pending(rows(spark, names), path, identity)
    assert {r["name"] for r in rest.collect()} == set(names) - set(before)
    # A run whose driver is lost leaves its staging; what its tasks finished is adopted, the rest goes.
    for folder, note in (("x", True), ("y", False)):
        own = tmp_path / "out" / ".staging-lost" / folder
        own.mkdir(parents=True)
        (own / "0").write_bytes(b"content of 19.bin")
        if note:
            record = {"name": "19.bin", "k": 19, "bytes": 17, "sha256": hashlib.sha256(b"content of 19.bin").hexdigest()}
            (own / "finished.json").write_text(json.dumps({"identity": identity, "files": [[str(own / "0"), record]]}))
    rest = staged.pending(rows(spark, names), path, identity)
    assert {r["name"] for r in rest.collect()} == set(names) - set(before) - {"19.bin"}
    assert not (tmp_path / "out" / ".staging-lost").exists()
    with pytest.raises(ValueError, match="other inputs"):
        staged.pending(rows(spark, names), path, "another")
    with pytest.raises(Exception, match="other inputs"):
        staged.write_files(rest, path, "another", resume=True)
    (tmp_path / "out" / "foreign.bin").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown files"):
        staged.write_files(rest, path, identity, resume=True)
    os.unlink(tmp_path / "out" / "foreign.bin")
    manifest = staged.write_files(rest, path, identity, resume=True)
    assert [r["name"] for r in manifest["files"]] == sorted(names) and listing(path) == sorted([*names, "manifest.json"])
    assert all(os.stat(os.path.join(path, n)).st_mtime_ns == t for n, t in before.items())
    with pytest.raises(Exception, match="is complete"):
        staged.write_files(rest, path, identity, resume=True)
    with pytest.raises(Exception, match="exclude"):
        staged.write_files(rest, path, identity, resume=True, force=True)


def test_digest_of_a_large_file(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(1 << 30)
    own = hashlib.sha256()
    for _ in range(1 << 8):
        own.update(bytes(1 << 22))
    reader = staged.DigestReader({"path": str(big)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert list(reader.read(reader.partitions()[0])) == [("big.bin", 1 << 30, own.hexdigest())]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in staged.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (1 << 30, own.hexdigest()), "empty.bin": (0, hashlib.sha256().hexdigest())}


def test_array_files(spark, tmp_path):
    one = {"b": np.arange(5, dtype="<i4"), "a": np.array([[1.5, 2.0]], "<f4")}
    raw = arrays.npz_bytes(one)
    assert raw == arrays.npz_bytes(dict(reversed(one.items())))
    with np.load(io.BytesIO(raw)) as z:
        assert z.files == ["a", "b"] and (z["b"] == one["b"]).all() and z["a"].shape == (1, 2)
    with pytest.raises(ValueError, match="unsafe"):
        arrays.npz_bytes({"a/b": one["b"]})
    good = (1, [4, 4], [0, 3, 15], [1.0, 2.0, 3.5], [0.5, 1.0, 0.1], [7, 8, 1 << 40], [1, 2, 3])
    bad = [
        (2, [4], [0], [1.0], [0.5], [1], [1]), (3, [4, 4], [0, 1], [1.0], [0.5, 0.5], [1, 1], [1, 1]), (4, [4, 4], [16], [1.0], [0.5], [1], [1]),
        (5, [4, 4], [3, 3], [1.0, 1.0], [0.5, 0.5], [1, 1], [1, 1]), (6, [4, 4], [0], [float("inf")], [0.5], [1], [1]), (7, [4, 4], [0], [1.0], [1.5], [1], [1]), (8, [4, 4], [], [], [], [], []),
    ]
    df = spark.createDataFrame([good, *bad], "i int, shape array<int>, pixel_index array<int>, range_m array<double>, confidence array<double>, source_index array<long>, support_count array<int>")
    path = str(tmp_path / "npz")
    staged.write_files(arrays.npz_files(df, F.concat(F.lit("d/"), F.col("i"), F.lit(".npz")), arrays.SPARSE, ["i"]), path)
    back = arrays.sparse_depth(spark, path)
    assert back.count() == 8
    problems = {r["path"]: r["problem"] for r in arrays.sparse_problems(back).collect()}
    assert problems == {f"d/{i}.npz": p for i, p in zip(range(2, 8), ("shape", "length", "pixel", "order", "range", "confidence"))}
    pixels = arrays.sparse_pixels(back.filter("path = 'd/1.npz'")).orderBy("py", "px").collect()
    assert [(r["px"], r["py"], r["distance"], r["source"], r["support"]) for r in pixels] == [(0, 0, 1.0, 7, 1), (3, 0, 2.0, 8, 2), (3, 3, 3.5, 1 << 40, 3)]
    with pytest.raises(Exception, match="missing arrays: other"):
        arrays.npz(spark, path, "path string, other array<int>").collect()


def filtered(pixels, ways):
    """A grey PNG whose rows use the given filters, by the format's definition."""
    out, above = [], [0] * pixels.shape[1]
    for way, row in zip(ways, pixels.tolist()):
        coded = [way]
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((v - [0, a, b, (a + b) // 2, near][way]) % 256)
        out.append(bytes(coded))
        above = row
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    raw = zlib.compress(b"".join(out))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", raw[:5]) + part(b"IDAT", raw[5:]) + part(b"IEND", b"")


def test_grey_images():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 5), (40, 33)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        smooth = (np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 256).astype(np.uint8)
        for p in (x, smooth, np.zeros(shape, np.uint8), np.full(shape, 255, np.uint8)):
            assert (arrays.read_png_grey(arrays.png_grey(p)) == p).all() and arrays.png_grey(p) == arrays.png_grey(p.copy())
            assert (arrays.read_png_grey(filtered(p, [i % 5 for i in range(shape[0])])) == p).all()
    raw = bytearray(arrays.png_grey(x))
    raw[40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        arrays.read_png_grey(bytes(raw))
    with pytest.raises(ValueError, match="not a PNG"):
        arrays.read_png_grey(b"x" * 20)


def test_masks_are_shared(spark, tmp_path):
    rng = random.Random(2)
    pixels = [("L", rng.randrange(20), rng.randrange(10)) for _ in range(50)]
    masks = spark.createDataFrame([*pixels, pixels[0]], "camera string, px int, py int")
    images = spark.createDataFrame([("i1", "L"), ("i2", "L"), ("i3", "empty")], "image string, camera string")
    path = str(tmp_path / "masks")
    manifest = staged.write_files(arrays.mask_files(masks, images, 20, 10), path)
    by = {r["image"]: r for r in manifest["files"]}
    assert by["i1"]["sha256"] == by["i2"]["sha256"] != by["i3"]["sha256"] and by["i3"]["valid_fraction"] == 0
    assert abs(by["i1"]["valid_fraction"] - len(set(pixels)) / 200) < 1e-12
    got = {(r["name"], r["px"], r["py"]) for r in arrays.mask_pixels(spark, path).collect()}
    assert got == {(f"i{i}.png", x, y) for i in (1, 2) for _, x, y in pixels}
