"""Exports of posed images: a reconstruction's text tables and transforms.json; configuration files. The single files that
other tools read are written by the driver, bounded by `most`; the same as folders of files (the *_parts functions) is written
by tasks, for any number of frames, and read by the same functions."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import stats, windows
from . import staged
from .sinks import atomic_bytes

INTRINSICS = ["w", "h", "fl_x", "fl_y", "cx", "cy", "k1", "k2", "k3", "k4"]
MODEL = "OPENCV_FISHEYE"
_POSE = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]


def model_tables(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames (path, m: camera to world, y down, INTRINSICS) -> (cameras: camera_id, INTRINSICS; images: image_id, the pose
    from world to camera, camera_id, name), ids from 1 in path order, one camera for each set of intrinsics."""
    placed = windows.numbered(frames, ["path"], "image_id").withColumn("image_id", F.col("image_id") + 1)
    ids = stats.first_seen_ids(placed, INTRINSICS, "image_id", "camera_id").withColumn("camera_id", F.col("camera_id") + 1)
    seen = [placed[c].eqNullSafe(ids[c]) for c in INTRINSICS]
    placed, w = placed.withColumn("__inverse", geometry.inverse(F.col("m"))), F.col("__inverse")
    q = geometry.rotation_to_quaternion(geometry.rotation_of(w))
    posed = placed.join(ids, seen).select("image_id", "camera_id", F.replace("path", F.lit("/"), F.lit("_")).alias("name"), q.alias("q"), geometry.translation_of(w).alias("t"))
    images = posed.select("image_id", *[F.col("q")[k].alias(f"q{k}") for k in "wxyz"], *[F.col("t")[i].alias(n) for i, n in enumerate(("tx", "ty", "tz"))], "camera_id", "name")
    return ids.select("camera_id", *INTRINSICS), images


def _bounded(df: DataFrame, order: str, most: int) -> list:
    rows = df.orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def _camera_line(r) -> str:
    return " ".join([str(r["camera_id"]), MODEL, str(int(r["w"])), str(int(r["h"])), *(f"{r[c]:.12g}" for c in INTRINSICS[2:])])


def _image_line(r) -> str:
    return " ".join([str(r["image_id"]), *(f"{r[c]:.12g}" for c in _POSE), str(r["camera_id"]), r["name"]])


def write_model_text(frames: DataFrame, folder: str, most: int = 100_000) -> None:
    """cameras.txt and images.txt (each image is followed by an empty line: no observations)."""
    cameras, images = model_tables(frames)
    lines = ["# CAMERA_ID MODEL WIDTH HEIGHT PARAMS[]", *map(_camera_line, _bounded(cameras, "camera_id", most))]
    atomic_bytes(os.path.join(folder, "cameras.txt"), ("\n".join(lines) + "\n").encode())
    lines = [x for r in _bounded(images, "image_id", most) for x in (_image_line(r), "")]
    atomic_bytes(os.path.join(folder, "images.txt"), ("\n".join(lines) + "\n").encode())


def write_model_parts(frames: DataFrame, folder: str) -> None:
    """cameras.txt and images.txt as folders of text files, in the order of ids."""
    cameras, images = model_tables(frames)

    def text(line, end):
        def lines(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"value": pa.array([line(r) + end for r in b.to_pylist()], pa.string())})

        return lines

    cameras.orderBy("camera_id").mapInArrow(text(_camera_line, ""), "value string").write.text(f"{folder}/cameras.txt")
    images.orderBy("image_id").mapInArrow(text(_image_line, "\n"), "value string").write.text(f"{folder}/images.txt")


def _up(frames: DataFrame) -> DataFrame:
    return frames.select("path", *INTRINSICS, geometry.gl_to_cv(F.col("m")).alias("m"))


def _transforms(rows, ply: str | None) -> bytes:
    out = [{"file_path": r["path"], **{c: r[c] for c in INTRINSICS}, "camera_model": MODEL, "transform_matrix": [list(r["m"][i : i + 4]) for i in range(0, 16, 4)]} for r in rows]
    return json.dumps({"camera_model": MODEL, "frames": out} | ({"ply_file_path": ply} if ply else {}), indent=2, allow_nan=False).encode()


def write_transforms(frames: DataFrame, path: str, ply: str | None = None, most: int = 100_000) -> None:
    """transforms.json: each frame's intrinsics and its camera-to-world pose, y up, by path."""
    atomic_bytes(path, _transforms(_bounded(_up(frames), "path", most), ply))


def write_transforms_parts(frames: DataFrame, folder: str, ply: str | None = None, part: int = 10_000) -> None:
    """A folder of files like transforms.json of up to `part` frames each, by path from file to file, and its manifest."""

    def documents(batches):
        rows, n = [], 0

        def document():
            name = f"transforms-{TaskContext.get().partitionId():05d}-{n:05d}.json"
            return pa.RecordBatch.from_pydict({"name": [name], "content": pa.array([_transforms(rows[:part], ply)], pa.binary())})

        for b in batches:
            rows += b.to_pylist()
            while len(rows) >= part:
                yield document()
                rows, n = rows[part:], n + 1
        if rows:
            yield document()

    staged.write_files(_up(frames).orderBy("path").mapInArrow(documents, "name string, content binary"), folder)


def config(spark: SparkSession, path: str, known: Sequence[str]) -> dict:
    """A configuration file: a JSON object with no keys but the known ones."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError("a configuration is a JSON object")
    if odd := sorted(set(value) - set(known)):
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    return value
