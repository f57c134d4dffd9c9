"""Readers of capture folders: calibration, poses, transforms, model text, pair lists, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from ..operators.integrity import duplicates, require_none

CAMERA = (
    "cameras array<struct<name: string, type: string, width: int, height: int, intrinsic: struct<fl_x: double, fl_y: double, cx: double, cy: double>,"
    " distortion: struct<camera_model: string, params: struct<k1: double, k2: double, k3: double, k4: double>>,"
    " transform_from_lidar: struct<rotation: array<array<double>>, position: array<double>>>>"
)
#: Fixed value: the columns of a pose file, in order.
POSE_COLUMNS = ["index", "x", "y", "z", "roll", "pitch", "yaw", "qx", "qy", "qz", "qw", "timestamp"]


def cameras(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row for each camera with its side (left or right, from the name), sorted by side. strict: exactly one of each,
    no missing number."""
    raw = spark.read.schema(CAMERA).option("multiLine", True).json(path)
    c = raw.select(F.explode("cameras").alias("c")).select("c.*")
    out = c.withColumn("side", F.when(F.contains(F.lower("name"), F.lit("left")), "left").when(F.contains(F.lower("name"), F.lit("right")), "right"))
    if strict:
        sides = sorted(r["side"] or "" for r in out.select("side").collect())
        if sides != ["left", "right"]:
            raise ValueError(f"one left and one right camera are needed, not {sides}")
        numbers = F.array("intrinsic.fl_x", "intrinsic.fl_y", "intrinsic.cx", "intrinsic.cy", "distortion.params.k1", "distortion.params.k2", "distortion.params.k3", "distortion.params.k4")
        require_none(out.filter(F.exists(numbers, lambda x: x.isNull()) | F.col("width").isNull() | F.col("height").isNull()).select("name"), "cameras lack numbers")
    return out.orderBy("side")


def poses(spark: SparkSession, path: str, strict: bool = True, images: DataFrame | None = None) -> DataFrame:
    """A pose file (white space between POSE_COLUMNS, the first line its header) -> image_id, path, side (the path's first
    part), timestamp_ns (from the image's name), q, m (camera to world, 16 numbers), by path. index holds the image's path,
    which may have blanks; strict: it begins with left/ or right/. images (path): the image files that there must be.
    Not strict: any first line is a header (and so are lines that repeat it), a path has no blanks, and fields after the
    twelfth are ignored; lines of fewer, or with other text for a number, raise."""
    raw = spark.read.text(path)
    first = raw.first()
    if strict and (first is None or first[0].split() != POSE_COLUMNS):
        raise ValueError("the header differs")
    lines = raw.select(F.trim("value").alias("line")).filter("line <> ''")
    if strict:
        rows, form = lines.filter(~F.rlike("line", F.lit(r"^index\s+x\s"))), r"^(.*?)((?:\s+[-+0-9.eE]+){11})$"
    else:
        rows, form = lines.filter(F.col("line") != (first[0].strip(" ") if first else "")), r"^(\S+)((?:\s+[-+0-9.eE]+){11})(?:\s.*)?$"
    part = rows.select("line", F.regexp_extract("line", form, 1).alias("path"), F.split(F.trim(F.regexp_extract("line", form, 2)), r"\s+").alias("f"))
    require_none(part.filter(F.size("f") != 11).select("line"), "lines don't have 12 fields")
    n = lambda i: F.try_element_at("f", F.lit(i + 1)).cast("double")
    q = F.struct(n(6).alias("x"), n(7).alias("y"), n(8).alias("z"), n(9).alias("w"))
    out = part.select(
        scalar.normalised_path(F.col("path")).alias("path"), q.alias("q"), F.array(n(0), n(1), n(2)).alias("t"),
        F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).cast("bigint").alias("timestamp_ns"),
    )
    out = out.withColumn("m", geometry.transform(geometry.quaternion_to_rotation(F.col("q")), F.col("t")))
    if strict:
        require_none(out.filter("path is null or m is null").select("path"), "paths or rotations are invalid")
        require_none(duplicates(out, ["path"]), "paths repeat")
    part = F.substring_index("path", "/", 1)
    side = F.when(part.isin("left", "right"), part)
    if strict:
        require_none(out.filter(side.isNull()).select("path"), "paths don't begin with left/ or right/")
    if images is not None:
        require_none(out.join(images.select("path"), "path", "left_anti").select("path"), "images are missing")
    return out.orderBy("path").select(scalar.stable_id("img_", F.col("path")).alias("image_id"), "path", side.alias("side"), "timestamp_ns", "q", "m")


def transforms(spark: SparkSession, path: str) -> DataFrame:
    """transforms.json -> file_path, m (camera to world, y down), from its y-up matrices."""
    raw = spark.read.schema("frames array<struct<file_path: string, transform_matrix: array<array<double>>>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("frames").alias("f"))
    return f.select("f.file_path", geometry.gl_to_cv(F.flatten("f.transform_matrix")).alias("m"))


def model_images(spark: SparkSession, path: str) -> DataFrame:
    """images.txt of a reconstruction: the lines with ten fields (each is followed by one of observations)."""
    f = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.split(F.trim("value"), " ").alias("f"))
    rows = f.filter((F.size("f") == 10) & F.rlike(F.col("f")[9], F.lit("[A-Za-z]")))
    kinds = ["int", *["double"] * 7, "int", "string"]
    names = ["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"]
    return rows.select(*[F.col("f")[i].cast(k).alias(n) for i, (k, n) in enumerate(zip(kinds, names, strict=True))])


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).filter("trim(value) <> ''").select("value", F.split(F.trim("value"), r"\s+").alias("f"))
    require_none(f.filter(F.size("f") != 2).select("value"), "lines don't have two names")
    return f.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


def write_pair_list(pairs: DataFrame, path: str) -> None:
    require_none(pairs.filter(F.rlike("a", F.lit(r"\s")) | F.rlike("b", F.lit(r"\s"))), "names have white space")
    pairs.select(F.concat_ws(" ", "a", "b").alias("value")).orderBy("value").write.text(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path, kind (extension), bytes, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


#: Names a point cloud is looked for by, best first; then any colorised, then any uncolorised file.
CLOUD_NAMES = ["colorized.las", "colorized.laz", "uncolorized.las"]


def find_cloud(files: DataFrame, folder: str) -> str | None:
    """The path of the best local-frame point cloud of an inventory that lies in folder itself."""
    name, parent = F.substring_index("path", "/", -1), F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^file:/+", "/")
    fixed = F.nullif(F.array_position(F.array(*map(F.lit, CLOUD_NAMES)), name), F.lit(0).cast("bigint"))
    other = F.when(F.contains(F.lower(name), F.lit("ecef")), None).when(F.endswith(name, F.lit("_colorized.las")), 10).when(F.endswith(name, F.lit("_uncolorized.las")), 11)
    here = files.filter(parent == "/" + folder.removeprefix("file:").strip("/"))
    best = here.select("path", F.coalesce(fixed, other.cast("bigint")).alias("o")).filter("o is not null").orderBy("o", "path").first()
    return best["path"] if best else None
