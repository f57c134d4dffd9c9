"""Checks of manifests against each other and against what they list, and of what a solver stage may change."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from .integrity import duplicates, key_set_difference, require_none, unsafe_path

#: The frame that a model is trained in, and the parameters of a camera that each solver stage leaves alone.
IDENTITY = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
COORDINATES = {
    "schema_version": 1, "algorithm_version": "s1_local_identity_v1", "source_frame": "s1_local", "model_frame": "s1_local", "units": "metres",
    "normalization_applied": False, "model_from_source": IDENTITY, "source_from_model": IDENTITY,
}
PARAMETERS = ["fl_x", "fl_y", "cx", "cy", "k1", "k2", "k3", "k4"]
FIXED = {1: PARAMETERS, 2: ["cx", "cy", "k1", "k2", "k3", "k4"], 3: ["cx", "cy", "k3", "k4"]}


def coordinate_manifest(dataset_sha256: str) -> dict:
    """The signed statement that the model's frame is the dataset's, in metres and not normalised."""
    if len(dataset_sha256) != 64 or set(dataset_sha256.lower()) - set("0123456789abcdef"):
        raise ValueError("a SHA-256 has 64 hexadecimal digits")
    return scalar.signed(COORDINATES | {"dataset_manifest_sha256": dataset_sha256}, "coordinate_transform_sha256")


def verify_coordinates(manifest: dict, dataset_sha256: str) -> None:
    if manifest != coordinate_manifest(dataset_sha256):
        raise ValueError("the coordinates aren't the dataset's own, or the signature doesn't match")


def unbound(manifests: DataFrame, bindings: DataFrame) -> DataFrame:
    """manifests (name, sha256), bindings (name, refers, sha256) -> the bindings whose hash isn't that of the manifest they
    refer to, with the hash found (null where there is no such manifest)."""
    found = manifests.select(F.col("name").alias("refers"), F.col("sha256").alias("found"))
    return bindings.join(found, "refers", "left").filter(~F.col("sha256").eqNullSafe(F.col("found"))).select("name", "refers", "sha256", "found")


def pose_set_violations(images: DataFrame) -> DataFrame:
    """images (image_id, rig_id, side, m) -> (key, problem): empty or repeated image ids, poses that aren't rigid, sides
    other than left and right, and rigs that lack one of them."""
    key = F.col("image_id").cast("string")
    named = lambda rows, column, problem: rows.select(F.col(column).cast("string").alias("key"), F.lit(problem).alias("problem"))
    empty = named(images.filter(key.isNull() | (key == "")), "image_id", "empty_image")
    twice = named(duplicates(images.filter(key != ""), ["image_id"]), "image_id", "repeated_image")
    skewed = named(images.filter(~F.coalesce(geometry.is_rigid(F.col("m")), F.lit(False))), "image_id", "not_rigid")
    odd = named(images.filter(~F.coalesce(F.col("side").isin("left", "right"), F.lit(False)) | F.col("rig_id").isNull()), "image_id", "invalid_side")
    sides = images.filter(F.col("rig_id").isNotNull()).groupBy("rig_id").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    partial = named(sides.filter("l = 0 or r = 0"), "rig_id", "incomplete_rig")
    return empty.unionByName(twice).unionByName(skewed).unionByName(odd).unionByName(partial)


def verify_decision(report: dict, signature: str, decision: str, published: str, names: tuple[str, str]) -> None:
    """A signed report whose decision must be what its gates say: names are what is published if all pass, and if not."""
    scalar.verify(report, signature)
    passed = all(g.get("status") == "PASS" for g in report.get("gates", {}).values())
    if report.get(decision) is not passed or report.get(published) != names[0 if passed else 1]:
        raise ValueError("the decision differs from the gates")


def verify_pose_set(images: DataFrame, counts: dict, curve: DataFrame, preserved: bool) -> None:
    """images as in pose_set_violations, the counts that the manifest states (image_count, rig_count), curve (rig_id) of
    corrections: no violation, the counts are right, the curve has each rig once, and the baseline was preserved."""
    require_none(pose_set_violations(images), "poses are invalid")
    found = images.agg(F.count("*").alias("image_count"), F.count_distinct("rig_id").alias("rig_count")).first().asDict()
    if not found["image_count"] or counts != found:
        raise ValueError(f"the counts are {found}")
    require_none(duplicates(curve, ["rig_id"]), "corrections repeat")
    require_none(key_set_difference(images.select("rig_id").distinct(), curve.select("rig_id"), ["rig_id"]), "corrections don't cover the rigs")
    if preserved is not True:
        raise ValueError("the baseline wasn't preserved")


#: Each kind of manifest's signature, where its records are, and what of them is unique, a relative path, a
#: SHA-256, or a decision.
SIGNATURES = {"dataset": "manifest_sha256", "mask": "mask_manifest_sha256", "depth": "depth_manifest_sha256", "person": "person_mask_manifest_sha256", "review": "person_mask_review_sha256"}
LISTS = {"mask": "images", "depth": "images", "person": "images", "review": "samples"}
UNIQUE = {"mask": ["image_id", "combined_mask_path"], "depth": ["image_id", "path"], "person": ["image_id", "person_mask_path"], "review": ["image_id"]}
PATHS = {"person": ["person_mask_path", "source_image_path"]}
HASHES = {"person": ["person_mask_sha256", "source_image_sha256"]}
DECISIONS = {"review": ["status"]}
#: What a person-mask manifest says of its segmenter.
SEGMENTER = {"runtime", "version", "architecture", "weights", "weights_sha256", "person_class_index"}


def record_violations(records: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """(*by, field, value, problem), each once, of the records of many manifests (by) of a kind: values that must be unique in
    their manifest and are repeated, missing or empty, unsafe_path, invalid_hash, invalid_status (neither PASS nor FAIL). A null is an
    empty text, a column that isn't there is null everywhere. Values that must be unique are counted, of the others only those
    that break a rule leave their task, so a manifest may hold any number of records."""
    by, c = by or [], F.col
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in records.columns else F.lit("")
    fields = dict.fromkeys(n for rules in (UNIQUE, PATHS, HASHES, DECISIONS) for n in rules.get(kind, []))
    one_of = lambda rules: c("field").isin(*rules.get(kind, [""]))
    rules = [
        (one_of(PATHS) & (unsafe_path(c("value")) | c("value").isin(".", "./")), "unsafe_path"), (one_of(HASHES) & ~F.rlike("value", F.lit("^[0-9a-fA-F]{64}$")), "invalid_hash"),
        (one_of(DECISIONS) & ~c("value").isin("PASS", "FAIL"), "invalid_status"),
    ]
    seen = records.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), text(n).alias("value")) for n in fields])).alias("f")).select(*by, "f.*")
    seen = seen.filter(one_of(UNIQUE) | reduce(or_, [broken for broken, _ in rules])).groupBy(*by, "field", "value").agg(F.count("*").alias("n"))
    problems = F.array(
        F.when(one_of(UNIQUE) & (c("value") == ""), "missing"), F.when(one_of(UNIQUE) & (c("value") != "") & (c("n") > 1), "repeated"),
        *[F.when(broken, problem) for broken, problem in rules],
    )
    return seen.select(*by, "field", "value", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def verify_manifest(spark: SparkSession, manifest: dict, kind: str) -> None:
    """A manifest's signature, that it lists something, its records, and of person masks the segmenter's fields and weights'
    hash. The manifest is one file, so it is on the driver."""
    scalar.verify(manifest, SIGNATURES[kind])
    if kind == "person":
        model = manifest.get("model_identity") or {}
        if lacking := SEGMENTER - set(model):
            raise ValueError(f"the segmenter lacks {sorted(lacking)}")
        if not re.fullmatch("[0-9a-fA-F]{64}", str(model["weights_sha256"])):
            raise ValueError("the weights' hash isn't a SHA-256")
    if kind not in LISTS:
        return
    records = manifest.get(LISTS[kind]) or []
    if not records:
        raise ValueError(f"the {kind} manifest lists nothing")
    fields = list(dict.fromkeys(n for rules in (UNIQUE, PATHS, HASHES, DECISIONS) for n in rules.get(kind, [])))
    rows = [tuple(None if r.get(n) is None else str(r[n]) for n in fields) for r in records]
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in fields))
    require_none(record_violations(table, kind), f"the {kind} manifest's records are invalid")


def image_masks(images: DataFrame, templates: DataFrame) -> DataFrame:
    """images (image_id, camera), templates (camera, path, sha256): each image with its camera's one mask, and by how many
    images that is shared. Cameras without a template, or with two, are errors."""
    require_none(duplicates(templates, ["camera"]), "templates repeat")
    uses = images.groupBy("camera").agg(F.count("*").alias("shared_by"))
    require_none(uses.join(templates, "camera", "left_anti").select("camera"), "cameras lack a template")
    return images.select("image_id", "camera").join(templates.select("camera", "path", "sha256").join(uses, "camera"), "camera")


def decided(images: DataFrame, decisions: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """images with their decision; raises where the keys of both sides differ, repeat or a decision isn't an allowed one."""
    require_none(duplicates(decisions, [key]), "decisions repeat")
    require_none(key_set_difference(images.select(key).distinct(), decisions.select(key), [key]), "decisions don't cover the images")
    require_none(decisions.filter(~F.coalesce(F.col("decision").isin(allowed), F.lit(False))).select(key, "decision"), "decisions are unknown")
    return images.join(decisions.select(key, "decision"), key)


#: How far a stage may move focal lengths (relative), k1 and k2, and what it leaves alone.
FOCAL_CHANGE, DISTORTION_CHANGE, FIXED_TOLERANCE = 0.05, 0.02, 1e-10


def stage_audit(
    before: DataFrame, after: DataFrame, key: str, stage: int, tolerance: float = FIXED_TOLERANCE, focal: float = FOCAL_CHANGE, distortion: float = DISTORTION_CHANGE
) -> DataFrame:
    """Cameras (key, PARAMETERS) before and after a solver stage -> focal (largest relative change), fixed (largest change of
    what the stage leaves alone) and passed. Both sides must have the same cameras and finite numbers."""
    require_none(key_set_difference(before, after, [key]), "cameras differ")
    for side in (before, after):
        require_none(side.filter(F.exists(F.array(*PARAMETERS), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v) == float("inf")))).select(key), "parameters must be finite")
    both = before.select(key, *[F.col(p).cast("double").alias(f"b_{p}") for p in PARAMETERS]).join(after.select(key, *[F.col(p).cast("double").alias(f"a_{p}") for p in PARAMETERS]), key)
    moved = {p: F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) for p in PARAMETERS}
    share = F.greatest(*[moved[p] / F.greatest(F.abs(F.col(f"b_{p}")), F.lit(1e-12)) for p in ("fl_x", "fl_y")])
    out = both.select(key, share.alias("focal"), F.greatest(*[moved[p] for p in FIXED[stage]]).alias("fixed"), F.greatest(moved["k1"], moved["k2"]).alias("distortion"))
    return out.withColumn("passed", (F.col("fixed") <= tolerance) & (F.col("focal") <= focal) & (F.col("distortion") <= distortion))
