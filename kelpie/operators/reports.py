"""Acceptance reports put together from the other operators: bundle adjustment, pose refinement, review repair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from . import gates, integrity, joins, manifests, stats
from .windows import review_sample

#: What a bundle adjustment may change at most, and what it must gain.
IMPROVEMENT, SCALE_DRIFT, RIG_METRES, RIG_DEGREES = 0.30, 0.005, 1e-6, 1e-4
#: The names of a bundle report's gates, and of the policy's limits.
BUNDLE_GATES = ("solver_success", "reprojection_p50_improvement", "rig_baseline_fixed", "scene_scale_fixed", "camera_parameter_bounds")
POLICY = {
    "minimum_reprojection_p50_improvement_fraction": IMPROVEMENT, "maximum_scale_drift_fraction": SCALE_DRIFT, "maximum_rig_translation_drift_m": RIG_METRES,
    "maximum_rig_rotation_drift_deg": RIG_DEGREES, "maximum_focal_relative_change": manifests.FOCAL_CHANGE, "maximum_k1_k2_absolute_change": manifests.DISTORTION_CHANGE,
    "fixed_parameter_tolerance": manifests.FIXED_TOLERANCE,
}


def checked_policy(**own: float) -> dict[str, float]:
    """POLICY with limits of one's own: known names, finite, not negative, an improvement between 0 and 1."""
    policy = POLICY | own
    if set(policy) != set(POLICY) or any(not math.isfinite(v) or v < 0 for v in policy.values()) or not 0 < policy["minimum_reprojection_p50_improvement_fraction"] < 1:
        raise ValueError(f"a limit is unknown or out of range: {own}")
    return policy


def _p50(errors: DataFrame) -> float:
    """Exact, from counts by bin: no task gathers the errors of a whole model."""
    bad = F.col("error").isNull() | F.isnan("error") | (F.abs("error") == float("inf")) | (F.col("error") < 0)
    integrity.require_none(errors.filter(bad), "errors must be finite and not negative")
    value, n = stats.narrowed_percentile(errors, "error", 0.5)
    if not n:
        raise ValueError("there are no errors")
    return value


def _rig_drift(before: DataFrame, after: DataFrame) -> dict:
    """The largest change of the right-to-left poses (id, m) in metres and degrees."""
    m = before.select("id", F.col("m").alias("b")).join(after.select("id", F.col("m").alias("a")), "id")
    move = F.sqrt(sum((F.pow(F.element_at("a", i) - F.element_at("b", i), 2) for i in (4, 8, 12)), F.lit(0.0)))
    turn = F.degrees(geometry.rotation_angle(geometry.rotation_of(F.col("a")), geometry.rotation_of(F.col("b"))))
    drift = m.agg(F.max(move).alias("t"), F.max(turn).alias("r")).first()
    if drift["t"] is None:
        raise ValueError("no rigs")
    return drift.asDict()


def bundle_report(before: dict[str, DataFrame], after: dict[str, DataFrame], stage: int, solved: bool, **own: float) -> DataFrame:
    """before and after: errors (error), rigs (id, m: right to left, x, y, z: centre), cameras (key, fl_x ... k4) of a solver
    stage (1, 2, 3). -> name, value and passed of the five gates: the solver's success, the gain of the median error, the
    rigs' baselines (the largest share of a limit that a drift takes), the scene's scale, and what the stage may change of the cameras (how
    many break it). own: limits that replace those of POLICY."""
    gates.stage_options(stage)
    policy, spark = checked_policy(**own), before["errors"].sparkSession
    old, new = _p50(before["errors"]), _p50(after["errors"])
    if old <= 0:
        raise ValueError("the median error before must be positive")
    integrity.require_none(integrity.key_set_difference(before["rigs"], after["rigs"], ["id"]), "rigs differ")
    drift = _rig_drift(before["rigs"], after["rigs"])
    baseline = max(_share(drift["t"], policy["maximum_rig_translation_drift_m"]), _share(drift["r"], policy["maximum_rig_rotation_drift_deg"]))
    scale = [joins.median_pair_distance(s["rigs"], ["x", "y", "z"]).first()[0] for s in (before, after)]
    if not all(scale):
        raise ValueError("no two rigs are apart")
    audit = manifests.stage_audit(
        before["cameras"], after["cameras"], "key", stage, policy["fixed_parameter_tolerance"], policy["maximum_focal_relative_change"], policy["maximum_k1_k2_absolute_change"]
    ).agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("bad")).first()
    if not audit["n"]:
        raise ValueError("there are no cameras")
    gain, change = (old - new) / old, abs(scale[1] / scale[0] - 1)
    rows = [
        (float(solved), bool(solved)), (gain, gain >= policy["minimum_reprojection_p50_improvement_fraction"]), (baseline, baseline <= 1),
        (change, change <= policy["maximum_scale_drift_fraction"]), (float(audit["bad"]), not audit["bad"]),
    ]
    return spark.createDataFrame([(n, *r) for n, r in zip(BUNDLE_GATES, rows, strict=True)], "name string, value double, passed boolean")


def _share(value: float, limit: float) -> float:
    return value / limit if limit else (0.0 if value == 0 else math.inf)


def signed_bundle_report(gated: DataFrame, stage: int, before_hash: str, after_hash: str, **own: float) -> dict:
    """The gates of bundle_report() as a signed report that says which model is published."""
    found = {r["name"]: {"status": "PASS" if r["passed"] else "FAIL", "value": r["value"]} for r in gated.collect()}  # five rows
    accepted = all(g["status"] == "PASS" for g in found.values())
    report = {
        "stage": stage, "stage_options": gates.stage_options(stage), "policy": checked_policy(**own), "before_model_sha256": before_hash, "after_model_sha256": after_hash,
        "gates": found, "candidate_accepted": accepted, "published_model": "after" if accepted else "before",
    }
    return scalar.signed(report, "ba_report_sha256")


def verify_bundle_report(report: dict) -> None:
    """Signature, the five gates, and a decision that is what they say."""
    if set(report.get("gates", {})) != set(BUNDLE_GATES):
        raise ValueError("gates are missing or unknown")
    manifests.verify_decision(report, "ba_report_sha256", "candidate_accepted", "published_model", ("after", "before"))


def refinement_gates(losses: DataFrame, moves: DataFrame, most_metres: float = 0.25, most_degrees: float = 2.0, gain: float = 0.01, rigs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """losses (before, after) of pose candidates, moves (metres, degrees) of rigs: bounds held, and a mean gain of `gain` and
    more that is over 0. rigs (id, m: right to left), before and after: their baseline must stay as well. Losses that are
    negative, of 0 before or not finite, moves that aren't finite, and tables without a row are errors."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    integrity.require_none(losses.filter(odd("before") | odd("after") | (F.col("before") <= 0) | (F.col("after") < 0)), "losses must be finite and not negative")
    integrity.require_none(moves.filter(odd("metres") | odd("degrees")), "moves must be finite")
    l = losses.agg(F.avg("before").alias("b"), F.avg("after").alias("a")).first()  # noqa: E741
    m = moves.agg(F.max("metres").alias("t"), F.max("degrees").alias("r")).first()
    if l["b"] is None or m["t"] is None:
        raise ValueError("no losses or no moves")
    rows = [("translation_m", m["t"]), ("rotation_deg", m["r"]), ("loss_gain", (l["b"] - l["a"]) / l["b"])]
    limits = [("translation_m", "<=", most_metres), ("rotation_deg", "<=", most_degrees), ("loss_gain", ">=" if gain > 0 else ">", max(gain, 0.0))]
    if rigs:
        integrity.require_none(integrity.key_set_difference(*rigs, ["id"]), "rigs differ")
        drift = _rig_drift(*rigs)
        rows += [("rig_translation_drift_m", drift["t"]), ("rig_rotation_drift_deg", drift["r"])]
        limits += [("rig_translation_drift_m", "<=", RIG_METRES), ("rig_rotation_drift_deg", "<=", RIG_DEGREES)]
    return gates.evaluated(losses.sparkSession.createDataFrame(rows, "name string, value double"), limits)


def review_repair(records: DataFrame, have: DataFrame, by: str, path: str, score: str, ident: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The review sample drawn anew: (what of it there already is, what is missing)."""
    wanted = review_sample(records, by, path, score, ident, k)
    return wanted.join(have.select(ident), ident, "left_semi"), wanted.join(have.select(ident), ident, "left_anti")


def content_hashes(files: DataFrame) -> DataFrame:
    """path, sha256 and bytes of binaryFile rows."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("bytes"))


def changed_files(before: DataFrame, after: DataFrame, values: Sequence[str] = ("bytes", "modified")) -> DataFrame:
    """Paths of two inventories that came, went or differ."""
    b, a = (d.select("path", F.struct(*values).alias(n)) for d, n in ((before, "b"), (after, "a")))
    return b.join(a, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")
