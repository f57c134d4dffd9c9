"""Threshold gates and decisions over small metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The thresholds of the default quality report, by metric.
DEFAULT_GATES = [
    ("projection.visible_fraction_p50", ">=", 0.005), ("projection.edge_distance_p50_px", "<=", 8.0), ("projection.edge_frame_success_fraction", ">=", 1.0),
    ("timing.pair_delta_max_ms", "<=", 50.0), ("timing.frame_interval_max_ms", "<=", 1000.0), ("trajectory.speed_max_mps", "<=", 15.0),
    ("trajectory.angular_speed_max_deg_s", "<=", 180.0), ("rig.translation_error_p95_m", "<=", 0.01), ("rig.rotation_error_p95_rad", "<=", 0.01),
    ("rig.intrinsic_max_difference", "<=", 0.001), ("point_cloud.black_rgb_fraction", "<=", 0.25),
]


def metrics_long(wide: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns -> (name, value) rows."""
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*by, "m.name", "m.value")


def evaluated(metrics: DataFrame, gates: Sequence[tuple[str, str, float]], by: Sequence[str] = ()) -> DataFrame:
    """metrics (name, value) joined to their gates: operator, threshold, passed. A missing value never passes."""
    table = metrics.sparkSession.createDataFrame([(n, o, float(t)) for n, o, t in gates], "name string, operator string, threshold double")
    v, t = F.col("value"), F.col("threshold")
    ok = F.coalesce(F.when(F.col("operator") == ">=", v >= t).when(F.col("operator") == "<=", v <= t).when(F.col("operator") == ">", v > t).when(F.col("operator") == "<", v < t), F.lit(False))
    return metrics.join(F.broadcast(table), "name").select(*by, "name", "value", "operator", "threshold", (ok & ~F.isnan(F.coalesce(v, F.lit(0.0)))).alias("passed"))


def status(gated: DataFrame, by: Sequence[str] = (), override: bool = False) -> DataFrame:
    """PASS, FAIL or, where failures are overridden, WARNING_OVERRIDDEN; with the names that failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    out = gated.groupBy(*by).agg(F.bool_and("passed").alias("all_passed"), failed.alias("failed"))
    return out.withColumn("status", F.when(F.col("all_passed"), "PASS").otherwise("WARNING_OVERRIDDEN" if override else "FAIL"))


def measured(value: Column) -> Column:
    """A value that may not have been measured: status and value."""
    return F.struct(F.when(value.isNull(), "NOT_RUN").otherwise("MEASURED").alias("status"), value.alias("value"))


def accepted(gated: DataFrame, candidate: str, fallback: str, by: Sequence[str] = ()) -> DataFrame:
    """What is published: the candidate if every gate passed (one without a value didn't), else the fallback."""
    out = gated.groupBy(*by).agg(F.bool_and("passed").alias("accepted"))
    return out.withColumn("published", F.when(F.col("accepted"), candidate).otherwise(fallback))


def against_baseline(metrics: DataFrame, strict: Sequence[str], lenient: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """metrics (name, baseline, candidate) -> a row for each name of strict, whose candidate must be under the baseline, and
    of lenient, whose may equal it: status PASS, FAIL or, without a value, NOT_RUN, which doesn't pass."""
    from .integrity import require_none

    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    require_none(metrics.filter(odd("baseline") | odd("candidate")).select(*by, "name"), "metrics must be finite and not negative")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n in strict).alias("strict")) for n in [*strict, *lenient]])).alias("w")
    groups = metrics.select(*by).distinct() if by else metrics.sparkSession.range(1).select()
    table = groups.select(*by, wanted).select(*by, "w.*")
    both = table.join(metrics.select(*by, "name", "baseline", "candidate"), [*by, "name"], "left")
    better = F.when(F.col("strict"), F.col("candidate") < F.col("baseline")).otherwise(F.col("candidate") <= F.col("baseline"))
    status = F.when(better.isNull(), "NOT_RUN").when(better, "PASS").otherwise("FAIL")
    return both.select(*by, "name", "baseline", "candidate", status.alias("status"), F.coalesce(better, F.lit(False)).alias("passed"))


def improvement(before: Column, after: Column) -> Column:
    return F.try_divide(before - after, before)


def before_after(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, before, after, change, over all keys, which must be the same on both sides."""
    from .integrity import key_set_difference, require_none

    require_none(key_set_difference(before, after, key), "keys differ before and after")
    b, a = before.select(*key, F.col(value).alias("before")), after.select(*key, F.col(value).alias("after"))
    return b.join(a, list(key)).withColumn("change", F.col("after") - F.col("before"))


def completeness(df: DataFrame, by: Sequence[str], required: Sequence[str]) -> DataFrame:
    """COMPLETE, or PARTIAL with a warning for each required value that is missing."""
    warnings = F.array_sort(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}:NOT_RUN")) for c in required]), lambda x: x.isNotNull()))
    return df.select(*by, warnings.alias("warnings")).withColumn("status", F.when(F.size("warnings") == 0, "COMPLETE").otherwise("PARTIAL"))


def stage_options(stage: int) -> dict[str, bool]:
    """What a solver stage (1, 2, 3) may refine: names and values are fixed."""
    if stage not in (1, 2, 3):
        raise ValueError("stages are 1, 2 and 3")
    return {
        "refine_rig_from_world": True, "refine_sensor_from_rig": False, "refine_focal_length": stage > 1, "refine_principal_point": False, "refine_extra_params": stage == 3,
    }


def parameter_bounds(before: DataFrame, after: DataFrame, key: Sequence[str], limits: dict[str, tuple[float, bool]]) -> DataFrame:
    """key, name, change, bound, passed: limits gives each parameter's bound and whether it is relative."""
    rows = [(n, float(b), rel) for n, (b, rel) in limits.items()]
    table = before.sparkSession.createDataFrame(rows, "name string, bound double, relative boolean")
    long_b, long_a = metrics_long(before, list(limits), key).withColumnRenamed("value", "b"), metrics_long(after, list(limits), key).withColumnRenamed("value", "a")
    both = long_b.join(long_a, [*key, "name"]).join(F.broadcast(table), "name")
    change = F.when(F.col("relative"), F.abs(F.try_divide(F.col("a") - F.col("b"), F.col("b")))).otherwise(F.abs(F.col("a") - F.col("b")))
    return both.select(*key, "name", change.alias("change"), "bound", F.coalesce(change <= F.col("bound"), F.lit(False)).alias("passed"))
