"""Poses in groups and in time: mean rotations, residuals against neighbours, anchors that are left out and why.

A pose is axes (three columns, metres) and q, a unit quaternion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import eigen, geometry
from .joins import bracketed_poses
from .stats import narrowed_percentile, robust_limit
from .windows import beside

KEYS = ("x", "y", "z", "w")

#: Limits of the anchor filter (metres, degrees) and the fewest anchors.
LIMITS = {
    "minimum_anchors": 5, "multiplier": 6.0, "translation_floor": 0.002, "rotation_floor": 0.05, "pair_translation": 0.01, "pair_rotation": 0.1,
}


def mean_poses(df: DataFrame, by: Sequence[str], order: str, q: str = "q", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """*by, n, the mean of axes and q: quaternions with the sign of the group's first one (by order), added and scaled to
    length 1; null where they cancel out. Two aggregations: the first quaternion of each group, then sums."""
    first = df.groupBy(*by).agg(F.min_by(q, order).alias("__first"))
    rows = df.join(first, list(by)) if by else df.crossJoin(F.broadcast(first))  # without groups, one row
    dot = sum((F.col(q)[k] * F.col("__first")[k] for k in KEYS[1:]), F.col(q)["x"] * F.col("__first")["x"])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes], *[F.avg(sign * F.col(q)[k]).alias(f"__{k}") for k in KEYS])
    s = F.struct(*[F.col(f"__{k}").alias(k) for k in KEYS])
    unit = F.when(geometry.quaternion_norm(s) > 2.220446049250313e-16, geometry.unit_quaternion(s))
    return out.withColumn(q, unit).drop(*[f"__{k}" for k in KEYS])


def principal_rotations(df: DataFrame, by: Sequence[str], q: str = "q") -> DataFrame:
    """*by, n, q (the rotation with the least sum of squared sines of half angles to the group's, w >= 0) and share, how much of the group's
    moment lies along it (1: all the same). Signs don't matter, and sums of products in any order give it."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(q)[a] * F.col(q)[b]).alias(f"__{i}{j}") for i, a in enumerate(KEYS) for j, b in enumerate(KEYS) if i <= j])
    top = F.element_at(eigen.symmetric({(i, j): F.col(f"__{i}{j}") for i in range(4) for j in range(i, 4)}, 4), -1)
    out = sums.select(*by, "n", top.alias("__top"))
    sign = F.when(F.element_at("__top.vector", 4) < 0, -1.0).otherwise(1.0)
    return out.select(*by, "n", F.struct(*[(F.element_at("__top.vector", i + 1) * sign).alias(k) for i, k in enumerate(KEYS)]).alias(q), F.col("__top.value").alias("share"))


def pair_anchors(pairs: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """pairs (.., l_x, l_y, l_z, l_q, r_x, ..., r_q) of two corrections -> with their mean (axes, q) and how far they are
    apart: pair_translation (metres), pair_rotation (degrees)."""
    apart = F.sqrt(sum((F.pow(F.col(f"r_{a}") - F.col(f"l_{a}"), 2) for a in axes), F.lit(0.0)))
    turn = F.degrees(geometry.quaternion_angle(F.col("l_q"), F.col("r_q")))
    mean = {a: (F.col(f"l_{a}") + F.col(f"r_{a}")) / 2 for a in axes}
    out = pairs.withColumns({**mean, "q": geometry.mean_quaternion(F.col("l_q"), F.col("r_q")), "pair_translation": apart, "pair_rotation": turn})
    return out.drop(*[f"{s}_{a}" for s in "lr" for a in (*axes, "q")])


def residuals(df: DataFrame, by: Sequence[str], time: str, axes: Sequence[str] = ("x", "y", "z"), q: str = "q", spread: bool | None = None) -> DataFrame:
    """df with translation_residual (metres) and rotation_residual (degrees) of each pose against the one predicted from its
    neighbours in time (line and shorter arc); inner is false, and both are 0, at a group's ends. Times that don't increase
    raise."""
    rows = beside(df, by, [time], F.struct(F.col(time).alias("t"), *axes, F.col(q).alias("q")), "__lo", "__hi", spread)
    c = F.col
    span = c("__hi.t") - c("__lo.t")
    inner = c("__lo").isNotNull() & c("__hi").isNotNull()
    part = F.when(span > 0, (c(time) - c("__lo.t")).cast("double") / span.cast("double")).otherwise(F.raise_error("anchor times must increase").cast("double"))
    rows = rows.withColumn("inner", inner).withColumn("__part", F.when(c("inner"), part))
    line = lambda a: c(f"__lo.{a}") + c("__part") * (c(f"__hi.{a}") - c(f"__lo.{a}"))
    moved = F.sqrt(sum((F.pow(c(a) - line(a), 2) for a in axes), F.lit(0.0)))
    turned = F.degrees(geometry.let(geometry.slerp(c("__lo.q"), c("__hi.q"), c("__part")), lambda p: geometry.quaternion_angle(p, c(q))))
    zero = lambda x: F.when(c("inner"), x).otherwise(0.0)
    return rows.withColumn("translation_residual", zero(moved)).withColumn("rotation_residual", zero(turned)).drop("__lo", "__hi", "__part")


def _limit(inner: DataFrame, value: str, floor: float, multiplier: float) -> float:
    """Of a whole table, from counts by bin: no task gathers the values."""
    median, n = narrowed_percentile(inner, value, 0.5)
    if not n:
        return floor
    mad, _ = narrowed_percentile(inner.select(F.abs(F.col(value) - median).alias("v")), "v", 0.5)
    return max(floor, median + multiplier * 1.4826 * mad)


def filtered_anchors(anchors: DataFrame, by: Sequence[str], time: str, axes: Sequence[str] = ("x", "y", "z"), q: str = "q", limits: dict = LIMITS, spread: bool | None = None) -> DataFrame:
    """anchors (with pair_translation and pair_rotation) with residuals, reasons and accepted: pairs that disagree, and inner
    poses whose residual is over max(floor, median + multiplier * 1.4826 * MAD) of the group's inner ones."""
    from .scratch import written

    rows = written(residuals(anchors, by, time, axes, q, spread), "pose-residuals")
    inner = rows.filter("inner")
    kinds = ("translation", "rotation")
    if by:
        for k in kinds:
            own = robust_limit(inner, f"{k}_residual", limits[f"{k}_floor"], limits["multiplier"], by).select(*by, F.col("upper").alias(f"{k}_limit"))
            rows = rows.join(own, list(by), "left")
    else:
        rows = rows.withColumns({f"{k}_limit": F.lit(_limit(inner, f"{k}_residual", limits[f"{k}_floor"], limits["multiplier"])) for k in kinds})
    why: list[tuple[str, Column]] = [(f"pair_{k}_disagreement", F.col(f"pair_{k}") > limits[f"pair_{k}"]) for k in kinds]
    why += [(f"temporal_{k}_outlier", F.col("inner") & (F.col(f"{k}_residual") > F.col(f"{k}_limit"))) for k in kinds]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in why]), lambda x: x.isNotNull())
    return rows.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def corrected(anchors: DataFrame, poses: DataFrame, time: str, axes: Sequence[str] = ("x", "y", "z"), q: str = "q", limits: dict = LIMITS) -> DataFrame:
    """poses (.., time) with the correction (axes, q) between the accepted anchors before and after, constant outside. Too
    few anchors, before or after the filter, raise."""
    kept = filtered_anchors(anchors, (), time, axes, q, limits).filter("accepted")
    for rows, what in ((anchors, "anchors"), (kept, "anchors remain after the filter")):
        n = rows.count()
        if n < limits["minimum_anchors"]:
            raise ValueError(f"only {n} {what}, {limits['minimum_anchors']} are needed")
    return bracketed_poses(kept.select(time, *axes, q), poses, time, axes, q)
