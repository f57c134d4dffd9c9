"""Pixel tables: windows of crops and reductions, mask composition, structural similarity with a Gaussian window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cropped(pixels: DataFrame, left: int, top: int, width: int, height: int, factor: int = 1) -> DataFrame:
    """Pixels (px, py, ...) of the window, moved to its corner; reduced by factor with the nearest pixel (the one at the
    centre of each factor x factor cell, rounded down)."""
    if factor not in (1, 2, 4) or width % factor or height % factor or min(left, top) < 0 or min(width, height) <= 0:
        raise ValueError("the window must be inside, and its sides multiples of the factor 1, 2 or 4")
    x, y, half = F.col("px") - left, F.col("py") - top, factor // 2
    inside = pixels.filter(x.between(0, width - 1) & y.between(0, height - 1))
    kept = inside.filter((F.pmod(x, F.lit(factor)) == half) & (F.pmod(y, F.lit(factor)) == half))
    return kept.withColumn("px", F.floor(x / factor).cast("int")).withColumn("py", F.floor(y / factor).cast("int"))


def resized(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Pixels (px, py, ...) of images of size (width, height) as images of size `to`: each pixel shows the one that its centre
    falls on, so masks and depths keep their values. One explode, no join."""
    out = pixels
    for axis, n, wanted in (("px", size[0], to[0]), ("py", size[1], to[1])):
        first = lambda at, n=n, wanted=wanted: F.ceil((2 * wanted * at - n) / (2 * n))
        shown = out.withColumn("__a", first(F.col(axis))).withColumn("__z", first(F.col(axis) + 1) - 1).filter("__z >= __a")
        out = shown.withColumn(axis, F.explode(F.sequence(F.col("__a").cast("int"), F.col("__z").cast("int")))).drop("__a", "__z")
    return out


def kernel_weights(n: int, to: int, lobes: int = 3) -> list[tuple[int, int, float]]:
    """(source, target, weight) of a side of n pixels resampled to `to` by a windowed sinc of so many lobes, stretched where
    the side shrinks; each target's weights add up to 1. Some 2 * lobes * max(n, to) entries."""
    import numpy as np

    stretch, out = max(n / to, 1.0), []
    for i in range(to):
        centre = (i + 0.5) * n / to
        near = np.arange(max(0, int(centre - lobes * stretch)), min(n, int(centre + lobes * stretch) + 1))
        t = (near + 0.5 - centre) / stretch
        w = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
        out += [(int(x), i, float(v)) for x, v in zip(near, w / w.sum(), strict=True) if abs(v) > 1e-12]
    return out


def resampled(pixels: DataFrame, by: Sequence[str], values: Sequence[str], size: tuple[int, int], to: tuple[int, int], top: float | None = 255.0) -> DataFrame:
    """Pixels (*by, px, py, *values) of images of size (width, height), resampled to size `to` by a Lanczos kernel: along rows,
    then along columns, each a join with the side's weights (some entries a pixel of a side, the same for all images) and a
    sum that tasks begin. Missing pixels count as 0. With `top`, values are whole levels from 0 to it after each pass (halves
    up, as in 8-bit images); None leaves them as they are."""
    spark, out = pixels.sparkSession, pixels
    for axis, other, n, wanted in (("px", "py", size[0], to[0]), ("py", "px", size[1], to[1])):
        weights = spark.createDataFrame(kernel_weights(n, wanted), f"{axis} int, __to int, __w double")
        level = lambda v: v if top is None else F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor(F.round(v, 9) + 0.5).cast("double")))
        out = out.join(weights, axis).groupBy(*by, other, F.col("__to").alias("__at")).agg(*[level(F.sum(F.col(v) * F.col("__w"))).alias(v) for v in values])
        out = out.withColumnRenamed("__at", axis)
    return out.select(*by, "px", "py", *values)


def supervised(valid: Column, static: Column, dynamic: Column, depth: Column, confidence: Column) -> Column:
    """Whether a pixel's depth is used: in the image circle, static, not dynamic, with a finite depth and confidence."""
    ok = ~F.isnan(depth) & (F.abs(depth) != float("inf")) & (depth > 0) & (confidence > 0)
    return F.coalesce(valid & static & ~dynamic & ok, F.lit(False))


def gaussian_ssim(pixels: DataFrame, image: str, a: str, b: str, mask: str, sigma: float = 1.5, c1: float = 0.01**2, c2: float = 0.03**2, size: tuple[int, int] | None = None) -> DataFrame:
    """Mean structural similarity over the masked pixels of each image; local moments are Gaussian means over masked
    neighbours (weights that fall outside the mask are left out), images reflected at their edges: those of size (width, height),
    or without it the largest pixel's. An image is one group: its pixels fit a task."""
    import numpy as np
    import pandas as pd

    def blurred(v, kernel, r):
        for axis in (0, 1):
            pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
            p = np.pad(v, pad, mode="symmetric")
            v = sum(k * np.take(p, np.arange(v.shape[axis]) + i, axis=axis) for i, k in enumerate(kernel))
        return v

    def one(d):
        w, h = size or (int(d["px"].max()) + 1, int(d["py"].max()) + 1)
        x, y, m = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
        at = d["py"].to_numpy(), d["px"].to_numpy()
        x[at], y[at], m[at] = d["a"], d["b"], d["m"].astype(float)
        r = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        kernel /= kernel.sum()
        share = blurred(m, kernel, r)
        mean = lambda v: blurred(v * m, kernel, r) / np.maximum(share, 1e-12)
        mx, my = mean(x), mean(y)
        vx, vy, cxy = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
        s = (2 * mx * my + c1) * (2 * cxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
        n = int(m.sum())
        return pd.DataFrame({"image": [d["image"].iloc[0]], "ssim": [float(s[m > 0].mean()) if n else None], "n": [n]})

    rows = pixels.select(F.col(image).alias("image"), "px", "py", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(mask).cast("boolean").alias("m"))
    kind = dict(pixels.dtypes)[image]
    return rows.groupBy("image").applyInPandas(one, f"image {kind}, ssim double, n bigint").withColumnRenamed("image", image)


def masked_mean(pixels: DataFrame, value: str, mask: Column, by: Sequence[str]) -> DataFrame:
    """Mean of a distance map over the masked pixels, null without any."""
    return pixels.groupBy(*by).agg(F.avg(F.when(mask, F.col(value))).alias("mean"), F.count(F.when(mask, F.col(value))).alias("n"))
