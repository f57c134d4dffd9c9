"""Aggregates: distributions, robust limits, losses, depth metrics, audits. Each is one groupBy, so Spark sums in tasks
first; exact percentiles gather a group's values, approximate ones are the option for groups beyond memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import numbered

def percentile(value: Column, q: float, accuracy: int | None = None) -> Column:
    """Exact with linear interpolation, or approximate with the given accuracy (bounded memory for a huge group)."""
    return F.percentile(value, q) if accuracy is None else F.percentile_approx(value, q, accuracy).cast("double")


def narrowed_percentile(df: DataFrame, value: str, q: float, bounds: tuple[float, float] | None = None, bins: int = 1 << 16, few: int = 100_000) -> tuple[float | None, int]:
    """(the exact percentile with linear interpolation, the number of values) of all finite values, however many. Values are
    counted by bin; the bin that holds the rank is counted anew by finer bins, until it has at most `few` distinct values or
    one. The driver sees bins and those values only, no task gathers a group. bounds, where known, save a pass; they must
    hold all values. (None, 0) without values."""
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    low, high = bounds or v.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None, 0
    known: dict[tuple, list] = {}

    def counted(low: float, high: float, key: str) -> list:
        """Rows (least, greatest, n) by ascending bin (key bin) or value (key v) of the range."""
        if (low, high, key) not in known:
            width = max((high - low) / bins, 5e-324)
            place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if key == "bin" else F.col("v")
            rows = v.filter(F.col("v").between(low, high)).groupBy(place.alias("place")).agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.count("*").alias("n"))
            known[low, high, key] = sorted((r["least"], r["greatest"], r["n"]) for r in rows.collect())
        return known[low, high, key]

    def at(rank: int) -> float:
        a, z, below, n = low, high, 0, None
        while True:
            last = n is not None and n <= few
            for least, greatest, n in counted(a, z, "v" if last else "bin"):
                if below + n > rank:
                    break
                below += n
            if least == greatest:
                return least
            a, z = least, greatest

    n = sum(r[2] for r in counted(low, high, "bin"))
    if not n:
        return None, 0
    place = q * (n - 1)
    lower = at(int(place))
    upper = at(min(int(place) + 1, n - 1))
    return lower + (upper - lower) * (place - int(place)), n


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """n, min, p50, p95, max; 0.0 for none."""
    v = F.col(value).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), zero(F.min(v)).alias("min"), zero(percentile(v, 0.5, accuracy)).alias("p50"), zero(percentile(v, 0.95, accuracy)).alias("p95"), zero(F.max(v)).alias("max")
    )


def finite_summary(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Counts of finite and other values (NaN counts as infinite), and figures of the finite ones: null without any."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.count(finite).alias("finite_count"), (F.count(v) - F.count(finite)).alias("infinite_count"), F.avg(finite).alias("mean"),
        percentile(finite, 0.5, accuracy).alias("p50"), percentile(finite, 0.95, accuracy).alias("p95"), F.min(finite).alias("min"), F.max(finite).alias("max"),
    )


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def histogram_quantile(hist: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """From a histogram (value, n): the first value whose running count reaches max(1, ceil(q * total)). The window runs
    over bins, not rows."""
    w = Window.partitionBy(*by).orderBy(value)
    run = hist.withColumn("run", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return run.filter(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total")))).groupBy(*by).agg(F.min(value).alias("quantile"))


def scatter(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The population standard deviation of each value, 0.0 for none."""
    return df.groupBy(*by).agg(*[F.coalesce(F.stddev_pop(F.col(v).cast("double")), F.lit(0.0)).alias(f"{v}_scatter") for v in values])


def quantiles_of_histogram(hist: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """*by, n and a column for each name of quantiles, by one pass over the bins of a histogram (value, n)."""
    group = Window.partitionBy(*by)
    run = hist.withColumn("run", F.sum("n").over(group.orderBy(value))).withColumn("total", F.sum("n").over(group))
    at = {name: F.min(F.when(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))), F.col(value))) for name, q in quantiles.items()}
    return run.groupBy(*by).agg(F.sum("n").alias("n"), *[c.alias(name) for name, c in at.items()])


def robust_limit(df: DataFrame, value: str, floor: float, multiplier: float, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """median, mad and max(floor, median + multiplier * 1.4826 * mad)."""
    med = df.groupBy(*by).agg(percentile(F.col(value), 0.5, accuracy).alias("median"))
    joined = df.join(med, list(by)) if by else df.withColumn("median", F.lit(med.first()[0]))
    out = joined.groupBy(*by).agg(F.first("median").alias("median"), percentile(F.abs(F.col(value) - F.col("median")), 0.5, accuracy).alias("mad"))
    return out.withColumn("upper", F.greatest(F.lit(float(floor)), F.col("median") + multiplier * 1.4826 * F.col("mad")))


def masked_error(df: DataFrame, a: str, b: str, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """mse, psnr (null where the images are equal, with psnr_infinite) and l1 over the masked rows."""
    d = F.when(mask, F.col(a) - F.col(b))
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("l1"))
    return out.withColumn("psnr_infinite", F.col("mse") == 0).withColumn("psnr", F.when(F.col("mse") > 0, -10 * F.log10("mse")))


def global_ssim(df: DataFrame, a: str, b: str, mask: Column, by: Sequence[str] = (), c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """Structural similarity from a group's means, variances and covariance."""
    x, y = F.when(mask, F.col(a).cast("double")), F.when(mask, F.col(b).cast("double"))
    m = df.groupBy(*by).agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy")
    )
    c = F.col
    top = (2 * c("mx") * c("my") + c1) * (2 * c("cxy") + c2)
    return m.select(*by, (top / ((c("mx") ** 2 + c("my") ** 2 + c1) * (c("vx") + c("vy") + c2))).alias("ssim"))


def depth_metrics(df: DataFrame, target: str, predicted: str, weight: str, valid: Column, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Weighted mean absolute and root mean square error, and the plain 95th percentile of the absolute error."""
    ok = valid & (F.col(weight) > 0) & ~F.isnan(target) & ~F.isnan(predicted)
    e, w = F.when(ok, F.abs(F.col(predicted) - F.col(target))), F.when(ok, F.col(weight))
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), (F.sum(w * e) / F.sum(w)).alias("mae"), F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"), percentile(e, 0.95, accuracy).alias("abs_p95")
    )


def supervision_loss(losses: DataFrame, l1: str, ssim: str, range_l1: str, weights: Sequence[float] = (0.8, 0.2, 0.05)) -> DataFrame:
    return losses.withColumn("loss", weights[0] * F.col(l1) + weights[1] * (1 - F.col(ssim)) + weights[2] * F.coalesce(F.col(range_l1), F.lit(0.0)))


def residual_audit(obs: DataFrame, image: str, error: str, flag: str, high: float = 5.0, minimum: int = 20, overlap: float = 0.3, accuracy: int | None = None) -> DataFrame:
    """For each image and for all (image null): observations, those flagged, high ones, high flagged ones, their share, and
    the decision of the whole. Image rows are sums that the total adds up, except percentiles."""
    bad = obs.filter(F.col(image).isNull() | F.col(error).isNull() | F.isnan(F.col(error).cast("double")) | (F.col(error) < 0)).limit(1).count()
    if bad:
        raise ValueError("observations need an image and a finite, non-negative error")
    is_high, on = F.col(error) >= high, F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    out = obs.groupingSets([[F.col(image)], []], F.col(image)).agg(
        F.grouping(image).alias("is_total"), F.count("*").alias("observations"), F.count_if(on).alias("flagged"), F.count_if(is_high).alias("high"), F.count_if(is_high & on).alias("high_flagged"),
        percentile(F.col(error), 0.5, accuracy).alias("p50"), percentile(F.col(error), 0.95, accuracy).alias("p95"), F.max(error).cast("double").alias("max"),
    )
    share = F.coalesce(F.try_divide(F.col("high_flagged").cast("double"), F.col("high")), F.lit(0.0))
    out = out.withColumn("overlap_fraction", share)
    decision = F.when(F.col("high") < minimum, "INSUFFICIENT_HIGH_RESIDUAL_OBSERVATIONS").when(share >= overlap, "RERUN_MASKED_BA_RECOMMENDED").otherwise("RETAIN_CURRENT_BA")
    return out.withColumn("decision", F.when(F.col("is_total") == 1, decision))


def hash_of_rows(df: DataFrame, path: str, content: str, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over path NUL content LF in path order: one digest for each group. A group is sorted (on disk where it must
    be) and streamed through the hash, so no row or task holds it; the hash itself has no parallel form, so a group is one
    task's: pass the hash of each content where contents are long, so that tasks hash them and the stream is short. Rows
    with a null path or content count, but add nothing to the digest."""
    import hashlib

    line = F.concat(F.col(path), F.lit("\0"), F.col(content), F.lit("\n"))
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(path).alias("__path"), F.col(content).alias("__content"), line.alias("__line"))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    # Groups of one partition are told apart by their keys, in sorted order.
    ordered = dealt.sortWithinPartitions(*keys, "__path", "__content").select(*keys, "__line")

    def digests(batches):
        import pyarrow as pa

        now, head, digest, n = None, None, hashlib.sha256(), 0
        same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))  # noqa: E731  NaN is one group

        def row():
            return pa.RecordBatch.from_arrays([*head, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[*keys, "digest", "n"])

        for b in batches:
            own = [b.column(i).to_pylist() for i in range(len(keys))]
            lines = b.column(len(keys))
            for i in range(b.num_rows):
                key = tuple(c[i] for c in own)
                if now is None or not same(key, now):
                    if now is not None:
                        yield row()
                    now, head, digest, n = key, [b.column(j).slice(i, 1) for j in range(len(keys))], hashlib.sha256(), 0
                digest.update((lines[i].as_py() or "").encode())
                n += 1
        if now is not None:
            yield row()

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())])
    out = ordered.mapInArrow(digests, schema)
    if not keys:  # a row for an empty table, too
        return out.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "digest", "n")


def first_seen_ids(df: DataFrame, key: Sequence[str], order: str, out: str = "dense_id") -> DataFrame:
    """key, first and a dense id from 0 in the order in which keys first appear; distinct keys are numbered by ranges."""
    return numbered(df.groupBy(*key).agg(F.min(order).alias("first_seen")), ["first_seen", *key], out)


def signed_differences(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """key, name, difference (a - b) of each value, for keys on both sides, and the largest absolute one of the key."""
    both = a.select(*key, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(*key, *[F.col(v).alias(f"b_{v}") for v in values]), list(key))
    long = both.select(*key, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), (F.col(f"a_{v}") - F.col(f"b_{v}")).alias("difference")) for v in values])).alias("d"))
    return long.select(*key, "d.name", "d.difference", F.max(F.abs("d.difference")).over(Window.partitionBy(*key)).alias("max_abs"))


def radial_profile(pixels: DataFrame, x: Column, y: Column, value: str, cx: float, cy: float) -> DataFrame:
    """Mean value of the pixels at each whole radius."""
    r = F.floor(F.hypot(x - cx, y - cy)).cast("int")
    return pixels.groupBy(r.alias("radius")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def first_dark_radius(profile: DataFrame, threshold: float, least: int = 0) -> DataFrame:
    return profile.filter((F.col("mean") < threshold) & (F.col("radius") >= least)).agg(F.min("radius").alias("radius"))


def centres(df: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """The mean place of each group's rows (a rig's cameras), and how many there are."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


def coverage_summary(mask: DataFrame, instances: DataFrame, images: DataFrame, image: str, instance: str, pixels: int) -> DataFrame:
    """One row over all images: how many, those with a mask, instances, and min, p50, p95 and max of the masked fraction."""
    counts = instances.select(image, instance).distinct().groupBy(image).agg(F.count("*").alias("instances"))
    per = images.select(image).join(mask.groupBy(image).count(), image, "left").join(counts, image, "left")
    share = per.select((F.coalesce("count", F.lit(0)) / pixels).alias("fraction"), F.coalesce("instances", F.lit(0)).alias("instances"))
    return share.agg(
        F.count("*").alias("images"), F.count_if(F.col("fraction") > 0).alias("with_mask"), F.sum("instances").alias("instances"), F.min("fraction").alias("min"),
        F.percentile("fraction", 0.5).alias("p50"), F.percentile("fraction", 0.95).alias("p95"), F.max("fraction").alias("max"),
    )


def array_digest(points: DataFrame, order: str = "idx") -> str:
    """SHA-256 of all coordinates (x, y, z as little-endian doubles) in order, then of all colours (red, green, blue as
    bytes): coordinates and colours are two sorted runs that one task streams through the hash."""
    import hashlib

    import numpy as np

    xyz = points.select(F.lit(0).alias("part"), F.col(order).alias("at"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    rgb = points.select(F.lit(1).alias("part"), F.col(order).alias("at"), *[F.col(c).cast("double").alias(a) for a, c in zip("xyz", ("red", "green", "blue"), strict=True)])

    def stream(batches):
        import pyarrow as pa

        digest = hashlib.sha256()
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            v = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
            digest.update(v[part == 0].astype("<f8").tobytes())
            digest.update(v[part == 1].astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({"digest": [digest.hexdigest()]})

    ordered = xyz.unionByName(rgb).repartition(1).sortWithinPartitions("part", "at").select("part", "x", "y", "z")
    row = ordered.mapInArrow(stream, "digest string").first()
    return row["digest"] if row else hashlib.sha256().hexdigest()
