"""Order-dependent operators: intervals, rates, steps, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .scratch import written


def _in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written once in ranges of (by, order), with __part: a group, or the whole table, may take many parts."""
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *by, *order)
    return written(ranged.withColumn("__part", F.spark_partition_id()), "ranges")


def _with_carried(ranged: DataFrame, by: Sequence[str], ends: Sequence[Column], carried: dict[str, Column]) -> DataFrame:
    """ranged with columns that come from a group's other parts: ends are aggregates of each part of a group, carried are
    windows over a group's parts in order. There is a row for each part and group only."""
    own = ranged.groupBy("__part", *by).agg(*ends).withColumns(carried)
    own = own.select(F.col("__part").alias("__o"), *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], *carried)
    same = F.col("__part") == F.col("__o")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return ranged.join(own, same, "left").drop("__o", *[f"__by{i}" for i in range(len(by))])


def beside(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, before: str | None = None, after: str | None = None, spread: bool | None = None) -> DataFrame:
    """df with value of the row before (column before) and after in order, in each group; null at the ends. spread (the
    default without groups) parts even one group among tasks: ends of parts are carried to their neighbours."""
    out, parts = df.withColumn("__v", value), []
    if not by if spread is None else spread:
        out, parts = _in_ranges(out, by, order), ["__part"]
        key, over = F.struct(*order), Window.partitionBy(*by).orderBy("__part")
        ends = [F.max_by("__v", key).alias("__last"), F.min_by("__v", key).alias("__first")]
        out = _with_carried(out, by, ends, {"__before": F.lag("__last").over(over), "__after": F.lead("__first").over(over)})
    w = Window.partitionBy(*parts, *by).orderBy(*order)
    pick = lambda own, kept: F.when(own(F.lit(1)).over(w).isNull(), F.col(kept)).otherwise(own("__v").over(w)) if parts else own("__v").over(w)
    out = out.withColumns({n: pick(f, kept) for n, f, kept in ((before, F.lag, "__before"), (after, F.lead, "__after")) if n})
    return out.drop("__v", "__before", "__after", *parts)


def known_around(df: DataFrame, by: Sequence[str], time: str, value: Column, low: str, high: str, spread: bool | None = None) -> DataFrame:
    """df with the last value that isn't null up to the row's time (low) and the first one from it on (high), in each group.
    spread as in beside()."""
    out, parts = df.withColumn("__v", value), []
    if not by if spread is None else spread:
        out, parts = _in_ranges(out, by, [time]), ["__part"]
        over, key = Window.partitionBy(*by).orderBy("__part"), F.when(F.col("__v").isNotNull(), F.col(time))
        ends = [F.max_by("__v", key).alias("__last"), F.min_by("__v", key).alias("__first")]
        carried = {
            "__before": F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)),
            "__after": F.first("__first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)),
        }
        out = _with_carried(out, by, ends, carried)
    # Frames that grow from their start are kept up row by row; one that ends at the part's end is added up anew for each row.
    upto = lambda order: F.last("__v", ignorenulls=True).over(Window.partitionBy(*parts, *by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    lo, hi = upto(F.col(time).asc_nulls_first()), upto(F.col(time).desc_nulls_last())
    out = out.withColumns({low: F.coalesce(lo, F.col("__before")) if parts else lo, high: F.coalesce(hi, F.col("__after")) if parts else hi})
    return out.drop("__v", "__before", "__after", *parts)


def intervals(df: DataFrame, by: Sequence[str], time: Column, order: Sequence[str], out: str = "interval", spread: bool | None = None) -> DataFrame:
    """df with the time since the group's row before; null for the first."""
    return beside(df, by, order, time, "__was", spread=spread).withColumn(out, time - F.col("__was")).drop("__was")


def rates(df: DataFrame, by: Sequence[str], time: Column, value: Column, order: Sequence[str], spread: bool | None = None) -> DataFrame:
    """df with dt, step (absolute change of value) and rate = step / dt; steps without time in between have none."""
    out = beside(df, by, order, F.struct(time.alias("t"), value.alias("v")), "__was", spread=spread)
    out = out.withColumn("dt", time - F.col("__was.t")).withColumn("step", F.abs(value - F.col("__was.v"))).drop("__was")
    return out.withColumn("rate", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")))


def turn_rates(df: DataFrame, by: Sequence[str], time: Column, q: str, order: Sequence[str], spread: bool | None = None) -> DataFrame:
    """df with dt, turn (the angle from the rotation before, by unit quaternions) and turn_rate = turn / dt where time passed."""
    out = beside(df, by, order, F.struct(time.alias("t"), F.col(q).alias("q")), "__was", spread=spread)
    out = out.withColumn("dt", time - F.col("__was.t")).withColumn("turn", geometry.quaternion_angle(F.col("__was.q"), F.col(q))).drop("__was")
    return out.withColumn("turn_rate", F.when(F.col("dt") > 0, F.col("turn") / F.col("dt")))


def step_jumps(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[str], limit: float, spread: bool | None = None) -> DataFrame:
    """df with step (0 for a group's first) and jump, true where a step other than the first is over the limit."""
    out = beside(df, by, order, value, "__was", spread=spread).withColumn("__step", F.abs(value - F.col("__was"))).drop("__was")
    return out.withColumn("step", F.coalesce("__step", F.lit(0.0))).withColumn("jump", F.coalesce(F.col("__step") > limit, F.lit(False))).drop("__step")


def numbered(df: DataFrame, order: Sequence, out: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """df with positions from 0 in order, whole groups or the whole table. Without groups the table is range-partitioned
    and each part is numbered from the count of those before it, so no task takes more than its range. The parts are
    written once: range bounds are sampled anew whenever a plan is run, and counts must be those of the numbered parts."""
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    parts = df.sparkSession.sparkContext.defaultParallelism
    part = "__part"
    ranged = df.repartitionByRange(parts, *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "numbered-parts")
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    counts = ranged.groupBy(part).count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(F.broadcast(before.select(part, "__before")), part)  # a row for each partition
    return joined.withColumn(out, F.col("__before") + F.col("__n") - 1).drop(part, "__n", "__before")


def running_before(df: DataFrame, order: Sequence[str], value: str, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows before in order, and __total over all rows: parts in ranges, like numbered."""
    part = "__part"
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "running-parts")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(part).agg(F.sum(value).alias("__sum"))  # a row for each partition
    before = sums.select(part, F.coalesce(F.sum("__sum").over(until(Window.orderBy(part))), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__total"))
    local = ranged.withColumn("__own", F.coalesce(F.sum(value).over(until(Window.partitionBy(part).orderBy(*order))), F.lit(0)))
    return local.join(F.broadcast(before), part).withColumn(out, F.col("__before") + F.col("__own")).drop(part, "__own", "__before")


def _bounded(df: DataFrame, order: Sequence) -> tuple[DataFrame, int]:
    return numbered(df, order), df.count()


def block_split(df: DataFrame, order: Sequence[str], fraction: float, blocks: int, seed: int = 0) -> DataFrame:
    """df with pos, block and split. Near-equal contiguous blocks (the first n mod blocks have one row more), taken whole
    from block `seed` on until the rows reach max(1, round half even(n * fraction)); a last block may overshoot."""
    placed, n = _bounded(df, order)
    k = max(1, min(blocks, n))
    q, r = divmod(n, k)
    pos, cut = F.col("pos"), (q + 1) * r
    block = F.when(pos < cut, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - cut) / max(q, 1))).cast("int")
    sizes = [q + (i < r) for i in range(k)]
    target, taken, chosen = max(1, round(n * fraction)), 0, []
    for i in range(k):  # over blocks, not rows
        b = (seed + i) % k
        if taken >= target:
            break
        chosen.append(b)
        taken += sizes[b]
    return placed.withColumn("block", block).withColumn("split", F.when(F.col("block").isin(chosen), "val").otherwise("train"))


def spatial_split(df: DataFrame, axes: Sequence[Column], cell: float, fraction: float, seed: int = 0) -> DataFrame:
    """df with cell and split: whole cells in the order of SHA-256("seed:x:y:z") until the rows reach the target."""
    keys = [F.floor(a / cell) for a in axes]
    name = F.concat_ws(":", *[k.cast("string") for k in keys])
    rows = df.withColumn("cell", name)
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cell")), 256))
    target = F.greatest(F.lit(1), F.bround(F.col("__total") * F.lit(float(fraction)), 0))
    labelled = running_before(sizes, ["h"], "n").select("cell", F.when(F.col("before") < target, "val").otherwise("train").alias("split"))
    return rows.join(labelled, "cell")


def manual_split(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df with split from mapping (key, split), which must cover exactly the keys of df with train or val."""
    from .integrity import key_set_difference

    off = key_set_difference(df.select(key).distinct(), mapping.select(key), [key])
    if off.limit(1).count():
        raise ValueError("the mapping's keys differ from the table's")
    if mapping.filter(~F.col("split").isin("train", "val") | F.col("split").isNull()).limit(1).count():
        raise ValueError("splits must be train or val")
    return df.join(mapping.select(key, "split"), key)


def even_positions(n: Column, k: int) -> Column:
    """Positions floor(i (n - 1) / (k - 1)), the last n - 1, of min(k, n) evenly spaced rows; an array."""
    m = F.least(F.lit(k).cast("bigint"), n)
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(m - 1, F.lit(0))), lambda i: F.when((i == m - 1) & (m > 1), n - 1).otherwise(F.floor(i * step)))


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k evenly spaced rows of each group (all of a smaller one), with pos."""
    placed = df.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    wanted = sizes.select(*by, F.explode(F.array_distinct(even_positions(F.col("n"), k))).alias("pos"))
    return placed.join(wanted, [*by, "pos"], "left_semi")


def stride_sample(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row in order, with pos."""
    placed, n = _bounded(df, order)
    return placed.filter(F.col("pos") % max(1, -(-n // most)) == 0)


def review_sample(df: DataFrame, by: str, path: str, score: str, ident: str, k: int) -> DataFrame:
    """k rows of each group: the k div 2 with the highest scores, evenly spaced ones in path order, then others in path
    order until there are k."""
    top = Window.partitionBy(by).orderBy(F.col(score).desc(), ident)
    in_path, whole = Window.partitionBy(by).orderBy(path), Window.partitionBy(by)
    rows = df.withColumn("r", F.row_number().over(top)).withColumn("pos", (F.row_number().over(in_path) - 1).cast("bigint")).withColumn("n", F.count("*").over(whole))
    first = F.col("r") <= k // 2
    even = F.array_contains(even_positions(F.col("n"), k - k // 2), F.col("pos"))
    rows = rows.withColumn("chosen", (first | even).cast("int"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("chosen").desc(), "pos"))
    # All chosen ones stay; others fill up to k.
    return rows.withColumn("rank", rank).filter((F.col("chosen") == 1) | (F.col("rank") <= k)).drop("r", "pos", "n", "rank")


def first_seen(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Distinct keys with the position where each first appears."""
    return df.groupBy(*key).agg(F.min(order).alias("first_seen"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def largest(df: DataFrame, value: str, ident: str, n: int) -> DataFrame:
    """The n rows of the largest value over the whole table, ties by ident."""
    return df.orderBy(F.desc(value), ident).limit(n)
