"""Joins by tolerance, neighbourhood and bracket. Range conditions are turned into equi-joins on bins or grid cells, so
Spark hashes and shuffles them; what is left is an exact filter."""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import eigen, geometry


def tolerance_candidates(left: DataFrame, right: DataFrame, tolerance: int, by: Sequence[str] = ()) -> DataFrame:
    """left and right (id, t, *by) -> pairs with |t_left - t_right| <= tolerance: both sides in bins of the tolerance, one
    side in its neighbours' as well."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    a = left.select(*by, F.col("id").alias("l_id"), F.col("t").alias("l_t"), F.floor(F.col("t") / tolerance).alias("bin"))
    b = right.select(*by, F.col("id").alias("r_id"), F.col("t").alias("r_t"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("t") / tolerance) + d)).alias("bin"))
    return a.join(b, [*by, "bin"]).filter(F.abs(F.col("l_t") - F.col("r_t")) <= tolerance).drop("bin")


#: Rows of one chain of times that a task chooses from; a longer chain takes rounds.
CHAIN = 1_000_000
#: Tolerances that a range of times spans.
SPAN = 16


def tolerance_pairs(left: DataFrame, right: DataFrame, tolerance: int, by: Sequence[str] = (), chain: int = CHAIN) -> DataFrame:
    """One-to-one pairs within tolerance, as a greedy choice by (|dt|, left t, right t, left id, right id) makes them. Of the
    rows that are left the closest pair are neighbours in time, so candidates beyond neighbours are never made. Tasks choose
    in ranges of SPAN tolerances; what rows beyond a range could change is left to chains, which no gap over the tolerance
    parts, of the rows near its ends. Chains of more than `chain` rows go by rounds instead."""
    from .scratch import written

    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    side = lambda df, s: df.select(*by, F.col("id"), F.col("t").cast("long").alias("t"), F.lit(s).alias("side"))
    ids, out = (left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()), [*by, "l_id", "r_id", "l_t", "r_t", "dt"]
    rows = side(left, 0).withColumns({"l_id": F.col("id"), "r_id": F.lit(None).cast(ids[1])}).drop("id").unionByName(side(right, 1).withColumns({"l_id": F.lit(None).cast(ids[0]), "r_id": F.col("id")}).drop("id"))
    rows = rows.filter(F.col("l_id").isNotNull() | F.col("r_id").isNotNull()).dropna(subset=[*by, "t"])
    width = SPAN * tolerance
    ranged = _chosen(rows.withColumn("unit", F.floor(F.col("t") / width).cast("long")), by, tolerance, width)
    ranged = written(ranged, "tolerance-ranges")
    pairs, rest = ranged.filter("done").select(*out), ranged.filter("not done")
    sides = [rest.filter(F.col(c).isNotNull()).select(*by, F.col(c).alias("id"), F.coalesce("l_t", "r_t").alias("t")) for c in ("l_id", "r_id")]
    chains = _chains(*sides, tolerance, by)
    rest = rest.select(*by, F.coalesce("l_t", "r_t").alias("t"), F.when(F.col("l_id").isNotNull(), 0).otherwise(1).alias("side"), "l_id", "r_id").join(chains.withColumnRenamed("chain", "unit"), [*by, "t"])
    rest = written(rest, "tolerance-chains")
    long = rest.groupBy("unit").count().filter(F.col("count") > chain).select("unit")
    pairs = pairs.unionByName(_chosen(rest.join(long, "unit", "left_anti"), by, tolerance, None).filter("done").select(*out))
    if not long.limit(1).count():
        return pairs
    over = rest.join(long, "unit", "left_semi")
    found = tolerance_candidates(*[over.filter(F.col(c).isNotNull()).select(*by, F.col(c).alias("id"), "t") for c in ("l_id", "r_id")], tolerance, by)
    return pairs.unionByName(_by_rounds(written(found.withColumn("dt", F.abs(F.col("l_t") - F.col("r_t"))).select(*out), "tolerance-candidates"), by))


def _chosen(rows: DataFrame, by: Sequence[str], tolerance: int, width: int | None) -> DataFrame:
    """rows (*by, unit, t, side, l_id, r_id) -> (*by, l_id, r_id, l_t, r_t, dt, done): the pairs of each unit (done), and with
    a width, where unit i is the times from i * width on, the rows whose pairs depend on other units; without, units are whole."""
    names = [*by, "unit", "t", "side", "l_id", "r_id"]
    ordered = rows.select(*names).repartition(*by, "unit").sortWithinPartitions(*by, "unit", "t", "side", "l_id", "r_id")
    schema = ordered.select(*by, "l_id", "r_id", F.col("t").alias("l_t"), F.col("t").alias("r_t"), F.col("t").alias("dt"), F.lit(True).alias("done")).schema

    def choose(batches):
        held, now = [], None

        def settled():
            pairs, rest = _greedy([r[-4] for r in held], [r[-3] for r in held], tolerance, *((now[-1] * width - 1, (now[-1] + 1) * width) if width else (None, None)))
            for i, j in pairs:
                a, z = held[i], held[j]
                yield (*now[:-1], a[-2], z[-1], a[-4], z[-4], abs(a[-4] - z[-4]), True)
            for i in rest if width else ():
                r = held[i]
                yield (*now[:-1], r[-2], r[-1], r[-4] if r[-3] == 0 else None, r[-4] if r[-3] else None, None, False)

        ready = []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:-4] != now:
                    ready += settled() if held else ()
                    held, now = [], r[:-4]
                held.append(r)
            if len(ready) > 10_000:
                yield _batch(ready, schema)
                ready = []
        ready += settled() if held else ()
        if ready:
            yield _batch(ready, schema)

    return ordered.mapInArrow(choose, schema)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], names=types.names)


def _greedy(t: list[int], side: list[int], tolerance: int, before: int | None, after: int | None) -> tuple[list[tuple[int, int]], list[int]]:
    """Rows in order of (t, side, id) -> (pairs of (left, right) row numbers, rows whose pairs other rows may change). Rows that
    aren't known may be at `before` or earlier and at `after` or later. Times are nodes; equal times pair at once, so a node
    has one side, and the closest pair are neighbouring nodes of both sides. A pair is settled if it is closer than any
    unknown row is to either; otherwise its nodes are unknown from then on, and the bounds move over them."""
    at, kind, waiting, pairs, i, n = [], [], [], [], 0, len(t)
    while i < n:
        z = i
        while z < n and t[z] == t[i]:
            z += 1
        m = i + side[i:z].count(0)
        both = min(m - i, z - m)
        pairs += [(i + k, m + k) for k in range(both)]
        if m - i != z - m:
            at.append(t[i])
            kind.append(int(z - m > m - i))
            waiting.append(deque(range(m + both, z) if kind[-1] else range(i + both, m)))
        i = z
    low, high = (-math.inf if before is None else before), (math.inf if after is None else after)
    prior, later, heap = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1)), []

    def meet(a: int, b: int) -> None:
        if a >= 0 and b < len(at) and kind[a] != kind[b] and at[b] - at[a] <= tolerance:
            heap.append((at[b] - at[a], *((at[a], at[b]) if kind[a] == 0 else (at[b], at[a])), a, b))
            if ready:
                heapq.heappush(heap, heap.pop())

    ready = False
    for a in range(len(at) - 1):
        meet(a, a + 1)
    heapq.heapify(heap)
    ready = True
    while heap and low < high:
        dt, _, _, a, b = heapq.heappop(heap)
        if not waiting[a] or not waiting[b] or later[a] != b:
            continue
        if at[a] - low <= dt:
            low = max(low, at[b])
        if high - at[b] <= dt:
            high = min(high, at[a])
        if at[a] - low <= dt or high - at[b] <= dt:
            continue
        for _ in range(min(len(waiting[a]), len(waiting[b]))):
            x, y = waiting[a].popleft(), waiting[b].popleft()
            pairs.append((x, y) if kind[a] == 0 else (y, x))
        for gone in (a, b):
            if not waiting[gone]:
                p, q = prior[gone], later[gone]
                if p >= 0:
                    later[p] = q
                if q < len(at):
                    prior[q] = p
        left_end = a if waiting[a] else prior[a]
        right_end = b if waiting[b] else later[b]
        if left_end >= 0 and right_end < len(at):
            meet(left_end, right_end)
    rest = [i for k, w in enumerate(waiting) if w and (at[k] - low <= tolerance or high - at[k] <= tolerance or low >= high) for i in w]
    return pairs, rest


def _chains(left: DataFrame, right: DataFrame, tolerance: int, by: Sequence[str]) -> DataFrame:
    """(*by, t, chain): times with no gap over the tolerance between them share a chain."""
    from .windows import beside, running_before

    times = left.select(*by, "t").union(right.select(*by, "t")).distinct()
    fresh = beside(times, by, ["t"], F.col("t"), "__was", spread=True)
    fresh = fresh.withColumn("__new", F.coalesce(F.col("t") - F.col("__was") > tolerance, F.lit(True)).cast("int"))
    return running_before(fresh, [*by, "t"], "__new").select(*by, "t", (F.col("before") + F.col("__new")).alias("chain"))


def _by_rounds(rest: DataFrame, by: Sequence[str]) -> DataFrame:
    """The greedy choice by rounds of mutual best candidates: the order is total, so a pair that is best for both its ends is
    what it would take before any other pair of either. Each round is joins and aggregations on ids."""
    from .scratch import written

    taken, rank = None, F.struct("dt", "l_t", "r_t", "l_id", "r_id")
    while True:
        best_l = rest.groupBy(*by, "l_id").agg(F.min(rank).alias("m"))
        best_r = rest.groupBy(*by, "r_id").agg(F.min(rank).alias("m"))
        now = written(best_l.select(*by, "m.*").join(best_r.select(*by, "m.*"), [*by, "dt", "l_t", "r_t", "l_id", "r_id"]), "tolerance-round")
        if not now.limit(1).count():
            break
        taken = now if taken is None else taken.unionByName(now)
        rest = written(rest.join(now.select(*by, "l_id"), [*by, "l_id"], "left_anti").join(now.select(*by, "r_id"), [*by, "r_id"], "left_anti"), "tolerance-rest")
    out = now if taken is None else taken
    return out.select(*by, "l_id", "r_id", "l_t", "r_t", "dt")


def rig_frames(left: DataFrame, right: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with a stable id, floor-mean time and signed delta; the rows of neither pair, with their side)."""
    pairs = tolerance_pairs(left, right, tolerance)
    ident = F.concat(F.lit("rig_"), F.substring(F.sha2(F.concat(F.col("l_id").cast("string"), F.lit("\0"), F.col("r_id").cast("string")), 256), 1, 24))
    framed = pairs.select(ident.alias("rig_id"), F.floor((F.col("l_t") + F.col("r_t")) / 2).alias("t"), "l_id", "r_id", (F.col("r_t") - F.col("l_t")).alias("delta"))
    alone = left.join(pairs.select(F.col("l_id").alias("id")), "id", "left_anti").withColumn("side", F.lit("left")).unionByName(
        right.join(pairs.select(F.col("r_id").alias("id")), "id", "left_anti").withColumn("side", F.lit("right"))
    )
    return framed, alone


def rig_errors(frames: DataFrame, poses: DataFrame, expected: Sequence[float]) -> DataFrame:
    """frames (rig_id, l_id, r_id), poses (id, m: camera to world), the calibrated right-to-left pose (16 numbers) -> rig_id,
    tx, ty, tz (right to left as posed), and how far it is from the calibrated one: translation_error, rotation_error (radians)."""
    both = frames.join(poses.select(F.col("id").alias("l_id"), F.col("m").alias("l_m")), "l_id").join(poses.select(F.col("id").alias("r_id"), F.col("m").alias("r_m")), "r_id")
    back = geometry.transposed(geometry.rotation_of(F.col("l_m")))
    apart = F.zip_with(geometry.translation_of(F.col("r_m")), geometry.translation_of(F.col("l_m")), lambda r, l: r - l)
    posed = both.select("rig_id", geometry.applied(back, apart).alias("t"), geometry.times(back, geometry.rotation_of(F.col("r_m"))).alias("r"))
    wanted = F.array(*[F.lit(float(v)) for v in expected])
    far = F.sqrt(sum((F.pow(F.col("t")[i] - float(expected[4 * i + 3]), 2) for i in range(3)), F.lit(0.0)))
    angle = geometry.rotation_angle(geometry.rotation_of(wanted), F.col("r"))
    return posed.select("rig_id", *[F.col("t")[i].alias(n) for i, n in enumerate(("tx", "ty", "tz"))], far.alias("translation_error"), angle.alias("rotation_error"))


def neighbour_edges(df: DataFrame, ident: str, order: Sequence[str], n: int, keep: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(a, b, gap) for rows at most n places apart in order; gaps count all rows, edges only those where keep holds."""
    from .windows import numbered

    placed = numbered(df, order, "pos", by)
    if keep is not None:
        placed = placed.filter(keep)
    a = placed.select(*by, F.col(ident).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("gap"), "pos").withColumn("pos", F.col("pos") + F.col("gap"))
    return a.join(placed.select(*by, F.col(ident).alias("b"), "pos"), [*by, "pos"]).select(*by, "a", "b", "gap")


def _cells(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(x) / F.lit(float(size))).alias(f"c_{i}") for i, x in enumerate(axes)]


def _keys(axes: Sequence[str]) -> list[str]:
    return [f"c_{i}" for i in range(len(axes))]


def _shifts(n: int) -> Column:
    steps = [()]
    for _ in range(n):
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(d).alias(f"d_{i}") for i, d in enumerate(s)]) for s in steps])


def within_radius(a: DataFrame, b: DataFrame, axes: Sequence[str], radius: float, ident: str = "id", carry: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(a_id, b_id, distance, and a_c, b_c of each column c of carry) with distance <= radius: grid cells of the radius, a
    in its neighbour cells too. A column named id is carried as the ident only. parts deals the cells over so many tasks, for
    joins that make many more rows than they read."""
    side = lambda p: [F.col(ident).alias(f"{p}_id"), *[F.col(x).alias(f"{p}_{x}") for x in dict.fromkeys((*axes, *carry)) if x != "id"]]
    left = a.select(*side("a"), *_cells(axes, radius), F.explode(_shifts(len(axes))).alias("s"))
    right = b.select(*side("b"), *_cells(axes, radius))
    keys = _keys(axes)
    left = left.withColumns({k: F.col(k) + F.col(f"s.d_{i}") for i, k in enumerate(keys)}).drop("s")
    if parts:
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    d = F.sqrt(sum((F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) for x in axes), F.lit(0.0)))
    near = left.join(right, keys).withColumn("distance", d).filter(F.col("distance") <= radius)
    return near.select("a_id", "b_id", "distance", *[f"{p}_{c}" for c in carry if c != "id" for p in "ab"])


#: A cell with more rows than this is dense: searches that start in it start in smaller cells.
DENSE = 256
#: Queries of one task: what adaptive execution joins together by the bytes it reads would make a task sort many times that.
QUERIES = 4096
#: Sizes that one job counts.
HALVINGS = 4


def _halved(axes: Sequence[str], size: float, times: range) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("halvings"), *_cells(axes, size / 2**i)) for i in times])).alias("c")


def _dense_cells(base: DataFrame, axes: Sequence[str], size: float, most: int) -> tuple[DataFrame | None, int]:
    """((halvings, cell) of the cells with over `most` rows, how many sizes have such): size, size / 2, ... while there are
    any, and no further than doubles tell places apart. HALVINGS sizes are counted at once, in tasks first, then only rows
    of cells that are still dense go on."""
    from .scratch import written

    keys, rows, out, n = _keys(axes), base.select(*axes), None, 0
    widest = base.agg(F.max(F.greatest(*[F.abs(F.col(x).cast("double")) for x in axes]))).first()[0]
    least = widest / 2**52 if widest is not None and math.isfinite(widest) else size
    while size / 2**n > least:
        full = rows.select(_halved(axes, size, range(n, n + HALVINGS))).select("c.*").groupBy("halvings", *keys).count().filter(F.col("count") > most)
        full = written(full.drop("count"), "dense-cells")
        deepest = full.agg(F.max("halvings")).first()[0]
        if deepest is None:
            break
        out = full if out is None else out.unionByName(full)
        if deepest < n + HALVINGS - 1:
            return out, deepest + 1
        inside = rows.select(*axes, *_cells(axes, size / 2**deepest)).join(full.filter(F.col("halvings") == deepest).select(*keys), keys, "left_semi")
        rows, n = written(inside.select(*axes), "dense-rows"), n + HALVINGS
    return out, n


def _ringed(queries: DataFrame, base: DataFrame, axes: Sequence[str], k: int, start: float, last: float, tie: str, spare: int = 0, fits: Column | None = None, dense: int = DENSE) -> DataFrame:
    """queries, base (id, tie, *axes) -> (a_id, b_id, distance, rank): for each query the k base rows that fit, by
    (distance, tie), no further than last. Rings: a query is done when k rows are within the radius searched; the others go on with twice the radius.

    A query starts at `start`, or, in a dense cell, at the size of the largest cell around it that isn't dense. A cell that
    isn't dense holds `most` rows at most, and in a dense one k rows are found two rings further at the latest, so a cloud
    searched against itself makes candidates in proportion to its rows, however unevenly they lie. (Queries of another table
    that crowd where base rows don't are left to adaptive execution.) Of base rows at the very
    same place only the first k + spare by tie can be among anyone's k: of a crowded base the others go beforehand. `spare`
    is how many ties of a place may not fit a query."""
    from .scratch import written

    keys, most, n = _keys(axes), max(dense, 4 * (k + spare)), 0
    crowded = base.select(*_cells(axes, start)).groupBy(*keys).count().filter(F.col("count") > most)
    rest = queries.withColumn("__from", F.lit(0))
    if crowded.limit(1).count():
        of_place = Window.partitionBy(*axes).orderBy(tie)
        base = written(base.withColumn("__n", F.dense_rank().over(of_place)).filter(F.col("__n") <= k + spare).drop("__n"), "nearest-base")
        cells, n = _dense_cells(base, axes, start, most)
    if n:
        inside = queries.select("id", _halved(axes, start, range(n))).select("id", "c.*").join(cells, ["halvings", *keys], "left_semi")
        rest = queries.join(inside.groupBy("id").agg((F.max("halvings") + 1).alias("__from")), "id", "left")
        rest = written(rest.withColumn("__from", F.coalesce("__from", F.lit(0))), "nearest-queries")
    out, w = None, Window.partitionBy("a_id").orderBy("distance", f"b_{tie}")
    while True:
        radius = min(start / 2**n if n >= 0 else start * 2**-n, last)
        some = rest.filter(F.col("__from") >= n)
        near = within_radius(some, base, axes, radius, "id", [tie], some.count() // QUERIES + 1)
        near = near if fits is None else near.filter(fits)
        near = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if radius < last:
            near = near.withColumn("__k", F.count("*").over(Window.partitionBy("a_id"))).filter(F.col("__k") == k).drop("__k")
        found = written(near, "nearest-found")
        out = found if out is None else out.unionByName(found)
        if radius >= last:
            return out
        rest = written(rest.join(found.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti"), "nearest-rest")
        finest = rest.agg(F.max("__from")).first()[0]
        if finest is None:
            return out
        n = min(n - 1, finest)  # sizes at which no query searches are passed over


def radius_top_k(df: DataFrame, axes: Sequence[str], radius: float, k: int, ident: str = "id", pos: str = "pos", min_gap: int = 0, dense: int = DENSE) -> DataFrame:
    """For each row its k nearest within radius and at least min_gap places away, by (distance, place): a_id, b_id,
    distance, rank. Rows in dense cells search smaller radii first (see _ringed)."""
    rows = df.select(F.col(ident).alias("id"), F.col(pos).alias("place"), *axes)
    fits = (F.col("a_id") != F.col("b_id")) & (F.abs(F.col("a_place") - F.col("b_place")) >= min_gap)
    return _ringed(rows, rows, axes, k, radius, radius, "place", 2 * min_gap + 1, fits, dense).select("a_id", "b_id", "distance", "rank")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(a, b, reason, distance) of any direction -> one row for each pair with a < b: sorted reasons, least distance."""
    return edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"), F.min("distance").alias("distance")
    )


def reason_counts(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def nearest(queries: DataFrame, base: DataFrame, axes: Sequence[str], k: int = 1, ident: str = "id", start: float | None = None, dense: int = DENSE) -> DataFrame:
    """The k nearest base rows of each query (q_id, b_id, distance, rank), ties by id. A grid search in rings, from about
    the mean distance on (or from start), closer where base rows lie denser (see _ringed): no cross join is needed and
    distant queries cost a few rounds."""
    n = base.count()
    if not n:
        raise ValueError("no base rows")
    spread = base.agg(*[(F.max(x) - F.min(x)).alias(x) for x in axes]).first()
    volume = math.prod(max(spread[x], 1e-12) for x in axes)
    radius = start or max((volume * max(1, k) / n) ** (1 / len(axes)), 1e-9)
    far = queries.agg(*[F.max(F.abs(x)).alias(x) for x in axes]).first()
    reach = 2 * sum((far[x] or 0.0) + abs(spread[x]) for x in axes) + max(base.agg(*[F.max(F.abs(x)).alias(x) for x in axes]).first())
    rows = [d.select(F.col(ident).alias("id"), *axes) for d in (queries, base)]
    return _ringed(*rows, axes, min(k, n), radius, max(4 * reach, radius), "id", 0, None, dense).select(F.col("a_id").alias("q_id"), "b_id", "distance", "rank")


def leakage(val: DataFrame, train: DataFrame, axes: Sequence[str], threshold: float, ident: str = "id") -> DataFrame:
    """The nearest train row of each val row, and whether it is closer than threshold."""
    return nearest(val, train, axes, 1, ident).select("q_id", "b_id", "distance", (F.col("distance") < threshold).alias("leak"))


def local_moments(points: DataFrame, axes: Sequence[str], k: int, ident: str = "id") -> DataFrame:
    """Mean and covariance (by n - 1) of each row's k nearest rows, itself included; covariances as m_ij, 0 for one row."""
    near = nearest(points, points, axes, k, ident)
    joined = near.join(points.select(F.col(ident).alias("b_id"), *axes), "b_id")
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return joined.groupBy(F.col("q_id").alias(ident)).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in axes], *[F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"m_{a}{b}") for a, b in pairs]
    )


def local_geometry(points: DataFrame, k: int = 16, ident: str = "id") -> DataFrame:
    """Normal (nx, ny, nz: the direction of least spread, its largest component positive) and the eigenvalues e0 <= e1 <=
    e2 of each point's neighbourhood, at least three points by at least three neighbours."""
    if k < 3 or points.limit(3).count() < 3:
        raise ValueError("at least three points and neighbours are needed")
    m = local_moments(points, ["x", "y", "z"], k, ident)
    entries = {(i, j): F.col(f"m_{'xyz'[i]}{'xyz'[j]}") for i in range(3) for j in range(i, 3)}
    solved = m.select(ident, eigen.symmetric(entries, 3).alias("e"))
    normal = eigen.led_positive(F.col("e")[0]["vector"], 3)
    return solved.select(ident, normal.alias("v"), *[F.col("e")[i]["value"].alias(f"e{i}") for i in range(3)]).select(ident, *[F.col("v")[i].alias(f"n{a}") for i, a in enumerate("xyz")], "e0", "e1", "e2")


def bracketed(anchors: DataFrame, queries: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), spread: bool | None = None) -> DataFrame:
    """queries with each value interpolated between the anchors before and after, clamped outside; label is anchor,
    interpolated or extrapolated_constant, null without any anchor. One union and two windows in time order, which take
    many parts of one group or table where spread says so (see windows.beside)."""
    from .windows import known_around

    a = anchors.select(*by, time, *values, F.lit(True).alias("is_anchor"))
    q = queries.withColumns({v: F.lit(None).cast(dict(anchors.dtypes)[v]) for v in values}).withColumn("is_anchor", F.lit(False))
    both = a.unionByName(q, allowMissingColumns=True)
    at = F.when(F.col("is_anchor"), F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values]))
    rows = known_around(both, by, time, at, "lo", "hi", spread).filter(~F.col("is_anchor")).drop("is_anchor", *values)
    span = (F.col("hi.t") - F.col("lo.t")).cast("double")
    part = F.when(span > 0, (F.col(time) - F.col("lo.t")).cast("double") / span).otherwise(F.lit(0.0))
    filled = {v: F.when(F.col("lo").isNull(), F.col(f"hi.{v}")).when(F.col("hi").isNull(), F.col(f"lo.{v}")).otherwise(F.col(f"lo.{v}") + part * (F.col(f"hi.{v}") - F.col(f"lo.{v}"))) for v in values}
    label = (
        F.when(F.col("lo").isNull() & F.col("hi").isNull(), F.lit(None))
        .when((F.col("lo.t") == F.col(time)) | (F.col("hi.t") == F.col(time)), "anchor")
        .when(F.col("lo").isNull() | F.col("hi").isNull(), "extrapolated_constant")
        .otherwise("interpolated")
    )
    return rows.withColumns(filled).withColumn("label", label).drop("lo", "hi")


def leave_one_out(df: DataFrame, by: Sequence[str], time: str, value: str, spread: bool | None = None) -> DataFrame:
    """df with residual: value less the line between the rows before and after; 0 at a group's ends."""
    from .windows import beside

    rows = beside(df, by, [time], F.struct(F.col(time).alias("t"), F.col(value).alias("v")), "__lo", "__hi", spread)
    c = F.col
    part = (c(time) - c("__lo.t")).cast("double") / (c("__hi.t") - c("__lo.t")).cast("double")
    off = F.abs(c(value) - (c("__lo.v") + part * (c("__hi.v") - c("__lo.v"))))
    return rows.withColumn("residual", F.when(c("__lo.t").isNull() | c("__hi.t").isNull(), 0.0).otherwise(off)).drop("__lo", "__hi")


def anchors_accepted(df: DataFrame, limit: Column, own: dict[str, Column]) -> DataFrame:
    """df with reasons (those of `own` that hold, and temporal_outlier where residual is over limit) and accepted."""
    named = [F.when(c, F.lit(name)) for name, c in own.items()] + [F.when(F.col("residual") > limit, F.lit("temporal_outlier"))]
    return df.withColumn("reasons", F.filter(F.array(*named), lambda x: x.isNotNull())).withColumn("accepted", F.size("reasons") == 0)


#: Rows of a leaf: boxes of so many near rows are compared before their rows are.
LEAF = 32
#: Bins of one count of distances.
BINS = 1 << 14
#: Distances of a bin from which on it isn't made finer.
FEW = 100_000


def _leaf_order(at: np.ndarray) -> np.ndarray:
    """The order of places (n, axes) that makes every LEAF of them a box of near ones: halves by their widest axis."""
    order, parts = np.arange(len(at)), [(0, len(at))]
    while parts:
        low, high = parts.pop()
        if high - low > LEAF:
            mine = at[order[low:high]]
            half = -(-((high - low) // 2) // LEAF) * LEAF
            order[low:high] = order[low:high][np.argpartition(mine[:, np.argmax(np.ptp(mine, axis=0))], half)]
            parts += [(low, low + half), (low + half, high)]
    return order


def _root(squares) -> np.ndarray:
    """The root of a sum of squares, axis by axis in the same order everywhere, so that bounds round as distances do."""
    total = next(squares)
    for s in squares:
        total += s
    return np.sqrt(total, out=total)


def _leaf_distances(one: np.ndarray, other: np.ndarray | None):
    """Of two tiles (or of one with itself) in leaf order: the least and the greatest distance that each pair of leaves may
    have, how many pairs of rows it has, and a function that yields the distances of some of them, NaN where there is none."""
    def leaves(at):
        n = -(-len(at) // LEAF)
        padded = np.full((n * LEAF, at.shape[1]), np.nan)
        padded[: len(at)] = at
        padded = padded.reshape(n, LEAF, -1)
        return padded, np.nanmin(padded, axis=1), np.nanmax(padded, axis=1), np.minimum(LEAF, len(at) - LEAF * np.arange(n))

    a, a_low, a_high, a_n = leaves(one)
    b, b_low, b_high, b_n = (a, a_low, a_high, a_n) if other is None else leaves(other)
    i, j = np.triu_indices(len(a)) if other is None else (x.ravel() for x in np.indices((len(a), len(b))))
    own = (i == j) if other is None else np.zeros(len(i), bool)
    axes = range(one.shape[1])
    least = _root(np.maximum(0.0, np.maximum(a_low[i, x] - b_high[j, x], b_low[j, x] - a_high[i, x])) ** 2 for x in axes)
    most = _root(np.maximum(a_high[i, x] - b_low[j, x], b_high[j, x] - a_low[i, x]) ** 2 for x in axes)
    n = np.where(own, a_n[i] * (a_n[i] - 1) // 2, a_n[i] * b_n[j])
    lower = np.tril(np.ones((LEAF, LEAF), bool))

    def distances(which):
        for k in range(0, len(which), 64):
            p, q = i[which[k : k + 64]], j[which[k : k + 64]]
            d = _root(np.square(a[p, :, x][:, :, None] - b[q, :, x][:, None, :]) for x in axes)
            d[own[which[k : k + 64]]] = np.where(lower, np.nan, d[own[which[k : k + 64]]])
            yield d.ravel()

    return least, most, n, distances


def _tile_pairs(rows: DataFrame, axes: Sequence[str], block: int, ends) -> DataFrame:
    """rows by (p, q), a pair of tiles each (p <= q; side 0 or 1). Tiles are `block` rows that follow each other along a
    Z-shaped curve: near ones, mostly, and none larger, whatever crowds where. ends: n, and low and high of each axis."""
    from .scratch import written
    from .windows import numbered

    bits = 30 // len(axes)
    code = F.lit(0).cast("bigint")
    for i, x in enumerate(axes):
        low, high = ends[f"low_{x}"], ends[f"high_{x}"]
        step = F.least(F.floor((F.col(x) - low) / ((high - low) or 1.0) * 2**bits), F.lit(2**bits - 1)).cast("bigint")
        for k in range(bits):
            code = code + F.shiftleft(F.shiftright(step, k).bitwiseAND(F.lit(1).cast("bigint")), k * len(axes) + i)
    placed = numbered(rows.withColumn("code", code), ["code", *axes]).select(F.floor(F.col("pos") / block).cast("int").alias("t"), *axes)
    placed, tiles = written(placed, "pair-tiles"), -(-ends["n"] // block)
    upto = lambda a, z: F.explode(F.sequence(a, z))
    left = placed.select(F.col("t").alias("p"), upto(F.col("t"), F.lit(tiles - 1)).alias("q"), F.lit(0).alias("side"), *axes)
    right = placed.filter("t > 0").select(upto(F.lit(0), F.col("t") - 1).alias("p"), F.col("t").alias("q"), F.lit(1).alias("side"), *axes)
    # Tasks by pairs of tiles: what they do grows with those, not with the bytes that they read.
    return left.unionByName(right).repartition(min(tiles * (tiles + 1) // 2, 4096), "p", "q")


def median_pair_distance(df: DataFrame, axes: Sequence[str], ident: str = "id", block: int = 1 << 14, least: float = 1e-9) -> DataFrame:
    """The median distance of all pairs further apart than `least`, of rows whose axes are finite, exactly. Rows are dealt into
    tiles of `block` near ones; a task takes pairs of tiles, and distances are counted by bin, never gathered or written. The
    bounds of the distances of each two leaves of a tile say between which values the median is; then only leaves
    that may have a distance there are compared row by row, all others count as a whole on their side of it. So pairs of
    leaves grow with the square of the rows, pairs of rows by less."""
    finite = ~F.exists(F.array(*[F.col(x).cast("double") for x in axes]), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(finite).select(*[F.col(x).cast("double").alias(x) for x in axes])
    spark, answer = df.sparkSession, "median_distance double, pairs bigint"
    seen = rows.agg(F.count("*").alias("n"), *[f(x).alias(f"{g}_{x}") for x in axes for g, f in (("low", F.min), ("high", F.max))]).first()
    if seen["n"] < 2:
        return spark.createDataFrame([(None, 0)], answer)
    pairs = _tile_pairs(rows, axes, block, seen)
    widest = math.sqrt(sum((seen[f"high_{x}"] - seen[f"low_{x}"]) ** 2 for x in axes)) * (1 + 1e-9)
    known: dict[tuple, dict] = {}

    def counted(low: float, high: float, kind: str) -> dict[float, int]:
        """How many pairs by place. kind ends: least (place: bin) and greatest (BINS + bin) distances of leaves. bins and
        values: distances from low to high by bin or value. -1: pairs below low; -2 (of ends): no further apart than `least`."""
        if (low, high, kind) in known:
            return known[low, high, kind]
        width = (high - low) / BINS or 1.0

        def count(group: pa.Table) -> pa.Table:
            at, side = np.stack([group.column(x).to_numpy() for x in axes], axis=1), group.column("side").to_numpy()
            one, other = (t[_leaf_order(t)] for t in (at[side == 0], at[side == 1]))
            near, far, n, distances = _leaf_distances(one, other if len(other) else None)
            close = far <= least
            found: dict[float, int] = {-2.0: int(n[close].sum())}
            if kind == "ends":
                found[-2.0] += sum(np.count_nonzero(d <= least) for d in distances(np.flatnonzero((near <= least) & ~close)))
                for first, ends in ((0, near), (BINS, far)):
                    by = np.bincount(np.minimum((ends - low) / width, BINS - 1).astype(np.int64), weights=n, minlength=BINS)
                    found |= {float(first + b): int(by[b]) for b in np.flatnonzero(by)}
            else:
                whole = ~close & (far < low) & (near > least)
                found[-1.0] = int(n[whole].sum())
                bins = np.zeros(BINS, np.int64)
                for d in distances(np.flatnonzero(~close & ~whole & (near <= high))):
                    found[-1.0] += np.count_nonzero((d > least) & (d < low))
                    d = d[(d > least) & (d >= low) & (d <= high)]
                    if kind == "bins":
                        bins += np.bincount(np.minimum((d - low) / width, BINS - 1).astype(np.int64), minlength=BINS)
                    else:
                        for v, c in zip(*np.unique(d, return_counts=True), strict=True):
                            found[float(v)] = found.get(float(v), 0) + int(c)
                found |= {float(b): int(bins[b]) for b in np.flatnonzero(bins)}
            return pa.table({"place": pa.array(found.keys(), pa.float64()), "n": pa.array([int(c) for c in found.values()], pa.int64())})

        by = pairs.groupBy("p", "q").applyInArrow(count, "place double, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
        known[low, high, kind] = {r["place"]: r["n"] for r in by}
        return known[low, high, kind]

    ends = counted(0.0, widest, "ends")
    close = ends[-2.0]
    apart = seen["n"] * (seen["n"] - 1) // 2 - close
    if not apart:
        return spark.createDataFrame([(None, 0)], answer)

    def bin_of(by: dict[float, int], rank: int, first: int = 0) -> int:
        for place in sorted(p for p in by if p >= first):
            rank -= by[place]
            if rank < 0:
                return int(place) - first
        raise ValueError("counts don't reach the rank")

    def edges(low: float, high: float, a: int, z: int) -> tuple[float, float]:
        """The values of bins a to z, a little more for rounding."""
        width = (high - low) / BINS or 1.0
        return max(low, (low + a * width) * (1 - 1e-14)), min(high, (low + (z + 1) * width) * (1 + 1e-14))

    def at(rank: int) -> float:
        low, high = start
        while True:
            by = counted(low, high, "bins")
            inside = bin_of({p: c for p, c in by.items() if p >= 0}, rank - by[-1.0])
            if by[float(inside)] <= FEW or high - low <= 1e-13 * high:
                break
            low, high = edges(low, high, inside, inside)
        low, high = edges(low, high, inside, inside)
        by = counted(low, high, "values")
        rank -= by[-1.0]
        for v in sorted(p for p in by if p >= 0):
            rank -= by[v]
            if rank < 0:
                return v
        raise ValueError("counts don't reach the rank")

    # The k-th least distance is between the k-th least of the lower and of the upper bounds.
    middle = (apart - 1) // 2, apart // 2
    lower = {p: c for p, c in ends.items() if 0 <= p < BINS}
    start = edges(0.0, widest, bin_of(lower, close + middle[0]), bin_of(ends, close + middle[1], BINS))
    lower_one, upper_one = (at(r) for r in middle)
    return spark.createDataFrame([(lower_one + (upper_one - lower_one) * 0.5, apart)], answer)


def flagged_by_mask(obs: DataFrame, mask: DataFrame, image: str, x: str, y: str, width: int, height: int) -> DataFrame:
    """obs with on_mask: whether the pixel at the rounded (half to even) place is one of mask (image, px, py)."""
    placed = obs.withColumn("px", F.rint(x).cast("int")).withColumn("py", F.rint(y).cast("int"))
    if placed.filter((F.col("px") < 0) | (F.col("py") < 0) | (F.col("px") >= width) | (F.col("py") >= height)).limit(1).count():
        raise ValueError("an observation lies outside its image")
    on = mask.select(image, "px", "py").distinct().withColumn("on_mask", F.lit(True))
    return placed.join(on, [image, "px", "py"], "left").withColumn("on_mask", F.coalesce("on_mask", F.lit(False))).drop("px", "py")


def nearest_pixels(points: DataFrame, idx: str, pixel: Sequence[str], distance: str, limit: int = 3) -> DataFrame:
    """Z-buffer: for each pixel the nearest point (least distance, then idx), how many points it has, and a confidence
    min(1, ln(1 + support) / ln(1 + limit))."""
    out = points.groupBy(*pixel).agg(F.min(F.struct(F.col(distance).alias("d"), F.col(idx).alias("i"))).alias("best"), F.count("*").alias("support"))
    confidence = F.least(F.lit(1.0), F.log1p(F.col("support")) / F.log1p(F.lit(float(limit))))
    return out.select(*pixel, F.col("best.i").alias(idx), F.col("best.d").alias(distance), "support", confidence.alias("confidence"))


def dense_grid(sparse: DataFrame, image: str, width: int, height: int, values: Sequence[str]) -> DataFrame:
    """Every pixel (image, px, py) of each image with the sparse values, 0 where there are none, and valid."""
    images = sparse.select(image).distinct()
    grid = images.select(image, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px")).select(image, "px", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py"))
    out = grid.join(sparse.withColumn("valid", F.lit(True)), [image, "px", "py"], "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0).cast(dict(sparse.dtypes)[v])) for v in values}).withColumn("valid", F.coalesce("valid", F.lit(False)))


def dilated(mask: DataFrame, image: str, radius: int, width: int, height: int) -> DataFrame:
    """mask (image, px, py) with all pixels of the image within radius (Euclidean), each once. Distances part by axis: a run
    of mask pixels in a row reaches, dy rows further, as far to both sides as sqrt(radius^2 - dy^2); a row's reaches are
    merged before they become pixels. So rows grow with runs times 2 radius + 1 and with the result."""
    c = F.col
    row = Window.partitionBy(image, "py").orderBy("px")
    runs = mask.select(image, "px", "py").distinct().withColumn("__run", c("px") - F.row_number().over(row))
    runs = runs.groupBy(image, "py", "__run").agg(F.min("px").alias("a"), F.max("px").alias("z"))
    wide = [int(math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)]
    reach = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in zip(range(-radius, radius + 1), wide, strict=True)])).alias("s")
    near = runs.select(image, "py", "a", "z", reach).select(image, (c("py") + c("s.dy")).alias("py"), F.greatest(c("a") - c("s.w"), F.lit(0)).alias("a"), F.least(c("z") + c("s.w"), F.lit(width - 1)).alias("z"))
    near = near.filter(c("py").between(0, height - 1) & (c("a") <= c("z"))).groupBy(image, "py", "a").agg(F.max("z").alias("z"))
    by_start = Window.partitionBy(image, "py").orderBy("a")
    fresh = F.coalesce(c("a") > F.max("z").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parts = near.withColumn("__n", fresh.cast("int")).withColumn("__n", F.sum("__n").over(by_start)).groupBy(image, "py", "__n").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return parts.select(image, F.explode(F.sequence("a", "z")).alias("px"), "py")


def instance_mask(pixels: DataFrame, image: str, score: str, value: str, least_score: float, least_value: float) -> DataFrame:
    """pixels of instances (image, px, py, score, value) -> the pixels (image, px, py) of any instance whose score, and whose
    value there, reach the thresholds."""
    return pixels.filter((F.col(score) >= least_score) & (F.col(value) >= least_value)).select(image, "px", "py").distinct()


def masked_buffer(nearest: DataFrame, mask: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """A z-buffer's pixels that mask has. The mask comes after the selection: a point behind a masked one stays hidden."""
    return nearest.join(mask.select(*pixel).distinct(), list(pixel), "left_semi")


def depth_edges(points: DataFrame, u: str, v: str, distance: str, limit: float, jump: float, k: int = 5, ident: str = "id") -> DataFrame:
    """points with edge: whether one of the k nearest points in the image (itself among them), no further than limit pixels,
    has a range whose logarithm differs by jump or more."""
    near = nearest(points, points, [u, v], k, ident).filter(F.col("distance") <= limit).select("q_id", "b_id")
    log = F.log(F.greatest(F.col(distance), F.lit(1e-6)))
    of = points.select(F.col(ident).alias("b_id"), log.alias("b_log"))
    q = points.select(F.col(ident).alias("q_id"), log.alias("q_log"))
    edges = near.join(of, "b_id").join(q, "q_id").groupBy("q_id").agg(F.max(F.abs(F.col("q_log") - F.col("b_log")) >= jump).alias("edge"))
    return points.join(edges.withColumnRenamed("q_id", ident), ident, "left").withColumn("edge", F.coalesce("edge", F.lit(False)))


def bracketed_poses(anchors: DataFrame, queries: DataFrame, time: str, axes: Sequence[str], q: str, by: Sequence[str] = (), spread: bool | None = None) -> DataFrame:
    """queries with the pose between the anchors before and after: axes on the line, q (unit quaternion) on the arc (SLERP);
    the nearest anchor's pose outside. spread as in windows.beside."""
    from .windows import known_around

    a = anchors.select(*by, time, *axes, q, F.lit(True).alias("is_anchor"))
    both = a.unionByName(queries.select(*by, *[c for c in queries.columns if c not in by], F.lit(False).alias("is_anchor")), allowMissingColumns=True)
    at = F.when(F.col("is_anchor"), F.struct(F.col(time).alias("t"), *axes, F.col(q).alias("q")))
    rows = known_around(both, by, time, at, "lo", "hi", spread).filter(~F.col("is_anchor")).drop("is_anchor", *axes, q)
    rows = rows.withColumn("lo", F.coalesce("lo", "hi")).withColumn("hi", F.coalesce("hi", "lo"))
    span = (F.col("hi.t") - F.col("lo.t")).cast("double")
    part = F.when(span > 0, (F.col(time) - F.col("lo.t")).cast("double") / span).otherwise(F.lit(0.0))
    line = {x: F.col(f"lo.{x}") + part * (F.col(f"hi.{x}") - F.col(f"lo.{x}")) for x in axes}
    return rows.withColumns(line).withColumn(q, geometry.slerp(F.col("lo.q"), F.col("hi.q"), part)).drop("lo", "hi")
