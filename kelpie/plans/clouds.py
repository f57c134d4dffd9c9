"""Queries over point tables: voxels, cameras, neighbours. SQL holds their twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import joins, voxel
from .tables import POINTS, points, table

SIZE, ORIGIN = 0.1, (-1.0, -1.0, -1.0)
K4 = [0.02, -0.003, 0.0002, 0.0]
FOCAL, CENTRE, RANGE, THETA = (20.0, 20.0), (31.5, 31.5), (0.05, 60.0), 1.5
r6 = lambda c: F.round(c, 6)


def voxel_representative(spark, d):
    """Nearest point to the centre of each occupied cell."""
    out = voxel.representatives(points(spark, d), SIZE, ORIGIN)
    return out.select("kx", "ky", "kz", "idx", r6("score").alias("score"), r6("x").alias("x"), "n_points")


def voxel_boundary(spark, d):
    """Representatives with a fifth of the cells taking their farthest point."""
    out = voxel.representatives(points(spark, d), SIZE, ORIGIN, edge_ratio=0.2, seed=7)
    return out.select("kx", "ky", "kz", "idx", r6("score").alias("score"), "n_points")


def voxel_merge(spark, d):
    """The same from two halves whose partial results are merged: any cut gives the same rows."""
    p = points(spark, d)
    halves = [voxel.representatives(p.filter(F.col("idx") % 2 == i), SIZE, ORIGIN) for i in (0, 1)]
    best = F.min(F.struct("score", "idx")).alias("b")
    out = halves[0].unionByName(halves[1]).groupBy("kx", "ky", "kz").agg(best, F.sum("n_points").alias("n_points"))
    return out.select("kx", "ky", "kz", "b.idx", r6("b.score").alias("score"), "n_points")


def voxel_coverage(spark, d):
    out = voxel.coverage(points(spark, d), SIZE, ORIGIN, 3)
    return out.select("cells", "stride_cells", r6("stride_coverage").alias("stride_coverage"), r6("gain").alias("gain"))


def voxel_search(spark, d):
    """The cells of the first ladder of sizes, by size; the one that is chosen is the finest with at most 200."""
    p = points(spark, d)
    _, counted = voxel.search_size(p, 200, jobs=1)
    chosen = max(n for _, n in counted if n <= 200)
    return spark.createDataFrame([(float(f"{s:.9g}"), n, n == chosen) for s, n in counted[1:]], "size double, cells bigint, chosen boolean").select(r6("size").alias("size"), "cells", "chosen")


def point_bounds(spark, d):
    return voxel.bounds(points(spark, d))


def fisheye_projection(spark, d):
    p = points(spark, d).withColumn("p", geometry.project(F.col("x"), F.col("y"), F.abs("z") + 0.05, FOCAL, CENTRE, K4, RANGE, THETA))
    inside = geometry.in_image(F.col("p.u"), F.col("p.v"), 64, 64)
    return p.select("idx", r6("p.u").alias("u"), r6("p.v").alias("v"), r6("p.range").alias("distance"), (F.col("p.valid") & inside).alias("visible"))


def _pixels(spark, d):
    """Embeddings as pixels of a 64 x 64 image."""
    return points(spark, d).select("idx", (F.col("x") * 60 + 31.5).alias("u"), (F.col("y") * 60 + 31.5).alias("v"))


def fisheye_round_trip(spark, d):
    """The rays of pixels, whose angle the twin finds by halving, and the pixels they project to."""
    ray = _pixels(spark, d).withColumn("r", geometry.unproject(F.col("u"), F.col("v"), FOCAL, CENTRE, K4))
    back = ray.withColumn("p", geometry.project(F.col("r.x"), F.col("r.y"), F.col("r.z"), FOCAL, CENTRE, K4, (0.0, 2.0), math.pi))
    return back.select("idx", *[r6(f"r.{a}").alias(a) for a in "xyz"], r6("p.u").alias("u"), r6("p.v").alias("v"))


def fisheye_mask(spark, d):
    """Lines as pixels: by row, how many lie in the image circle of 50 degrees, and its radius in pixels."""
    line = table(spark, d, "lineitem").select((F.col("l_suppkey") % 64).alias("px"), F.floor("l_quantity").alias("py"))
    on = geometry.in_fisheye_circle(F.col("px"), F.col("py"), FOCAL, CENTRE, K4, math.radians(50))
    radius = geometry.radius_px(FOCAL, K4, F.lit(math.radians(50)))
    return line.filter(on).groupBy("py").agg(F.count("*").alias("n"), F.min("px").alias("first"), F.max("px").alias("last")).withColumn("radius", r6(radius))


def _poses(spark, d):
    e = F.col("embedding")
    q = F.struct(*[e[i].cast("double").alias(k) for i, k in enumerate("xyzw")])
    return table(spark, d, "embeddings").select("vec_id", q.alias("q"), F.array(*[e[i].cast("double") for i in (4, 5, 6)]).alias("t"))


def pose_round_trip(spark, d):
    """Quaternion -> transform -> quaternion; inverse and rigidity of the transform."""
    p = _poses(spark, d).withColumn("r", geometry.quaternion_to_rotation(F.col("q"))).withColumn("m", geometry.transform(F.col("r"), F.col("t")))
    p = p.withColumn("b", geometry.rotation_to_quaternion(F.col("r"))).withColumn("n", geometry.quaternion_norm(F.col("q")))
    q, b = F.col("q"), F.col("b")
    dot = F.abs(sum((q[k] * b[k] for k in ("y", "z", "w")), q["x"] * b["x"])) / F.col("n")
    angle = geometry.rotation_angle(F.col("r"), geometry.rotation_of(geometry.inverse(geometry.inverse(F.col("m")))))
    return p.select("vec_id", (F.abs(dot - 1) < 1e-9).alias("same"), geometry.is_rigid(F.col("m")).alias("rigid"), (angle < 1e-9).alias("inverse_twice"), r6(F.element_at(F.col("m"), 1)).alias("m00"), r6(F.element_at(geometry.gl_to_cv(F.col("m")), 2)).alias("cv01"))


def rotation_between(spark, d):
    """Radians between the rotations of neighbours in vec_id order."""
    p = _poses(spark, d).withColumn("r", geometry.quaternion_to_rotation(F.col("q")))
    a, b = p.select("vec_id", F.col("r").alias("ra")), p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("rb"))
    return a.join(b, "vec_id").select("vec_id", r6(geometry.rotation_angle(F.col("ra"), F.col("rb"))).alias("angle"))


def slerp_halfway(spark, d):
    """Halfway along the shorter arc is the sign-aligned mean; both within rounding."""
    unit = lambda q: F.struct(*[(q[k] / geometry.quaternion_norm(q)).alias(k) for k in ("x", "y", "z", "w")])
    p = _poses(spark, d).select("vec_id", unit(F.col("q")).alias("a"))
    both = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    s = geometry.slerp(F.col("a"), F.col("b"), F.lit(0.5))
    m = geometry.mean_quaternion(F.col("a"), F.col("b"))
    near = sum((F.abs(s[k] - m[k]) for k in ("y", "z", "w")), F.abs(s["x"] - m["x"])) < 1e-6
    return both.select("vec_id", near.alias("same"), r6(m["w"]).alias("w"))


def depth_buffer(spark, d):
    """lineitem as points: pixel (quantity, line), nearest by price, ties by (order, line)."""
    p = table(spark, d, "lineitem").select(F.floor("l_quantity").cast("int").alias("px"), F.col("l_linenumber").alias("py"), F.col("l_extendedprice").alias("distance"), F.struct("l_orderkey", "l_linenumber").alias("idx"))
    out = joins.nearest_pixels(p, "idx", ["px", "py"], "distance")
    return out.select("px", "py", F.col("idx.l_orderkey").alias("orderkey"), "distance", "support", r6("confidence").alias("confidence"))


def dense_depth(spark, d):
    """The sparse buffer on its full grid: valid pixels and sums by row."""
    p = points(spark, d).select("idx", F.lit(0).alias("image"), F.floor((F.col("x") + 1) * 8).cast("int").alias("px"), F.floor((F.col("y") + 1) * 8).cast("int").alias("py"), F.round(F.abs("z"), 6).alias("distance"))
    sparse = joins.nearest_pixels(p, "idx", ["image", "px", "py"], "distance").drop("idx")
    grid = joins.dense_grid(sparse, "image", 16, 16, ["distance", "support"])
    return grid.groupBy("py").agg(F.count_if("valid").alias("valid"), F.sum("support").alias("support"), r6(F.sum("distance")).alias("distance"), F.count("*").alias("pixels"))


def mask_dilation(spark, d):
    """The pixels of every label, grown by 2."""
    p = points(spark, d).select("label", F.floor((F.col("x") + 1) * 16).cast("int").alias("px"), F.floor((F.col("y") + 1) * 16).cast("int").alias("py"))
    return joins.dilated(p, "label", 2, 32, 32)


def radius_edges(spark, d):
    """The four nearest within 0.15 and 30 places away."""
    p = points(spark, d).withColumn("pos", F.col("idx"))
    return joins.radius_top_k(p, ["x", "y", "z"], 0.15, 4, "idx", "pos", 30).select("a_id", "b_id", r6("distance").alias("distance"), "rank")


def match_graph(spark, d):
    """Neighbours in order, radius loops, canonical pairs with reasons."""
    p = points(spark, d).withColumn("pos", F.col("idx"))
    near = joins.neighbour_edges(p, "idx", ["idx"], 4, F.col("label") < 5).select("a", "b", F.lit("temporal").alias("reason"), F.lit(None).cast("double").alias("distance"))
    loops = joins.radius_top_k(p.filter("label < 5"), ["x", "y", "z"], 0.15, 4, "idx", "pos", 5).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.lit("loop").alias("reason"), "distance")
    edges = joins.canonical_edges(near.unionByName(loops))
    return edges.select("a", "b", F.array_join("reasons", "+").alias("reasons"), r6("distance").alias("distance"))


def match_reasons(spark, d):
    edges = match_graph(spark, d).withColumn("reasons", F.split("reasons", r"\+"))
    return joins.reason_counts(edges)


def split_leakage(spark, d):
    """The nearest train point of each validation point."""
    p = points(spark, d)
    out = joins.leakage(p.filter("idx % 10 = 0"), p.filter("idx % 10 <> 0"), ["x", "y", "z"], 0.08, "idx")
    return out.select("q_id", "b_id", r6("distance").alias("distance"), "leak")


def nearest_five(spark, d):
    p = points(spark, d)
    return joins.nearest(p, p, ["x", "y", "z"], 5, "idx").select("q_id", "b_id", r6("distance").alias("distance"), "rank")


def uneven_neighbours(spark, d):
    """The three nearest points of a cloud that is much denser at its middle, dense cells halved; the twin compares all."""
    p = points(spark, d).select("idx", *[(F.col(a) * F.col(a) * F.col(a)).alias(a) for a in "xyz"])
    return joins.nearest(p, p, ["x", "y", "z"], 3, "idx", dense=32).select("q_id", "b_id", F.round("distance", 9).alias("distance"), "rank")


def local_covariance(spark, d):
    out = joins.local_moments(points(spark, d), ["x", "y", "z"], 16, "idx")
    return out.select("idx", "n", *[r6(c).alias(c) for c in ("mean_x", "mean_y", "mean_z", "m_xx", "m_xy", "m_xz", "m_yy", "m_yz", "m_zz")])


def local_normals(spark, d):
    """Normals and spreads of neighbourhoods; the twin solves the characteristic polynomial."""
    out = joins.local_geometry(points(spark, d), 16, "idx")
    return out.select("idx", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")], *[F.round(c, 8).alias(c) for c in ("e0", "e1", "e2")])


def pair_distance_median(spark, d):
    out = joins.median_pair_distance(points(spark, d), ["x", "y", "z"], "idx")
    return out.select(r6("median_distance").alias("median_distance"), "pairs")


_KEYS = f"k AS (SELECT *, floor((x + 1.0::double) / {SIZE}::double)::bigint AS kx, floor((y + 1.0::double) / {SIZE}::double)::bigint AS ky, floor((z + 1.0::double) / {SIZE}::double)::bigint AS kz FROM pts)"
_D2 = " + ".join(f"pow({a} - (-1.0::double + (k{a} + 0.5::double) * {SIZE}::double), 2)" for a in "xyz")
_HASH = " , ".join(f"(({k}::UHUGEINT * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT" for k, m in zip(("kx", "ky", "kz"), voxel.AXIS_MULTIPLIERS))
_HX, _HY, _HZ = _HASH.split(" , ")
_EDGE = f"xor(xor(xor(7::UBIGINT, {_HX}), {_HY}), {_HZ}) <= {round(0.2 * (2**64 - 1))}::UBIGINT"
_DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_K = "0.02::double", "-0.003::double", "0.0002::double"
_TD = "theta * (1 + theta*theta * (0.02::double + theta*theta * (-0.003::double + theta*theta * 0.0002::double)))"
_LOOP = f"""near AS (SELECT a.idx AS a_id, b.idx AS b_id, b.idx AS b_pos, {_DIST} AS distance FROM p a, p b WHERE a.idx <> b.idx AND {_DIST} <= 0.15::double AND abs(a.idx - b.idx) >= {{gap}}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_pos) AS rank FROM near)"""
_GRAPH = f"""WITH {POINTS}, n AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM pts), p AS (SELECT * FROM n WHERE label < 5),
{_LOOP.format(gap=5)},
e AS (SELECT a.idx AS a, b.idx AS b, 'temporal' AS reason, NULL::double AS distance FROM p a, p b WHERE b.pos - a.pos BETWEEN 1 AND 4
      UNION ALL SELECT a_id, b_id, 'loop', distance FROM ranked WHERE rank <= 4),
g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, array_to_string(list_sort(list(DISTINCT reason)), '+') AS reasons, round(min(distance), 6) AS distance FROM e GROUP BY 1, 2)"""

_NEAR = f"n AS (SELECT a.idx AS q_id, b.*, row_number() OVER (PARTITION BY a.idx ORDER BY {_DIST}, b.idx) AS rank FROM pts a, pts b)"

SQL = {
    "voxel_search": f"""WITH {POINTS}, b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, 2 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS top FROM pts),
r AS (SELECT top * pow(1.0::double / 402, i / 9.0::double) AS size, i FROM b, range(1, 9) t(i)),
c AS (SELECT size, count(DISTINCT (floor((x - x0) / size), floor((y - y0) / size), floor((z - z0) / size))) AS cells FROM pts, b, r GROUP BY size)
SELECT round(size, 6) AS size, cells, cells = max(CASE WHEN cells <= 200 THEN cells END) OVER () AS chosen FROM c""",
    "voxel_representative": f"WITH {POINTS}, {_KEYS}, s AS (SELECT *, {_D2} AS score FROM k) SELECT kx, ky, kz, arg_min(idx, row(score, idx)) AS idx, round(min(score), 6) AS score, round(arg_min(x, row(score, idx)), 6) AS x, count(*) AS n_points FROM s GROUP BY kx, ky, kz",
    "voxel_boundary": f"WITH {POINTS}, {_KEYS}, s AS (SELECT *, CASE WHEN {_EDGE} THEN -({_D2}) ELSE {_D2} END AS score FROM k) SELECT kx, ky, kz, arg_min(idx, row(score, idx)) AS idx, round(min(score), 6) AS score, count(*) AS n_points FROM s GROUP BY kx, ky, kz",
    "voxel_merge": f"WITH {POINTS}, {_KEYS}, s AS (SELECT *, {_D2} AS score FROM k) SELECT kx, ky, kz, arg_min(idx, row(score, idx)) AS idx, round(min(score), 6) AS score, count(*) AS n_points FROM s GROUP BY kx, ky, kz",
    "voxel_coverage": f"WITH {POINTS}, {_KEYS}, c AS (SELECT kx, ky, kz, max(CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END) AS hit FROM k GROUP BY ALL) SELECT count(*) AS cells, sum(hit)::bigint AS stride_cells, round(sum(hit) / count(*), 6) AS stride_coverage, round(1 - sum(hit) / count(*), 6) AS gain FROM c",
    "point_bounds": f"WITH {POINTS} SELECT count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts",
    "fisheye_projection": f"""WITH {POINTS}, c AS (SELECT idx, x, y, abs(z) + 0.05::double AS z, sqrt(x*x + y*y) AS radial FROM pts), t AS (SELECT *, atan2(radial, z) AS theta, sqrt(x*x + y*y + z*z) AS rng FROM c),
s AS (SELECT *, CASE WHEN radial > 1e-12 THEN ({_TD}) / radial ELSE 0 END AS scale FROM t), u AS (SELECT *, 20 * x * scale + 31.5::double AS u, 20 * y * scale + 31.5::double AS v FROM s)
SELECT idx, round(u, 6) AS u, round(v, 6) AS v, round(rng, 6) AS distance, rng >= 0.05::double AND rng <= 60 AND theta <= 1.5::double AND u >= 0 AND u < 64 AND v >= 0 AND v < 64 AS visible FROM u""",
    "fisheye_round_trip": f"""WITH RECURSIVE {POINTS}, p AS (SELECT idx, x * 60 + 31.5::double AS u, y * 60 + 31.5::double AS v FROM pts), m AS (SELECT *, (u - 31.5::double) / 20 AS mx, (v - 31.5::double) / 20 AS my FROM p),
h AS (SELECT idx, u, v, mx, my, sqrt(mx*mx + my*my) AS rd, 0.0::double AS lo, pi() AS hi, 0 AS i FROM m
  UNION ALL SELECT idx, u, v, mx, my, rd, CASE WHEN td < rd THEN theta ELSE lo END, CASE WHEN td < rd THEN hi ELSE theta END, i + 1 FROM (SELECT *, {_TD} AS td FROM (SELECT *, (lo + hi) / 2 AS theta FROM h WHERE i < 60)))
SELECT idx, round(mx * sin(lo) / rd, 6) AS x, round(my * sin(lo) / rd, 6) AS y, round(cos(lo), 6) AS z, round(u, 6) AS u, round(v, 6) AS v FROM h WHERE i = 60""",
    "fisheye_mask": f"WITH g AS (SELECT l_suppkey % 64 AS px, floor(l_quantity)::bigint AS py, {math.radians(50)}::double AS theta FROM lineitem) SELECT py, count(*) AS n, min(px) AS first, max(px) AS last, round(any_value(20 * ({_TD})), 6) AS radius FROM g WHERE sqrt(pow((px - 31.5::double) / 20, 2) + pow((py - 31.5::double) / 20, 2)) <= {_TD} GROUP BY py",
    "pose_round_trip": """WITH q AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS w FROM embeddings), n AS (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM q)
SELECT vec_id, true AS same, true AS rigid, true AS inverse_twice, round(1 - 2 * (y*y + z*z) / (n*n), 6) AS m00, round(-2 * (x*y - z*w) / (n*n), 6) AS cv01 FROM n""",
    "rotation_between": """WITH q AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS w FROM embeddings), u AS (SELECT vec_id, x/n AS x, y/n AS y, z/n AS z, w/n AS w FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM q)),
r AS (SELECT a.vec_id, a.w*b.w + a.x*b.x + a.y*b.y + a.z*b.z AS c, a.w*b.x - a.x*b.w - a.y*b.z + a.z*b.y AS i, a.w*b.y + a.x*b.z - a.y*b.w - a.z*b.x AS j, a.w*b.z - a.x*b.y + a.y*b.x - a.z*b.w AS k FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(2 * atan2(sqrt(i*i + j*j + k*k), abs(c)), 6) AS angle FROM r""",
    "slerp_halfway": """WITH q AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS w FROM embeddings), u AS (SELECT vec_id, x/n AS x, y/n AS y, z/n AS z, w/n AS w FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM q)),
s AS (SELECT a.vec_id, CASE WHEN a.x*b.x + a.y*b.y + a.z*b.z + a.w*b.w < 0 THEN -1 ELSE 1 END AS g, a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, b.x AS bx, b.y AS by_, b.z AS bz, b.w AS bw FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, true AS same, round((aw + g*bw) / sqrt(pow(ax + g*bx, 2) + pow(ay + g*by_, 2) + pow(az + g*bz, 2) + pow(aw + g*bw, 2)), 6) AS w FROM s""",
    "depth_buffer": """SELECT floor(l_quantity)::int AS px, l_linenumber AS py, arg_min(l_orderkey, row(l_extendedprice, l_orderkey, l_linenumber)) AS orderkey, min(l_extendedprice) AS distance, count(*) AS support,
round(least(1.0::double, ln(1 + count(*)) / ln(4::double)), 6) AS confidence FROM lineitem GROUP BY 1, 2""",
    "dense_depth": f"""WITH {POINTS}, p AS (SELECT floor((x + 1) * 8)::int AS px, floor((y + 1) * 8)::int AS py, min(round(abs(z), 6)) AS distance, count(*) AS support FROM pts GROUP BY 1, 2), g AS (SELECT a.i AS px, b.i AS py FROM range(16) a(i), range(16) b(i))
SELECT g.py::int AS py, count(p.support) AS valid, coalesce(sum(support), 0)::bigint AS support, round(coalesce(sum(distance), 0), 6) AS distance, count(*) AS pixels FROM g LEFT JOIN p ON g.px = p.px AND g.py = p.py GROUP BY g.py""",
    "mask_dilation": f"""WITH {POINTS}, p AS (SELECT DISTINCT label, floor((x + 1) * 16)::int AS px, floor((y + 1) * 16)::int AS py FROM pts), s AS (SELECT a.i - 2 AS dx, b.i - 2 AS dy FROM range(5) a(i), range(5) b(i) WHERE pow(a.i - 2, 2) + pow(b.i - 2, 2) <= 4)
SELECT DISTINCT label, (px + dx)::int AS px, (py + dy)::int AS py FROM p, s WHERE px + dx BETWEEN 0 AND 31 AND py + dy BETWEEN 0 AND 31""",
    "radius_edges": f"WITH {POINTS}, p AS (SELECT * FROM pts), {_LOOP.format(gap=30)} SELECT a_id, b_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 4",
    "match_graph": f"{_GRAPH} SELECT * FROM g",
    "match_reasons": f"{_GRAPH}, r AS (SELECT unnest(string_split(reasons, '+')) AS reason FROM g) SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "split_leakage": f"""WITH {POINTS}, n AS (SELECT a.idx AS q_id, b.idx AS b_id, {_DIST} AS distance, row_number() OVER (PARTITION BY a.idx ORDER BY {_DIST}, b.idx) AS r FROM pts a, pts b WHERE a.idx % 10 = 0 AND b.idx % 10 <> 0)
SELECT q_id, b_id, round(distance, 6) AS distance, distance < 0.08::double AS leak FROM n WHERE r = 1""",
    "nearest_five": f"""WITH {POINTS}, n AS (SELECT a.idx AS q_id, b.idx AS b_id, {_DIST} AS distance, row_number() OVER (PARTITION BY a.idx ORDER BY {_DIST}, b.idx) AS rank FROM pts a, pts b)
SELECT q_id, b_id, round(distance, 6) AS distance, rank FROM n WHERE rank <= 5""",
    "uneven_neighbours": f"""WITH {POINTS}, p AS (SELECT idx, {", ".join(f"{a}*{a}*{a} AS {a}" for a in "xyz")} FROM pts),
n AS (SELECT a.idx AS q_id, b.idx AS b_id, {_DIST} AS distance, row_number() OVER (PARTITION BY a.idx ORDER BY {_DIST}, b.idx) AS rank FROM p a, p b)
SELECT q_id, b_id, round(distance, 9) AS distance, rank FROM n WHERE rank <= 3""",
    "local_covariance": f"""WITH {POINTS}, {_NEAR}
SELECT q_id AS idx, count(*) AS n, {", ".join(f"round(avg({a}), 6) AS mean_{a}" for a in "xyz")}, {", ".join(f"round(covar_samp({a}, {b}), 6) AS m_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM n WHERE rank <= 16 GROUP BY q_id""",
    "local_normals": f"""WITH {POINTS}, {_NEAR}, m AS (SELECT q_id AS idx, {", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM n WHERE rank <= 16 GROUP BY q_id),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz*yz) - xy * (xy * (zz - q) - yz*xz) + xz * (xy*yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM p),
h AS (SELECT *, acos(greatest(-1.0::double, least(1.0::double, r))) / 3 AS phi FROM r), e AS (SELECT *, q + 2 * p * cos(phi) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e0 FROM h),
a AS (SELECT *, xx - e0 AS a, yy - e0 AS b, zz - e0 AS c FROM e),
c AS (SELECT *, [[xy*yz - xz*b, xz*xy - a*yz, a*b - xy*xy], [xy*c - xz*yz, xz*xz - a*c, a*yz - xy*xz], [b*c - yz*yz, yz*xz - xy*c, xy*yz - b*xz]] AS s FROM a),
l AS (SELECT *, list_transform(s, lambda v: sqrt(v[1]*v[1] + v[2]*v[2] + v[3]*v[3])) AS n FROM c), v AS (SELECT *, s[list_position(n, list_max(n))] AS w, list_max(n) AS len FROM l),
g AS (SELECT *, CASE WHEN w[list_position(list_transform(w, lambda x: abs(x)), list_max(list_transform(w, lambda x: abs(x))))] < 0 THEN -len ELSE len END AS g FROM v)
SELECT idx, round(w[1] / g, 5) AS nx, round(w[2] / g, 5) AS ny, round(w[3] / g, 5) AS nz, round(e0, 8) AS e0, round(3 * q - e0 - e2, 8) AS e1, round(e2, 8) AS e2 FROM g""",
    "pair_distance_median": f"WITH {POINTS}, d AS (SELECT {_DIST} AS d FROM pts a, pts b WHERE a.idx < b.idx) SELECT round(quantile_cont(d, 0.5), 6) AS median_distance, count(*) AS pairs FROM d WHERE d > 1e-9",
}
QUERIES = [
    voxel_representative, voxel_boundary, voxel_merge, voxel_coverage, voxel_search, point_bounds, fisheye_projection, fisheye_round_trip, fisheye_mask,
    pose_round_trip, rotation_between, slerp_halfway, depth_buffer, dense_depth, mask_dilation, radius_edges, match_graph, match_reasons, split_leakage,
    nearest_five, uneven_neighbours, local_covariance, local_normals, pair_distance_median,
]


def camera_views(spark, d):
    """Every point in each of three cameras: a camera table as a constant array, so no cross join."""
    cameras = F.explode(F.array(*[F.struct(F.lit(i).alias("camera"), F.lit(0.1 * i).alias("cx")) for i in range(3)])).alias("c")
    p = points(spark, d).select("idx", "x", "y", "z", cameras)
    v = geometry.project(F.col("x") - F.col("c.cx"), F.col("y"), F.abs("z") + 0.05, FOCAL, CENTRE, K4, RANGE, THETA)
    seen = p.withColumn("v", v).filter(F.col("v.valid") & geometry.in_image(F.col("v.u"), F.col("v.v"), 64, 64))
    return seen.groupBy("c.camera").agg(F.count("*").alias("n"), r6(F.percentile("v.range", 0.5)).alias("p50"))


_UV = f"""c AS (SELECT *, sqrt(x*x + y*y) AS radial FROM s), t AS (SELECT *, atan2(radial, z) AS theta, sqrt(x*x + y*y + z*z) AS rng FROM c),
k AS (SELECT *, CASE WHEN radial > 1e-12 THEN ({_TD}) / radial ELSE 0 END AS scale FROM t), u AS (SELECT *, 20 * x * scale + 31.5::double AS u, 20 * y * scale + 31.5::double AS v FROM k)"""
SQL |= {
    "camera_views": f"WITH {POINTS}, s AS (SELECT idx, i::int AS camera, x - 0.1::double * i AS x, y, abs(z) + 0.05::double AS z FROM pts, range(3) r(i)), {_UV} SELECT camera, count(*) AS n, round(quantile_cont(rng, 0.5), 6) AS p50 FROM u WHERE rng >= 0.05 AND rng <= 60 AND theta <= 1.5 AND u >= 0 AND u < 64 AND v >= 0 AND v < 64 GROUP BY camera",
}
QUERIES += [camera_views]
