"""Queries of points and tracks seen by camera tables made from embeddings and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import cameras, joins
from .tables import POINTS, points, table

BLOCK, RANGE, THETA = 0.1, (0.02, 0.4), 0.6
K4 = (0.02, -0.003, 0.0002, 0.0)
r6 = lambda c: F.round(c, 6)


def _poses(spark, d):
    """vec_id, m: the rotation of the first four numbers and the place of the next three."""
    e = lambda i: F.col("embedding")[i].cast("double")
    r = geometry.quaternion_to_rotation(F.struct(*[e(i).alias(k) for i, k in enumerate("xyzw")]))
    return table(spark, d, "embeddings").select("vec_id", geometry.transform(r, F.array(e(4), e(5), e(6))).alias("m"))


def _lens(f: float, c: float, side: int):
    lit = lambda v: F.lit(float(v))
    return [lit(f).alias("fx"), lit(f).alias("fy"), lit(c).alias("cx"), lit(c).alias("cy"), F.array(*map(lit, K4)).alias("k"), F.lit(side).alias("width"), F.lit(side).alias("height")]


def _cameras(spark, d):
    return _poses(spark, d).select(F.col("vec_id").alias("image"), "m", *_lens(40.0, 31.5, 64))


def camera_depth(spark, d):
    """Every embedding as a point and as a camera: the nearest point of each pixel of each camera."""
    out = cameras.depth_maps(points(spark, d), _cameras(spark, d), BLOCK, RANGE, THETA)
    return out.select("image", "pixel", "idx", r6("distance").alias("distance"), "support", r6("confidence").alias("confidence"))


def masked_camera_depth(spark, d):
    """The same where the pixels of the camera's own line number may be used only."""
    mask = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("image"), F.floor("l_quantity").cast("int").alias("px"), (F.col("l_suppkey") % 64).cast("int").alias("py"))
    out = cameras.depth_maps(points(spark, d), _cameras(spark, d), BLOCK, RANGE, THETA, mask)
    return out.groupBy("image").agg(F.count("*").alias("pixels"), F.sum("support").alias("support"), r6(F.min("distance")).alias("nearest"))


def camera_blocks(spark, d):
    """How many blocks each camera may see, and how many points they hold."""
    cloud = cameras.blocks(points(spark, d), BLOCK)
    pairs = cameras.block_pairs(cloud, _cameras(spark, d), BLOCK, RANGE, THETA)
    return pairs.join(cloud, ["b0", "b1", "b2"]).groupBy("image").agg(F.count("*").alias("blocks"), F.sum("n").alias("points"))


def _rig(spark, d):
    """Forty images of twenty rigs: two sensors 0.1 apart."""
    image = F.col("id")
    images = table(spark, d, "embeddings").filter("vec_id < 40").select(F.col("vec_id").alias("id")).select(image.alias("image"), (image - image % 2).alias("frame"), (image % 2).alias("camera"))
    frames = _poses(spark, d).withColumnRenamed("vec_id", "frame")
    shift = lambda x: F.array(*[F.lit(float(v)) for v in (1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    both = F.array(*[F.struct(F.lit(i).cast("bigint").alias("camera"), shift(0.1 * i - 0.05).alias("m")) for i in (0, 1)])
    sensors = table(spark, d, "region").filter("r_regionkey = 0").select(F.explode(both).alias("s")).select("s.*", *_lens(40.0, 31.5, 64))
    return cameras.rig_cameras(images, frames, sensors)


def reprojection_errors(spark, d):
    """Lines as observations: of the point of their part, in one of forty images, at a pixel by quantity and discount."""
    line = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 500).alias("idx"), (F.col("l_suppkey") % 40).alias("image"), F.col("l_quantity").cast("double").alias("u"), (F.col("l_discount") * 600).cast("double").alias("v"), "l_orderkey", "l_linenumber"
    )
    tracks = line.groupBy("idx").agg(F.collect_list(F.struct("image", "u", "v", "l_orderkey", "l_linenumber")).alias("track"))
    out = cameras.reprojection_errors(tracks, points(spark, d), _rig(spark, d))
    return out.select("l_orderkey", "l_linenumber", "idx", "image", F.round("error", 5).alias("error"))


_ROT = """q AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS w, embedding[5]::double AS t0, embedding[6]::double AS t1, embedding[7]::double AS t2 FROM embeddings),
n AS (SELECT vec_id, x/n AS x, y/n AS y, z/n AS z, w/n AS w, t0, t1, t2 FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM q)),
cam AS (SELECT vec_id AS image, t0, t1, t2, 1 - 2*(y*y + z*z) AS r00, 2*(x*y - z*w) AS r01, 2*(x*z + y*w) AS r02, 2*(x*y + z*w) AS r10, 1 - 2*(x*x + z*z) AS r11, 2*(y*z - x*w) AS r12, 2*(x*z - y*w) AS r20, 2*(y*z + x*w) AS r21, 1 - 2*(x*x + y*y) AS r22 FROM n)"""
_TD = "theta * (1 + theta*theta * (0.02::double + theta*theta * (-0.003::double + theta*theta * 0.0002::double)))"
_SEE = f"""d AS (SELECT *, x - t0 AS dx, y - t1 AS dy, z - t2 AS dz FROM {{rows}}),
a AS (SELECT *, r00*dx + r10*dy + r20*dz AS ax, r01*dx + r11*dy + r21*dz AS ay, r02*dx + r12*dy + r22*dz AS az FROM d),
b AS (SELECT *, sqrt(ax*ax + ay*ay) AS radial, sqrt(ax*ax + ay*ay + az*az) AS rng FROM a), c AS (SELECT *, atan2(radial, az) AS theta FROM b),
e AS (SELECT *, CASE WHEN radial > 1e-12 THEN ({_TD}) / radial ELSE 0 END AS scale FROM c), uv AS (SELECT *, 40 * ax * scale + 31.5::double AS pu, 40 * ay * scale + 31.5::double AS pv FROM e)"""
_HITS = f"""WITH {POINTS}, {_ROT}, {_SEE.format(rows="pts, cam")},
s AS (SELECT image, idx, rng, round_even(pu, 0)::int AS px, round_even(pv, 0)::int AS py, sqrt(pow(pu - round_even(pu, 0), 2) + pow(pv - round_even(pv, 0), 2)) AS gap FROM uv WHERE rng >= 0.02::double AND rng <= 0.4::double AND theta <= 0.6::double),
z AS (SELECT image, px, py, arg_min(idx, row(rng, idx)) AS idx, min(rng) AS distance, count(*) AS support, arg_min(gap, row(rng, idx)) AS gap FROM s WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 63 GROUP BY image, px, py)"""
SQL = {
    "camera_depth": f"{_HITS} SELECT image, (py * 64 + px)::bigint AS pixel, idx, round(distance, 6) AS distance, support, round(exp(-gap * gap / (2 * 0.75::double * 0.75::double)) * least(1.0::double, ln(1 + support) / ln(4::double)), 6) AS confidence FROM z",
    "masked_camera_depth": f"{_HITS}, m AS (SELECT DISTINCT l_partkey % 500 AS image, floor(l_quantity)::int AS px, (l_suppkey % 64)::int AS py FROM lineitem) SELECT image, count(*) AS pixels, sum(support)::bigint AS support, round(min(distance), 6) AS nearest FROM z SEMI JOIN m USING (image, px, py) GROUP BY image",
    "camera_blocks": f"""WITH {POINTS}, {_ROT}, b AS (SELECT count(*) AS n, (min(x) + max(x)) / 2 AS c0, (min(y) + max(y)) / 2 AS c1, (min(z) + max(z)) / 2 AS c2,
  sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) / 2 + 1e-9::double AS r FROM pts GROUP BY floor(x / 0.1::double), floor(y / 0.1::double), floor(z / 0.1::double)),
p AS (SELECT *, sqrt(pow(c0 - t0, 2) + pow(c1 - t1, 2) + pow(c2 - t2, 2)) AS away, (c0 - t0) * r02 + (c1 - t1) * r12 + (c2 - t2) * r22 AS ahead FROM b, cam)
SELECT image, count(*) AS blocks, sum(n)::bigint AS points FROM p WHERE away - r <= 0.4::double AND away + r >= 0.02::double
  AND (away <= r OR acos(greatest(-1.0::double, least(1.0::double, ahead / away))) - asin(least(1.0::double, r / away)) <= 0.6::double + 1e-9::double) GROUP BY image""",
    "reprojection_errors": f"""WITH {POINTS}, {_ROT}, rig AS (SELECT i.image, c.r00, c.r01, c.r02, c.r10, c.r11, c.r12, c.r20, c.r21, c.r22,
  c.t0 + c.r00 * i.s AS t0, c.t1 + c.r10 * i.s AS t1, c.t2 + c.r20 * i.s AS t2 FROM (SELECT vec_id AS image, vec_id - vec_id % 2 AS frame, 0.1::double * (vec_id % 2) - 0.05::double AS s FROM embeddings WHERE vec_id < 40) i JOIN cam c ON c.image = i.frame),
o AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS idx, l_suppkey % 40 AS image, l_quantity::double AS u, (l_discount * 600)::double AS v FROM lineitem),
j AS (SELECT * FROM o JOIN pts USING (idx) JOIN rig USING (image)), {_SEE.format(rows="j")}
SELECT l_orderkey, l_linenumber, idx, image, round(sqrt(pow(pu - u, 2) + pow(pv - v, 2)), 5) AS error FROM uv WHERE theta <= pi() / 2""",
}
QUERIES = [camera_depth, masked_camera_depth, camera_blocks, reprojection_errors]
