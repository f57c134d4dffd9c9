"""Queries of cloud scans, clouds written and read back, rigs and their pose errors, acceptance of refined poses and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import integrity, joins, manifests, reports, stats, voxel
from ..operators.scratch import scratch_path
from ..sources import arrays, clouds, staged
from .tables import POINTS, TIMED, points, table, timed

r6 = lambda c: F.round(c, 6)

#: The calibrated pose from right to left of the rigs below: a baseline of 0.1 m.
BASELINE = [1.0, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def _coloured(spark, d):
    """Points with 16-bit colours; every seventh is black."""
    i = F.col("idx")
    lit = lambda c: F.when(i % 7 == 0, 0).otherwise(c).cast("int")
    return points(spark, d).withColumns({"red": lit((i * 7919) % 65536), "green": lit((i * 31) % 256), "blue": lit(F.col("label") * 20)})


def cloud_bounds(spark, d):
    """The scan of a coloured cloud: bounds, extent and black share."""
    s = clouds.scan_summary(_coloured(spark, d))
    return s.select("n_points", *[r6(f"{p}_{a}").alias(f"{p}_{a}") for a in "xyz" for p in ("min", "max", "extent")], r6("black_fraction").alias("black_fraction"))


def channel_colours(spark, d):
    return clouds.channel_colours(_coloured(spark, d))


def pooled_colours(spark, d):
    return clouds.pooled_colours(_coloured(spark, d))


def written_cloud(spark, d):
    """The representatives of cells, whose number the cells' size bounds, written as a PLY file and read back."""
    p = _coloured(spark, d).withColumns({c: F.col(c) % 256 for c in clouds.CHANNELS})
    cells = voxel.representatives(p.select("idx", "x", "y", "z"), 0.05, (-8.0, -8.0, -8.0)).select("idx", "x", "y", "z")
    path = scratch_path(spark, "cells") + ".ply"
    clouds.write_ply(cells.join(p.select("idx", *clouds.CHANNELS), "idx"), path)
    return clouds.ply(spark, path).select("idx", *[r6(F.col(a).cast("double")).alias(a) for a in "xyz"], *clouds.CHANNELS)


def rig_frame_rows(spark, d):
    """View and click events within a minute as frames of a rig, with a stable id, floor-mean time and signed delta."""
    e = timed(spark, d)
    side = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "t")
    return joins.rig_frames(side("view"), side("click"), 60_000_000)[0]


def _rig_errors(spark, d):
    """Embeddings as left poses; right ones stand at the baseline, but for a turn about z and a step along it."""
    k = F.col("vec_id")
    raw = F.struct(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyzw")])
    turn, at = geometry.quaternion_to_rotation(raw), F.array(*[F.col("embedding")[i].cast("double") for i in (4, 5, 6)])
    a, zero, one = (k % 7) / 1000.0, F.lit(0.0), F.lit(1.0)
    off = F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one)
    step = F.array(F.lit(0.1), zero, (k % 5) / 100.0)
    e = table(spark, d, "embeddings").select("vec_id", turn.alias("turn"), at.alias("at"), off.alias("off"), step.alias("step"))
    moved = F.zip_with(F.col("at"), geometry.applied(F.col("turn"), F.col("step")), lambda p, q: p + q)
    left = e.select((F.col("vec_id") * 2).alias("id"), geometry.transform(F.col("turn"), F.col("at")).alias("m"))
    right = e.select((F.col("vec_id") * 2 + 1).alias("id"), geometry.transform(geometry.times(F.col("turn"), F.col("off")), moved).alias("m"))
    frames = e.select(F.col("vec_id").alias("rig_id"), (F.col("vec_id") * 2).alias("l_id"), (F.col("vec_id") * 2 + 1).alias("r_id"))
    return joins.rig_errors(frames, left.unionByName(right), BASELINE)


def rig_errors(spark, d):
    return _rig_errors(spark, d).select("rig_id", *[r6(c).alias(c) for c in ("tx", "tz", "translation_error", "rotation_error")])


def rig_scatter(spark, d):
    """Distribution of the translation errors, and scatter of translation and rotation."""
    e = _rig_errors(spark, d)
    far = stats.distribution(e, "translation_error")
    spread = stats.scatter(e, ["tx", "tz", "rotation_error"])
    return far.crossJoin(spread).select("n", *[r6(c).alias(c) for c in ("p50", "p95", "max", "tx_scatter", "tz_scatter", "rotation_error_scatter")])


def refinement(spark, d):
    """Line items as pose candidates: the price before and after the discount are losses, tax and quantity are moves."""
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    losses = li.select(price.alias("before"), (price * (1 - F.col("l_discount").cast("double"))).alias("after"))
    moves = li.select(F.col("l_tax").cast("double").alias("metres"), (F.col("l_quantity").cast("double") / 20).alias("degrees"))
    return reports.refinement_gates(losses, moves).select("name", r6("value").alias("value"), "operator", "threshold", "passed")


def image_masks(spark, d):
    """Orders as images of customers' nations, each with its nation's mask."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("camera"), F.concat(F.lit("masks/"), "n_name", F.lit(".png")).alias("path"), F.sha2("n_name", 256).alias("sha256"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return manifests.image_masks(o.select(F.col("o_orderkey").alias("image_id"), F.col("c_nationkey").alias("camera")), n)


_COLOURED = f"{POINTS}, co AS (SELECT *, CASE WHEN idx % 7 = 0 THEN 0 ELSE (idx * 7919) % 65536 END AS red, CASE WHEN idx % 7 = 0 THEN 0 ELSE (idx * 31) % 256 END AS green, CASE WHEN idx % 7 = 0 THEN 0 ELSE label * 20 END AS blue FROM pts)"
_VALUES = "v AS (SELECT 'red' AS channel, red AS value FROM co UNION ALL SELECT 'green', green FROM co UNION ALL SELECT 'blue', blue FROM co)"
_FIGURES = "count(*) AS n, min(value) AS min, min(value) FILTER (run >= ceil(0.5 * total)) AS median, min(value) FILTER (run >= ceil(0.99 * total)) AS p99, max(value) AS max"
_PAIRED = """c AS (SELECT v.event_id AS l_id, k.event_id AS r_id, v.t AS l_t, k.t AS r_t, abs(v.t - k.t) AS dt FROM ev v JOIN ev k ON v.event_type = 'view' AND k.event_type = 'click' AND abs(v.t - k.t) <= 60000000),
o AS (SELECT *, row_number() OVER (ORDER BY dt, l_t, r_t, l_id, r_id) AS n FROM c),
g(n, l, r, l_id, r_id, l_t, r_t, ok) AS (SELECT 0::bigint, []::bigint[], []::bigint[], NULL::bigint, NULL::bigint, NULL::bigint, NULL::bigint, false
  UNION ALL SELECT o.n, CASE WHEN list_contains(g.l, o.l_id) OR list_contains(g.r, o.r_id) THEN g.l ELSE list_append(g.l, o.l_id) END,
    CASE WHEN list_contains(g.l, o.l_id) OR list_contains(g.r, o.r_id) THEN g.r ELSE list_append(g.r, o.r_id) END, o.l_id, o.r_id, o.l_t, o.r_t,
    NOT (list_contains(g.l, o.l_id) OR list_contains(g.r, o.r_id)) FROM g JOIN o ON o.n = g.n + 1)"""
_RIGS = "e AS (SELECT vec_id AS rig_id, 0.1::double AS tx, (vec_id % 5) / 100.0::double AS tz, (vec_id % 7) / 1000.0::double AS rotation_error FROM embeddings)"
_CELL = "floor(({0} + 8) / 0.05::double)"
_FAR = " + ".join(f"pow({a} - (-8 + (floor(({a} + 8) / 0.05::double) + 0.5::double) * 0.05::double), 2)" for a in "xyz")

SQL = {
    "cloud_bounds": f"WITH {_COLOURED} SELECT count(*) AS n_points, "
    + ", ".join(f"round(min({a}), 6) AS min_{a}, round(max({a}), 6) AS max_{a}, round(max({a}) - min({a}), 6) AS extent_{a}" for a in "xyz")
    + ", round(count(*) FILTER (red = 0 AND green = 0 AND blue = 0) / count(*), 6) AS black_fraction FROM co",
    "channel_colours": f"WITH {_COLOURED}, {_VALUES}, w AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY value) AS run, count(*) OVER (PARTITION BY channel) AS total FROM v) SELECT channel, {_FIGURES} FROM w GROUP BY channel",
    "pooled_colours": f"WITH {_COLOURED}, {_VALUES}, w AS (SELECT *, row_number() OVER (ORDER BY value) AS run, count(*) OVER () AS total FROM v), f AS (SELECT {_FIGURES} FROM w) SELECT *, CASE WHEN p99 <= 255 THEN 'uint8' ELSE 'uint16' END AS mode FROM f",
    "written_cloud": f"""WITH {_COLOURED}, s AS (SELECT *, {_FAR} AS far, {", ".join(_CELL.format(a) + f" AS k{a}" for a in "xyz")} FROM co),
b AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY far, idx) AS place FROM s)
SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, red % 256 AS red, green % 256 AS green, blue % 256 AS blue FROM b WHERE place = 1""",
    "rig_frame_rows": f"WITH RECURSIVE {TIMED}, {_PAIRED} SELECT 'rig_' || substr(sha256(l_id::varchar || chr(0) || r_id::varchar), 1, 24) AS rig_id, floor((l_t + r_t) / 2)::bigint AS t, l_id, r_id, r_t - l_t AS delta FROM g WHERE ok",
    "rig_errors": f"WITH {_RIGS} SELECT rig_id, tx, tz, tz AS translation_error, rotation_error FROM e",
    "rig_scatter": f"WITH {_RIGS} SELECT count(*) AS n, round(quantile_cont(tz, 0.5), 6) AS p50, round(quantile_cont(tz, 0.95), 6) AS p95, max(tz) AS max, 0.0::double AS tx_scatter, round(stddev_pop(tz), 6) AS tz_scatter, round(stddev_pop(rotation_error), 6) AS rotation_error_scatter FROM e",
    "refinement": """WITH v AS (SELECT max(l_tax)::double AS t, max(l_quantity)::double / 20 AS r, (sum(l_extendedprice::double) - sum(l_extendedprice::double * (1 - l_discount::double))) / sum(l_extendedprice::double) AS g FROM lineitem)
SELECT 'translation_m' AS name, round(t, 6) AS value, '<=' AS operator, 0.25::double AS threshold, t <= 0.25 AS passed FROM v
UNION ALL SELECT 'rotation_deg', round(r, 6), '<=', 2.0, r <= 2 FROM v UNION ALL SELECT 'loss_gain', round(g, 6), '>=', 0.01, g >= 0.01 FROM v""",
    "image_masks": "WITH i AS (SELECT o_orderkey AS image_id, c_nationkey AS camera FROM orders JOIN customer ON c_custkey = o_custkey) SELECT camera, image_id, 'masks/' || n_name || '.png' AS path, sha256(n_name) AS sha256, count(*) OVER (PARTITION BY camera) AS shared_by FROM i JOIN nation ON n_nationkey = camera",
}
QUERIES = [cloud_bounds, channel_colours, pooled_colours, written_cloud, rig_frame_rows, rig_errors, rig_scatter, refinement, image_masks]


def _lines(spark, d):
    """lineitem as points of 20 images: pixel (line number, quantity), range by price."""
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("image"), F.col("l_linenumber").cast("int").alias("px"), F.floor("l_quantity").cast("int").alias("py"),
        (F.col("l_extendedprice") / 1000).alias("distance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"),
    )


def depth_files(spark, d):
    """The nearest line of every pixel as an array file for each image, written in stages, read back and checked."""
    near = joins.nearest_pixels(_lines(spark, d), "idx", ["image", "px", "py"], "distance")
    pixel = F.struct((F.col("py") * 8 + F.col("px")).alias("pixel_index"), F.col("distance").alias("range_m"), "confidence", F.col("idx").alias("source_index"), F.col("support").alias("support_count"))
    rows = near.groupBy("image").agg(F.array_sort(F.collect_list(pixel)).alias("p"))  # an image's pixels
    rows = rows.select("image", F.array(F.lit(64), F.lit(8)).alias("shape"), *[F.col(f"p.{n}").alias(n) for n in list(arrays.SPARSE)[1:]])
    path = scratch_path(spark, "depth")
    coded = arrays.npz_files(rows, F.concat(F.lit("depth/"), F.col("image"), F.lit(".npz")), arrays.SPARSE, ["image"])
    staged.write_files(coded, path)
    back = arrays.sparse_depth(spark, path)
    integrity.require_none(arrays.sparse_problems(back), "depth files")
    image = F.regexp_extract("path", r"(\d+)\.npz$", 1).cast("bigint")
    return arrays.sparse_pixels(back).select(image.alias("image"), "px", "py", F.round(F.col("distance").cast("double"), 3).alias("distance"), F.round(F.col("confidence").cast("double"), 5).alias("confidence"), "source", "support")


def mask_files(spark, d):
    """A mask of each of ten cameras, shared by the images of their points, as grey images that are written and read back."""
    p = points(spark, d)
    masks = p.select(F.col("label").alias("camera"), F.floor((F.col("x") + 1) * 16).cast("int").alias("px"), F.floor((F.col("y") + 1) * 16).cast("int").alias("py"))
    path = scratch_path(spark, "masks")
    manifest = staged.write_files(arrays.mask_files(masks, p.select(F.col("idx").alias("image"), F.col("label").alias("camera")), 32, 32), path)
    fractions = spark.createDataFrame([(r["image"], r["valid_fraction"]) for r in manifest["files"]], "image bigint, valid_fraction double")
    pixels = arrays.mask_pixels(spark, f"{path}/masks").groupBy(F.regexp_extract("name", r"\d+", 0).cast("bigint").alias("image"))
    counts = pixels.agg(F.count("*").alias("pixels"), F.sum("px").alias("sum_px"), F.sum("py").alias("sum_py"))
    return counts.join(fractions, "image").select("image", "pixels", "sum_px", "sum_py", r6("valid_fraction").alias("valid_fraction"))


def file_digests(spark, d):
    """The names of each nation's customers as a file; its size and SHA-256, streamed from the file."""
    names = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("t"))
    path = scratch_path(spark, "names")
    rows = names.select(F.concat(F.lit("nation/"), F.col("c_nationkey"), F.lit(".txt")).alias("name"), F.col("t").cast("binary").alias("content"))
    manifest = staged.write_files(rows, path)
    digests = staged.file_digests(spark, path)
    integrity.require_none(staged.changed_files(digests, manifest), "changed files")
    return digests.filter(F.col("path").startswith("nation/"))


SQL |= {
    "depth_files": """WITH p AS (SELECT l_suppkey % 20 AS image, l_linenumber::int AS px, floor(l_quantity)::int AS py, l_extendedprice / 1000 AS distance, l_orderkey * 10 + l_linenumber AS idx FROM lineitem)
SELECT image, px, py, round(min(distance)::float::double, 3) AS distance, round(least(1.0::double, ln(1 + count(*)) / ln(4::double))::float::double, 5) AS confidence, arg_min(idx, row(distance, idx)) AS source, count(*)::int AS support FROM p GROUP BY image, px, py""",
    "mask_files": f"""WITH {POINTS}, m AS (SELECT DISTINCT label, floor((x + 1) * 16)::int AS px, floor((y + 1) * 16)::int AS py FROM pts), c AS (SELECT label, count(*) AS pixels, sum(px)::bigint AS sum_px, sum(py)::bigint AS sum_py FROM m GROUP BY label)
SELECT idx AS image, pixels, sum_px, sum_py, round(pixels / 1024, 6) AS valid_fraction FROM pts JOIN c USING (label)""",
    "file_digests": "WITH t AS (SELECT c_nationkey, string_agg(c_name, chr(10) ORDER BY c_name) AS t FROM customer GROUP BY c_nationkey) SELECT 'nation/' || c_nationkey || '.txt' AS path, strlen(t)::bigint AS bytes, sha256(t) AS sha256 FROM t",
}
QUERIES += [depth_files, mask_files, file_digests]
