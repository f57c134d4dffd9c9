"""Queries that write a capture's small files from tables and read them back, and of crops, pivots, names and manual splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalar
from ..operators import windows
from ..operators.scratch import scratch_path
from ..sources import capture, exports, staged
from .records import _frames
from .tables import POINTS, points, table

r6 = lambda c: F.round(c, 6)


def _file(spark, name, text):
    """The path of a file that holds the one row of text."""
    path = scratch_path(spark, "capture")
    staged.write_files(text.select(F.lit(name).alias("name"), F.col("t").cast("binary").alias("content")), path)
    return f"{path}/{name}"


def pose_text(spark, d):
    """Embeddings as the lines of a pose file, whose image paths have blanks, read strictly."""
    e = lambda i: F.col("embedding")[i].cast("double").cast("string")
    side = F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right")
    path = F.concat(side, F.lit("/view "), (F.col("vec_id") + 1_000_000).cast("string"), F.lit(".jpg"))
    line = F.concat_ws(" ", path, e(4), e(5), e(6), F.lit("0 0 0"), e(0), e(1), e(2), e(3), F.col("vec_id").cast("string"))
    lines = table(spark, d, "embeddings").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))  # a capture's images
    found = capture.poses(spark, _file(spark, "poses.txt", lines.select(F.concat(F.lit(" ".join(capture.POSE_COLUMNS) + "\n"), "t").alias("t"))))
    return found.select("path", "side", "timestamp_ns", scalar.stable_id("img_", F.col("path")).alias("image_id"), *[r6(F.col("m")[i]).alias(f"m{i}") for i in (0, 1, 3, 6, 7)])


def transforms_file(spark, d):
    """Posed images as files like transforms.json and back."""
    path = scratch_path(spark, "transforms")
    exports.write_transforms_parts(_frames(spark, d), path)
    back = capture.transforms(spark, path)
    return back.select(F.col("file_path").alias("path"), *[r6(F.col("m")[i]).alias(f"m{i}") for i in (0, 1, 3, 6, 7)])


def model_text(spark, d):
    """Posed images as a reconstruction's text and back."""
    folder = scratch_path(spark, "model")
    exports.write_model_parts(_frames(spark, d), folder)
    back = capture.model_images(spark, f"{folder}/images.txt")
    turned = F.abs(F.col("qw") * F.col("qw") + F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz") - 1) < 1e-9
    return back.select("image_id", "name", r6("qw").alias("qw"), *[r6(c).alias(c) for c in ("tx", "ty", "tz")], turned.alias("is_unit"))


def calibration_file(spark, d):
    """Two cameras by the balances of customers, as a calibration file and back."""
    c = table(spark, d, "customer").groupBy((F.col("c_custkey") % 2).alias("k")).agg(F.round(F.avg("c_acctbal"), 2).alias("f"), F.count("*").cast("int").alias("n"))
    camera = F.struct(
        F.when(F.col("k") == 0, "Cam_Left").otherwise("cam_right").alias("name"), F.lit("fisheye").alias("type"), F.col("n").alias("width"), (F.col("n") + 1).alias("height"),
        F.struct(F.col("f").alias("fl_x"), (F.col("f") + 1).alias("fl_y"), (F.col("n") / 2).alias("cx"), (F.col("n") / 4).alias("cy")).alias("intrinsic"),
        F.struct(F.lit("OPENCV_FISHEYE").alias("camera_model"), F.struct(*[(F.col("n") / 10 ** (4 + i)).alias(f"k{i}") for i in (1, 2, 3, 4)]).alias("params")).alias("distortion"),
    )
    text = c.agg(F.to_json(F.struct(F.collect_list(camera).alias("cameras"))).alias("t"))
    back = capture.cameras(spark, _file(spark, "calibration.json", text))
    return back.select("side", "name", "width", "height", "intrinsic.fl_x", "intrinsic.cy", F.round("distortion.params.k1", 9).alias("k1"))


def file_inventory(spark, d):
    """A file of each nation's customers and one of its suppliers: how many of each kind, and their bytes."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_join(F.collect_list("c_name"), "\n").alias("t")).select(F.concat(F.lit("c/"), "k", F.lit(".TXT")).alias("name"), "t")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.collect_list("s_name"), ",").alias("t")).select(F.concat(F.lit("s/"), "k", F.lit(".csv")).alias("name"), "t")
    path = scratch_path(spark, "inventory")
    staged.write_files(c.unionByName(s).select("name", F.col("t").cast("binary").alias("content")), path)
    found = capture.inventory(spark, path).filter("kind <> 'json'")
    return found.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def crop_windows(spark, d):
    """Lines as crops of a 64 x 64 image reduced by 2: which are lawful, and the lens of those that are."""
    left, top = F.col("l_suppkey") % 40 - 3, F.col("l_quantity").cast("int")
    side = F.col("l_linenumber") * 4 + F.col("l_orderkey") % 2
    ok = scalar.crop_valid(left, top, side, side + 2, F.lit(64), F.lit(64), 2)
    lens = geometry.cropped_intrinsics(F.col("l_extendedprice"), F.col("l_extendedprice") + 1, F.lit(31.5), F.lit(30.5), 3, 5, 2)
    rows = table(spark, d, "lineitem").select("l_returnflag", ok.alias("valid"), lens.alias("k"))
    return rows.groupBy("l_returnflag", "valid").agg(F.count("*").alias("n"), F.round(F.sum("k.fx"), 2).alias("fx"), F.round(F.sum("k.fy"), 2).alias("fy"), F.max("k.cx").alias("cx"), F.max("k.cy").alias("cy"))


def pivot_turns(spark, d):
    """Turns by an axis-angle about a point and a step, as transforms."""
    e = lambda i: F.col("embedding")[i].cast("double")
    m = geometry.about_pivot(F.array(e(0), e(1), e(2)), F.array(e(3), e(4), e(5)), F.array(e(6), e(7), F.lit(1.0)))
    return table(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", *[r6(F.col("m")[i]).alias(f"m{i}") for i in (0, 1, 3, 6, 7, 11)])


def camera_names(spark, d):
    """Image names with either slash and a camera folder in front."""
    raw = F.concat(F.when(F.col("vec_id") % 3 == 0, "camera\\left\\").when(F.col("vec_id") % 3 == 1, "camera/right/").otherwise("other/camera/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return table(spark, d, "embeddings").select("vec_id", scalar.camera_name(raw).alias("name"))


def manual_splits(spark, d):
    """Lines by the split that a table gives for their supplier."""
    line = table(spark, d, "lineitem")
    mapping = line.select("l_suppkey").distinct().withColumn("split", F.when(F.col("l_suppkey") % 5 == 0, "val").otherwise("train"))
    return windows.manual_split(line, mapping, "l_suppkey").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


def camera_points(spark, d):
    """Points in the frame of a posed camera, and the pixel they round to, row by row."""
    p = points(spark, d)
    pose = geometry.transform(geometry.quaternion_to_rotation(F.struct(*[F.lit(v).alias(k) for k, v in zip("xyzw", (0.0, 0.0, 0.6, 0.8), strict=True)])), F.array(*map(F.lit, (0.1, -0.2, -1.0))))
    at = p.select("idx", geometry.to_camera(F.array("x", "y", "z"), pose).alias("c")).select("idx", *[F.col("c")[i].alias(a) for i, a in enumerate("xyz")])
    u, v = F.col("x") / F.col("z") * 20 + 32, F.col("y") / F.col("z") * 20 + 32
    return at.select("idx", *[r6(a).alias(a) for a in "xyz"], geometry.pixel_index(u, v, 64).alias("pixel"))


_M = """q AS (SELECT vec_id, embedding[1]::double AS a, embedding[2]::double AS b, embedding[3]::double AS c, embedding[4]::double AS d, embedding[5]::double AS t0, embedding[6]::double AS t1, embedding[7]::double AS t2 FROM embeddings),
m AS (SELECT vec_id, t0, t1, t2, a/n AS x, b/n AS y, c/n AS z, d/n AS w FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM q))"""
_ENTRIES = "round(1 - 2*(y*y + z*z), 6) AS m0, round(2*(x*y - z*w), 6) AS m1, round(t0, 6) AS m3, round(2*(y*z - x*w), 6) AS m6, round(t1, 6) AS m7"
_PATH = "'left/' || lpad(vec_id::varchar, 9, '0') || '.jpg'"
SQL = {
    "pose_text": f"WITH {_M}, p AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM m), n AS (SELECT *, side || '/view ' || (vec_id + 1000000) || '.jpg' AS path FROM p) SELECT path, side, vec_id + 1000000 AS timestamp_ns, 'img_' || substr(sha256(path), 1, 24) AS image_id, {_ENTRIES} FROM n",
    "transforms_file": f"WITH {_M} SELECT {_PATH} AS path, {_ENTRIES} FROM m",
    "model_text": f"WITH {_M} SELECT (row_number() OVER (ORDER BY vec_id))::int AS image_id, replace({_PATH}, '/', '_') AS name, round(abs(w), 6) AS qw, round(-((1 - 2*(y*y + z*z))*t0 + 2*(x*y + z*w)*t1 + 2*(x*z - y*w)*t2), 6) AS tx, round(-(2*(x*y - z*w)*t0 + (1 - 2*(x*x + z*z))*t1 + 2*(y*z + x*w)*t2), 6) AS ty, round(-(2*(x*z + y*w)*t0 + 2*(y*z - x*w)*t1 + (1 - 2*(x*x + y*y))*t2), 6) AS tz, true AS is_unit FROM m",
    "calibration_file": "WITH c AS (SELECT c_custkey % 2 AS k, round(avg(c_acctbal), 2) AS f, count(*)::int AS n FROM customer GROUP BY 1) SELECT CASE WHEN k = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN k = 0 THEN 'Cam_Left' ELSE 'cam_right' END AS name, n AS width, (n + 1)::int AS height, f AS fl_x, n / 4 AS cy, round(n / 100000, 9) AS k1 FROM c",
    "file_inventory": "WITH c AS (SELECT sum(strlen(c_name)) + count(*) - 1 AS n FROM customer GROUP BY c_nationkey), s AS (SELECT sum(strlen(s_name)) + count(*) - 1 AS n FROM supplier GROUP BY s_nationkey) SELECT 'txt' AS kind, count(*) AS files, sum(n)::bigint AS bytes FROM c UNION ALL SELECT 'csv', count(*), sum(n)::bigint FROM s",
    "crop_windows": "WITH r AS (SELECT l_returnflag, l_suppkey % 40 - 3 AS l, l_quantity::int AS t, l_linenumber * 4 + l_orderkey % 2 AS s, l_extendedprice AS f FROM lineitem) SELECT l_returnflag, l >= 0 AND t >= 0 AND l + s <= 64 AND t + s + 2 <= 64 AND s % 2 = 0 AS valid, count(*) AS n, round(sum(f / 2), 2) AS fx, round(sum((f + 1) / 2), 2) AS fy, 14.25::double AS cx, 12.75::double AS cy FROM r GROUP BY 1, 2",
    "pivot_turns": """WITH e AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS t0, embedding[5]::double AS t1, embedding[6]::double AS t2, embedding[7]::double AS p, embedding[8]::double AS q FROM embeddings),
a AS (SELECT *, sqrt(x*x + y*y + z*z) AS a FROM e), s AS (SELECT *, sin(a)/a AS s, (1 - cos(a))/(a*a) AS c FROM a),
r AS (SELECT *, 1 - c*(y*y+z*z) AS r0, c*x*y - s*z AS r1, c*x*z + s*y AS r2, c*x*y + s*z AS r3, 1 - c*(x*x+z*z) AS r4, c*y*z - s*x AS r5, c*x*z - s*y AS r6, c*y*z + s*x AS r7, 1 - c*(x*x+y*y) AS r8 FROM s)
SELECT vec_id, round(r0, 6) AS m0, round(r1, 6) AS m1, round(p - (r0*p + r1*q + r2) + t0, 6) AS m3, round(r5, 6) AS m6, round(q - (r3*p + r4*q + r5) + t1, 6) AS m7, round(1 - (r6*p + r7*q + r8) + t2, 6) AS m11 FROM r""",
    "camera_names": "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'left/' WHEN 1 THEN 'right/' ELSE 'other/camera/' END || vec_id || '.png' AS name FROM embeddings",
    "manual_splits": "SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "camera_points": f"""WITH {POINTS}, d AS (SELECT idx, x - 0.1::double AS x, y + 0.2::double AS y, z + 1 AS z FROM pts), c AS (SELECT idx, 0.28::double*x + 0.96::double*y AS x, -0.96::double*x + 0.28::double*y AS y, z FROM d)
SELECT idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, (round_even(y / z * 20 + 32, 0) * 64 + round_even(x / z * 20 + 32, 0))::bigint AS pixel FROM c""",
}
QUERIES = [pose_text, transforms_file, model_text, calibration_file, file_inventory, crop_windows, pivot_turns, camera_names, manual_splits, camera_points]
