"""Queries of masks, depth edges, poses and gates over capture-like views of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import gates, images, joins, poses, reports, segment, stats, windows
from .tables import POINTS, TIMED, points, table, timed

r6 = lambda c: F.round(c, 6)


def _instances(spark, d):
    """lineitem as instance pixels: image, instance, px, py, score, value."""
    c = F.col
    return table(spark, d, "lineitem").select(
        (c("l_suppkey") % 20).alias("image"), c("l_orderkey").alias("instance"), (c("l_linenumber")).alias("px"), F.floor(c("l_quantity")).cast("int").alias("py"),
        (c("l_discount") * 10).cast("double").alias("score"), (c("l_tax") * 10).cast("double").alias("value"),
    )


_INSTANCES = "px AS (SELECT l_suppkey % 20 AS image, l_orderkey AS instance, l_linenumber AS px, floor(l_quantity)::int AS py, (l_discount * 10)::double AS score, (l_tax * 10)::double AS value FROM lineitem)"
_MASK = "mask AS (SELECT DISTINCT image, px, py FROM px WHERE score >= 0.65::double AND value >= 0.5::double)"


def instance_mask(spark, d):
    mask = joins.instance_mask(_instances(spark, d), "image", "score", "value", 0.65, 0.5)
    return mask.groupBy("image").agg(F.count("*").alias("pixels"))


def mask_summary(spark, d):
    rows = _instances(spark, d)
    mask = joins.instance_mask(rows, "image", "score", "value", 0.65, 0.5)
    out = stats.coverage_summary(mask, rows.filter("score >= 0.65"), rows.select("image").distinct(), "image", "instance", 350)
    return out.select("images", "with_mask", "instances", *[r6(x).alias(x) for x in ("min", "p50", "p95", "max")])


def masked_buffer(spark, d):
    """The nearest line of each pixel, where the mask is not set."""
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), F.col("l_linenumber").alias("px"), F.floor("l_quantity").cast("int").alias("py"), "l_orderkey", "l_extendedprice")
    nearest = joins.nearest_pixels(lines, "l_orderkey", ["image", "px", "py"], "l_extendedprice")
    mask = joins.instance_mask(_instances(spark, d), "image", "score", "value", 0.65, 0.5)
    return joins.masked_buffer(nearest, mask, ["image", "px", "py"]).groupBy("image").agg(F.count("*").alias("pixels"), F.sum("support").alias("support"), F.min("l_extendedprice").alias("nearest"))


def observations_on_mask(spark, d):
    obs = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), (F.col("l_linenumber") + 0.5).alias("x"), F.col("l_quantity").cast("double").alias("y"))
    mask = joins.instance_mask(_instances(spark, d), "image", "score", "value", 0.65, 0.5)
    return joins.flagged_by_mask(obs, mask, "image", "x", "y", 64, 64).groupBy("image").agg(F.count("*").alias("n"), F.count_if("on_mask").alias("on_mask"))


def largest_masks(spark, d):
    mask = joins.instance_mask(_instances(spark, d), "image", "score", "value", 0.65, 0.5)
    return windows.largest(mask.groupBy("image").agg(F.count("*").alias("pixels")), "pixels", "image", 5)


def depth_edges(spark, d):
    p = points(spark, d).select("idx", (F.col("x") * 500).alias("u"), (F.col("y") * 500).alias("v"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))
    return joins.depth_edges(p, "u", "v", "r", 12.0, 0.08, 5, "idx").select("idx", "edge")


def rig_centres(spark, d):
    return stats.centres(points(spark, d), ["label"], ["x", "y", "z"]).select("label", "n", *[r6(a).alias(a) for a in "xyz"])


def _poses(spark, d):
    q = F.struct(*[F.col("embedding")[i].cast("double").alias(k) for i, k in enumerate("xyzw")])
    p = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[4].cast("double").alias("tx"), q.alias("raw"))
    n = geometry.quaternion_norm(F.col("raw"))
    return p.select("vec_id", "label", "tx", F.struct(*[(F.col("raw")[k] / n).alias(k) for k in "xyzw"]).alias("q"))


_POSES = """raw AS (SELECT vec_id, label, embedding[5]::double AS tx, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[4]::double AS w FROM embeddings),
pose AS (SELECT vec_id, label, tx, x/n AS x, y/n AS y, z/n AS z, w/n AS w FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM raw))"""


def turn_rates(spark, d):
    """Angular speed between the poses of a label, vec_id as time."""
    out = windows.turn_rates(_poses(spark, d), ["label"], F.col("vec_id").cast("double"), "q", ["vec_id"])
    return out.groupBy("label").agg(F.count("turn_rate").alias("n"), r6(F.max("turn_rate")).alias("max"), r6(F.avg("turn")).alias("mean_turn"))


def bracketed_poses(spark, d):
    """Every tenth pose is an anchor; the others lie between them."""
    p = _poses(spark, d)
    out = joins.bracketed_poses(p.filter("vec_id % 10 = 0").select("vec_id", "tx", "q"), p.filter("vec_id % 10 <> 0").select("vec_id"), "vec_id", ["tx"], "q")
    return out.select("vec_id", r6("tx").alias("tx"), r6(F.col("q.w")).alias("w"), r6(F.col("q.x")).alias("x"))


def accepted_anchors(spark, d):
    """Events left out of their own line, with the reasons that rule them out."""
    rows = joins.leave_one_out(timed(spark, d).dropDuplicates(["user_id", "t"]), ["user_id"], "t", "value")
    out = joins.anchors_accepted(rows, F.lit(60.0), {"negative": F.col("value") < 10})
    return out.groupBy(F.array_join("reasons", "+").alias("reasons"), "accepted").agg(F.count("*").alias("n"))


def supervised_pixels(spark, d):
    c = F.col
    ok = images.supervised(c("l_linenumber") < 6, c("l_tax") > 0.01, c("l_discount") > 0.08, c("l_quantity").cast("double") - 5, c("l_discount").cast("double"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(ok).alias("used"))


def masked_map_mean(spark, d):
    out = images.masked_mean(table(spark, d, "lineitem"), "l_quantity", F.col("l_linenumber") < 4, ["l_returnflag"])
    return out.select("l_returnflag", r6("mean").alias("mean"), "n")


def baseline_gates(spark, d):
    """Events as metrics of users: the mean value of the first and of the second half; users without one are NOT_RUN."""
    e = timed(spark, d)
    half = F.col("event_id") % 2
    m = e.groupBy("user_id", F.col("event_type").alias("name")).agg(r6(F.avg(F.when(half == 0, F.abs("value")))).alias("baseline"), r6(F.avg(F.when(half == 1, F.abs("value")))).alias("candidate"))
    names = sorted(r[0] for r in e.select("event_type").distinct().collect())  # the kinds of events are few
    return gates.against_baseline(m, names[:1], names[1:], ["user_id"]).groupBy("name", "status").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def measured_values(spark, d):
    """The balance of customers in debt was measured, others' wasn't."""
    m = gates.measured(F.when(F.col("c_acctbal") < 0, F.col("c_acctbal").cast("double")))
    return table(spark, d, "customer").select(m.alias("m")).groupBy("m.status").agg(F.count("*").alias("n"), r6(F.sum("m.value")).alias("total"))


def parameter_bounds(spark, d):
    before = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("f"), F.col("p_retailprice").cast("double").alias("c"))
    after = before.withColumn("f", F.col("f") * (1 + (F.col("p_partkey") % 5) / 100)).withColumn("c", F.col("c") + F.col("p_partkey") % 3)
    out = gates.parameter_bounds(before, after, ["p_partkey"], {"f": (0.025, True), "c": (1.5, False)})
    return out.groupBy("name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), r6(F.max("change")).alias("worst"))


def changed_rows(spark, d):
    """Orders whose price or state differ between two versions of the table, or that one of them lacks."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("bytes"), F.col("o_orderstatus").alias("modified"))
    k = F.col("path").cast("bigint")
    return reports.changed_files(o.filter(k % 7 != 0), o.filter(k % 11 != 0).withColumn("modified", F.when(k % 5 == 0, "X").otherwise(F.col("modified"))))


SQL = {
    "instance_mask": f"WITH {_INSTANCES}, {_MASK} SELECT image, count(*) AS pixels FROM mask GROUP BY image",
    "mask_summary": f"""WITH {_INSTANCES}, {_MASK}, f AS (SELECT i.image, (SELECT count(*) FROM mask m WHERE m.image = i.image) / 350.0::double AS f, (SELECT count(DISTINCT instance) FROM px p WHERE p.image = i.image AND score >= 0.65::double) AS k FROM (SELECT DISTINCT image FROM px) i)
SELECT count(*) AS images, count(*) FILTER (f > 0) AS with_mask, sum(k)::bigint AS instances, round(min(f), 6) AS min, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.95), 6) AS p95, round(max(f), 6) AS max FROM f""",
    "masked_buffer": f"""WITH {_INSTANCES}, {_MASK}, z AS (SELECT l_suppkey % 20 AS image, l_linenumber AS px, floor(l_quantity)::int AS py, min(l_extendedprice) AS nearest, count(*) AS support FROM lineitem GROUP BY ALL)
SELECT image, count(*) AS pixels, sum(support)::bigint AS support, min(nearest) AS nearest FROM z SEMI JOIN mask USING (image, px, py) GROUP BY image""",
    "observations_on_mask": f"""WITH {_INSTANCES}, {_MASK}, o AS (SELECT l_suppkey % 20 AS image, round_even(l_linenumber + 0.5, 0)::int AS px, round_even(l_quantity::double, 0)::int AS py FROM lineitem)
SELECT o.image, count(*) AS n, count(m.px) AS on_mask FROM o LEFT JOIN mask m ON o.image = m.image AND o.px = m.px AND o.py = m.py GROUP BY o.image""",
    "largest_masks": f"WITH {_INSTANCES}, {_MASK} SELECT image, count(*) AS pixels FROM mask GROUP BY image ORDER BY pixels DESC, image LIMIT 5",
    "depth_edges": f"""WITH {POINTS}, p AS (SELECT idx, x * 500 AS u, y * 500 AS v, ln(greatest(sqrt(x*x + y*y + z*z), 1e-6)) AS l FROM pts),
n AS (SELECT a.idx, a.l AS al, b.l AS bl, sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)) AS dist, row_number() OVER (PARTITION BY a.idx ORDER BY sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)), b.idx) AS r FROM p a, p b)
SELECT idx, coalesce(bool_or(abs(al - bl) >= 0.08::double) FILTER (dist <= 12), false) AS edge FROM n WHERE r <= 5 GROUP BY idx""",
    "rig_centres": f"WITH {POINTS} SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts GROUP BY label",
    "turn_rates": f"""WITH {_POSES}, l AS (SELECT *, lag(vec_id) OVER w AS v0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0, lag(w) OVER w AS w0 FROM pose WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
t AS (SELECT label, vec_id - v0 AS dt, 2 * atan2(sqrt(pow(w0*x - x0*w - y0*z + z0*y, 2) + pow(w0*y + x0*z - y0*w - z0*x, 2) + pow(w0*z - x0*y + y0*x - z0*w, 2)), abs(x0*x + y0*y + z0*z + w0*w)) AS turn FROM l)
SELECT label, count(turn / dt) AS n, round(max(turn / dt), 6) AS max, round(avg(turn), 6) AS mean_turn FROM t GROUP BY label""",
    "bracketed_poses": f"""WITH {_POSES}, k AS (SELECT *, vec_id - vec_id % 10 AS lo_id, least(vec_id - vec_id % 10 + 10, (SELECT max(vec_id) FROM pose WHERE vec_id % 10 = 0)) AS hi_id FROM pose WHERE vec_id % 10 <> 0),
j AS (SELECT k.vec_id, CASE WHEN hi_id > lo_id THEN (k.vec_id - lo_id)::double / (hi_id - lo_id) ELSE 0 END AS f, a.tx AS tx_a, b.tx AS tx_b, a.w AS aw, b.w AS bw, a.x AS ax, b.x AS bx, a.x*b.x + a.y*b.y + a.z*b.z + a.w*b.w AS dot FROM k JOIN pose a ON a.vec_id = lo_id JOIN pose b ON b.vec_id = hi_id),
s AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS g, acos(least(1.0::double, abs(dot))) AS th FROM j),
h AS (SELECT *, CASE WHEN th < 1e-9 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS wa, CASE WHEN th < 1e-9 THEN f ELSE sin(f * th) / sin(th) END AS wb FROM s)
SELECT vec_id, round(tx_a + f * (tx_b - tx_a), 6) AS tx, round(wa * aw + wb * g * bw, 6) AS w, round(wa * ax + wb * g * bx, 6) AS x FROM h""",
    "supervised_pixels": "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linenumber < 6 AND l_tax > 0.01 AND NOT l_discount > 0.08 AND l_quantity > 5 AND l_discount > 0) AS used FROM lineitem GROUP BY l_returnflag",
    "masked_map_mean": "SELECT l_returnflag, round(avg(CASE WHEN l_linenumber < 4 THEN l_quantity END), 6) AS mean, count(CASE WHEN l_linenumber < 4 THEN 1 END) AS n FROM lineitem GROUP BY l_returnflag",
    "baseline_gates": """WITH m AS (SELECT user_id, event_type AS name, round(avg(CASE WHEN event_id % 2 = 0 THEN abs(value) END), 6) AS b, round(avg(CASE WHEN event_id % 2 = 1 THEN abs(value) END), 6) AS c FROM events GROUP BY ALL),
n AS (SELECT DISTINCT event_type AS name, event_type = (SELECT min(event_type) FROM events) AS strict FROM events), t AS (SELECT u.user_id, n.name, n.strict, m.b, m.c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN n LEFT JOIN m ON m.user_id = u.user_id AND m.name = n.name),
s AS (SELECT name, CASE WHEN b IS NULL OR c IS NULL THEN 'NOT_RUN' WHEN c < b OR (NOT strict AND c <= b) THEN 'PASS' ELSE 'FAIL' END AS status FROM t)
SELECT name, status, count(*) AS n, count(*) FILTER (status = 'PASS') AS passed FROM s GROUP BY name, status""",
    "measured_values": "SELECT CASE WHEN c_acctbal < 0 THEN 'MEASURED' ELSE 'NOT_RUN' END AS status, count(*) AS n, round(sum(CASE WHEN c_acctbal < 0 THEN c_acctbal END), 6)::double AS total FROM customer GROUP BY 1",
    "parameter_bounds": """WITH b AS (SELECT p_partkey AS k, p_size::double AS f, p_retailprice::double AS c FROM part), a AS (SELECT k, f * (1 + (k % 5) / 100.0::double) AS f, c + k % 3 AS c FROM b),
u AS (SELECT 'f' AS name, abs((a.f - b.f) / b.f) AS change, 0.025::double AS bound FROM a JOIN b USING (k) UNION ALL SELECT 'c', abs(a.c - b.c), 1.5::double FROM a JOIN b USING (k))
SELECT name, count(*) AS n, count(*) FILTER (change <= bound) AS passed, round(max(change), 6) AS worst FROM u GROUP BY name""",
    "changed_rows": """SELECT o_orderkey::varchar AS path FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0) AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR (o_orderkey % 5 = 0 AND o_orderstatus <> 'X'))""",
    "accepted_anchors": f"""WITH {TIMED}, e AS (SELECT user_id, t, any_value(value) AS value FROM ev GROUP BY ALL), l AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(value) OVER w AS v0, lead(value) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT value < 10 AS neg, coalesce(abs(value - (v0 + (t - t0)::double / (t1 - t0)::double * (v1 - v0))), 0) > 60 AS far FROM l)
SELECT concat_ws('+', CASE WHEN neg THEN 'negative' END, CASE WHEN far THEN 'temporal_outlier' END) AS reasons, NOT neg AND NOT far AS accepted, count(*) AS n FROM r GROUP BY ALL""",
}
QUERIES = [
    instance_mask, mask_summary, masked_buffer, observations_on_mask, largest_masks, depth_edges, rig_centres, turn_rates, bracketed_poses,
    accepted_anchors, supervised_pixels, masked_map_mean, baseline_gates, measured_values, parameter_bounds, changed_rows,
]


def _corrections(spark, d):
    """Embeddings as pairs of corrections in time: the left one, and a right one a little off."""
    e = lambda i: F.col("embedding")[i].cast("double")
    raw = F.struct(*[e(i).alias(k) for i, k in enumerate("xyzw")])
    # Small turns about the identity: the scalar part is large.
    near = lambda f: F.struct(*[(raw[k] * f).alias(k) for k in "xyz"], F.lit(1.0).alias("w"))
    at = {f"l_{a}": e(4 + i) * 0.01 for i, a in enumerate("xyz")} | {f"r_{a}": e(4 + i) * 0.01 + e(7) * 0.02 for i, a in enumerate("xyz")}
    return table(spark, d, "embeddings").select(F.col("vec_id"), "label", *[c.alias(n) for n, c in at.items()], geometry.unit_quaternion(near(0.01)).alias("l_q"), geometry.unit_quaternion(near(0.012)).alias("r_q"))


def filtered_anchors(spark, d):
    """Mean corrections against those of their neighbours, with the reasons that rule them out."""
    limits = poses.LIMITS | {"multiplier": 2.0, "pair_rotation": 0.06}
    out = poses.filtered_anchors(poses.pair_anchors(_corrections(spark, d)), (), "vec_id", limits=limits)
    return out.select("vec_id", F.round("translation_residual", 8).alias("moved"), r6("rotation_residual").alias("turned"), F.array_join("reasons", "+").alias("reasons"), "accepted")


def mean_poses(spark, d):
    """The mean pose of each label, signs by its first row."""
    p = _poses(spark, d).withColumns({"x": F.col("tx"), "y": F.col("tx") * 2, "z": F.lit(0.0)})
    out = poses.mean_poses(p, ["label"], "vec_id")
    return out.select("label", "n", r6("x").alias("x"), r6("y").alias("y"), *[r6(F.col("q")[k]).alias(f"q{k}") for k in "xyzw"])


SQL |= {
    "mean_poses": f"""WITH {_POSES}, f AS (SELECT label, arg_min({{x: x, y: y, z: z, w: w}}, vec_id) AS f FROM pose GROUP BY label),
s AS (SELECT p.*, CASE WHEN x*f.x + y*f.y + z*f.z + w*f.w < 0 THEN -1 ELSE 1 END AS g FROM pose p JOIN f USING (label)),
m AS (SELECT label, count(*) AS n, avg(tx) AS tx, avg(g*x) AS x, avg(g*y) AS y, avg(g*z) AS z, avg(g*w) AS w FROM s GROUP BY label), u AS (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS l FROM m)
SELECT label, n, round(tx, 6) AS x, round(2 * tx, 6) AS y, round(x/l, 6) AS qx, round(y/l, 6) AS qy, round(z/l, 6) AS qz, round(w/l, 6) AS qw FROM u""",
    "filtered_anchors": f"""WITH r AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::double AS e{i}" for i in range(8))} FROM embeddings),
q AS (SELECT *, sqrt(1 + 0.0001::double * (e0*e0 + e1*e1 + e2*e2)) AS ln, sqrt(1 + 0.000144::double * (e0*e0 + e1*e1 + e2*e2)) AS rn FROM r),
m AS (SELECT vec_id, sqrt(3 * pow(e7 * 0.02::double, 2)) AS pt, {", ".join(f"e{4 + i} * 0.01::double + e7 * 0.01::double AS t{i}" for i in range(3))}, {", ".join(f"0.01::double*e{i}/ln + 0.012::double*e{i}/rn AS s{i}" for i in range(3))}, 1/ln + 1/rn AS s3,
  sqrt(e0*e0 + e1*e1 + e2*e2) AS v, (1 + 0.00012::double * (e0*e0 + e1*e1 + e2*e2)) / (ln*rn) AS dot, ln, rn FROM q),
p AS (SELECT *, sqrt(s0*s0 + s1*s1 + s2*s2 + s3*s3) AS sn, degrees(2 * atan2(0.002::double * v / (ln*rn), dot)) AS pr FROM m),
u AS (SELECT vec_id, pt, pr, t0, t1, t2, s0/sn AS x, s1/sn AS y, s2/sn AS z, s3/sn AS w FROM p),
b AS (SELECT *, {", ".join(f"lag({c}) OVER o AS l{c}, lead({c}) OVER o AS h{c}" for c in ("vec_id", "t0", "t1", "t2", "x", "y", "z", "w"))} FROM u WINDOW o AS (ORDER BY vec_id)),
i AS (SELECT *, (vec_id - lvec_id)::double / (hvec_id - lvec_id) AS f, lx*hx + ly*hy + lz*hz + lw*hw AS d FROM b),
a AS (SELECT *, acos(least(1.0::double, abs(d))) AS ang FROM i),
k AS (SELECT *, CASE WHEN ang < 1e-9 THEN 1 - f ELSE sin((1 - f) * ang) / sin(ang) END AS wa, CASE WHEN ang < 1e-9 THEN f ELSE sin(f * ang) / sin(ang) END * CASE WHEN d < 0 THEN -1 ELSE 1 END AS wb FROM a),
c AS (SELECT *, wa*lx + wb*hx AS px, wa*ly + wb*hy AS py, wa*lz + wb*hz AS pz, wa*lw + wb*hw AS pw FROM k),
e AS (SELECT vec_id, pt, pr, f IS NOT NULL AS inner_, coalesce(sqrt(pow(t0 - (lt0 + f*(ht0-lt0)), 2) + pow(t1 - (lt1 + f*(ht1-lt1)), 2) + pow(t2 - (lt2 + f*(ht2-lt2)), 2)), 0) AS moved,
  coalesce(degrees(2 * atan2(sqrt(pow(pw*x - px*w - py*z + pz*y, 2) + pow(pw*y + px*z - py*w - pz*x, 2) + pow(pw*z - px*y + py*x - pz*w, 2)), abs(px*x + py*y + pz*z + pw*w))), 0) AS turned FROM c),
md AS (SELECT quantile_cont(moved, 0.5) AS mm, quantile_cont(turned, 0.5) AS mt FROM e WHERE inner_),
l AS (SELECT greatest(0.002::double, any_value(mm) + 2 * 1.4826::double * quantile_cont(abs(moved - mm), 0.5)) AS lm, greatest(0.05::double, any_value(mt) + 2 * 1.4826::double * quantile_cont(abs(turned - mt), 0.5)) AS lt FROM e, md WHERE inner_),
w AS (SELECT *, concat_ws('+', CASE WHEN pt > 0.01::double THEN 'pair_translation_disagreement' END, CASE WHEN pr > 0.06::double THEN 'pair_rotation_disagreement' END, CASE WHEN inner_ AND moved > lm THEN 'temporal_translation_outlier' END, CASE WHEN inner_ AND turned > lt THEN 'temporal_rotation_outlier' END) AS reasons FROM e, l)
SELECT vec_id, round(moved, 8) AS moved, round(turned, 6) AS turned, reasons, reasons = '' AS accepted FROM w""",
}
QUERIES += [filtered_anchors, mean_poses]


class Brighter:
    """A segmenter: the pixels of half brightness and more for sure, the others perhaps."""

    def segment(self, image):
        return [{"mask": image >= 0.5, "score": 0.9}, {"mask": (image > 0) & (image < 0.5), "score": 0.3, "box": [0, 0, 8, 51]}]


def segmented_pixels(spark, d):
    """lineitem as grey images, a segmenter in tasks, thresholds and union, grown by 1."""
    grids = segment.grids(_instances(spark, d), "image", "value", 8, 51)
    out = segment.segmented(grids, Brighter, 0.65, 0.5, 8, 51, 1)
    return out.groupBy("image").agg(F.count("*").alias("pixels"), F.sum("px").alias("sum_px"), F.sum("py").alias("sum_py"))


SQL |= {
    "segmented_pixels": f"""WITH {_INSTANCES}, m AS (SELECT image, px, py FROM px WHERE px < 8 AND py < 51 GROUP BY ALL HAVING max(value)::float >= 0.5),
g AS (SELECT DISTINCT image, px + dx AS px, py + dy AS py FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) WHERE px + dx BETWEEN 0 AND 7 AND py + dy BETWEEN 0 AND 50)
SELECT image, count(*) AS pixels, sum(px)::bigint AS sum_px, sum(py)::bigint AS sum_py FROM g GROUP BY image""",
}
QUERIES += [segmented_pixels]


def _shades(spark, d):
    """lineitem as whole grey images of 8 x 51: the greatest price of a pixel, in levels."""
    c = F.col
    lines = table(spark, d, "lineitem").select((c("l_suppkey") % 20).alias("image"), c("l_linenumber").cast("int").alias("px"), F.floor("l_quantity").cast("int").alias("py"), (F.floor("l_extendedprice") % 256).cast("double").alias("shade"))
    return joins.dense_grid(lines.groupBy("image", "px", "py").agg(F.max("shade").alias("shade")), "image", 8, 51, ["shade"])


def _by_column(pixels):
    return pixels.groupBy("image", "px").agg(F.count("*").alias("pixels"), F.sum("shade").cast("bigint").alias("shade"), F.sum(F.col("shade") * F.col("py")).cast("bigint").alias("place"))


def resized_images(spark, d):
    """Images at half as many rows and thrice as many columns, each pixel the nearest."""
    return _by_column(images.resized(_shades(spark, d), (8, 51), (24, 25)))


def resampled_images(spark, d):
    """Images reduced by a Lanczos kernel."""
    return _by_column(images.resampled(_shades(spark, d), ["image"], ["shade"], (8, 51), (5, 20)))


_SHADES = """s AS (SELECT l_suppkey % 20 AS image, l_linenumber AS px, floor(l_quantity)::int AS py, max(floor(l_extendedprice)::bigint % 256)::double AS shade FROM lineitem GROUP BY ALL),
i AS (SELECT image, px, py, coalesce(shade, 0) AS shade FROM (SELECT DISTINCT image FROM s) CROSS JOIN (SELECT unnest(range(8)) AS px) CROSS JOIN (SELECT unnest(range(51)) AS py) LEFT JOIN s USING (image, px, py))"""
_COLUMNS = "SELECT image, px, count(*) AS pixels, sum(shade)::bigint AS shade, sum(shade * py)::bigint AS place FROM {} GROUP BY image, px"


def _kernel(axis, n, to):
    return f"""t{axis} AS (SELECT x, j, (x + 0.5::double - (j + 0.5::double) * {n} / {to}) / greatest(1::double, {n} / {to}::double) AS t FROM (SELECT unnest(range({n})) AS x), (SELECT unnest(range({to})) AS j)),
w{axis} AS (SELECT x AS p{axis}, j, w / sum(w) OVER (PARTITION BY j) AS w FROM (SELECT x, j, CASE WHEN t = 0 THEN 1 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / pow(pi() * t, 2) END AS w FROM t{axis} WHERE abs(t) < 3))"""


_LEVEL = "greatest(0, least(255, floor(round(sum(shade * w), 9) + 0.5::double))) AS shade"
SQL |= {
    "resized_images": f"""WITH {_SHADES}, z AS (SELECT image, x AS px, y AS py, shade FROM (SELECT unnest(range(24)) AS x) CROSS JOIN (SELECT unnest(range(25)) AS y) JOIN i ON i.px = floor((x + 0.5::double) * 8 / 24) AND i.py = floor((y + 0.5::double) * 51 / 25))
{_COLUMNS.format("z")}""",
    "resampled_images": f"""WITH {_SHADES}, {_kernel("x", 8, 5)}, {_kernel("y", 51, 20)},
a AS (SELECT image, j AS px, py, {_LEVEL} FROM i JOIN wx USING (px) GROUP BY ALL), z AS (SELECT image, px, j AS py, {_LEVEL} FROM a JOIN wy USING (py) GROUP BY ALL)
{_COLUMNS.format("z")}""",
}
QUERIES += [resized_images, resampled_images]
