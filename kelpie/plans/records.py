"""Queries of manifests, pose sets, solver stages, exported models, files read back and windowed similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import images, manifests
from ..operators.scratch import scratch_path
from ..sources import capture, clouds, exports
from .tables import POINTS, points, table

r6 = lambda c: F.round(c, 6)


def unbound_manifests(spark, d):
    """Orders as manifests bound to their customers' by hash; some have another's hash, or a customer that isn't there."""
    made = table(spark, d, "customer").filter("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("name"), F.sha2("c_name", 256).alias("sha256"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    said = F.when(F.col("o_orderkey") % 7 == 0, F.concat("c_name", F.lit("-"))).otherwise(F.col("c_name"))
    return manifests.unbound(made, o.select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("refers"), F.sha2(said, 256).alias("sha256")))


def pose_set_problems(spark, d):
    """Embeddings as posed images of rigs of two, some repeated, stretched, on no side or alone."""
    k = F.col("vec_id")
    raw = F.struct(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyzw")])
    turn = F.transform(geometry.quaternion_to_rotation(raw), lambda v: v * F.when(k % 13 == 0, 1.01).otherwise(1.0))
    m = geometry.transform(turn, F.array(*[F.col("embedding")[i].cast("double") for i in (4, 5, 6)]))
    side = F.when(k % 19 == 0, "top").when(k % 2 == 0, "left").otherwise("right")
    rows = table(spark, d, "embeddings").select(F.when(k % 50 == 1, k - 1).otherwise(k).alias("image_id"), F.floor(k / 2).alias("rig_id"), side.alias("side"), m.alias("m"))
    return manifests.pose_set_violations(rows).groupBy("problem").agg(F.count("*").alias("n"))


def _cameras(spark, d):
    c = F.col
    base = table(spark, d, "part").select("p_partkey", c("p_size").cast("double").alias("fl_x"), (c("p_size") + 1).cast("double").alias("fl_y"), c("p_retailprice").cast("double").alias("cx"))
    return base.withColumns({"cy": c("cx") / 2, "k1": F.lit(0.25), "k2": F.lit(0.125), "k3": F.lit(0.0), "k4": F.lit(0.0)})


def stage_audits(spark, d):
    """Parts as cameras that a solver moved, judged by what each stage may change."""
    before, k = _cameras(spark, d), F.col("p_partkey")
    after = before.withColumns({"fl_x": F.col("fl_x") * (1 + (k % 5) / 64), "k1": F.col("k1") + (k % 3) / 64, "cx": F.col("cx") + F.when(k % 11 == 0, 1.0).otherwise(0.0)})
    out = None
    for stage in (1, 2, 3):
        audit = manifests.stage_audit(before, after, "p_partkey", stage)
        one = audit.agg(F.lit(stage).alias("stage"), F.count("*").alias("n"), F.count_if("passed").alias("passed"), r6(F.max("focal")).alias("focal"), r6(F.max("fixed")).alias("fixed"))
        out = one if out is None else out.unionByName(one)
    return out


def decided_documents(spark, d):
    """A decision for every document, which must cover them exactly: by the label, or for review. Decisions of the labels
    alone leave documents out, which must raise; refused says that it did."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("decision"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    try:
        manifests.decided(docs, labels, "doc_id", ["accept", "reject"])
        refused = False
    except ValueError:
        refused = True
    rows = docs.select("doc_id").join(labels, "doc_id", "left").withColumn("decision", F.coalesce("decision", F.lit("review")))
    out = manifests.decided(docs, rows, "doc_id", ["accept", "reject", "review"]).groupBy("source", "decision").agg(F.count("*").alias("n"))
    return out.withColumn("refused", F.lit(refused))


def _frames(spark, d):
    """Embeddings as posed images of few cameras."""
    k = F.col("vec_id")
    raw = F.struct(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyzw")])
    m = geometry.transform(geometry.quaternion_to_rotation(raw), F.array(*[F.col("embedding")[i].cast("double") for i in (4, 5, 6)]))
    own = {"w": F.lit(64), "h": F.lit(48), "fl_x": (20 + F.col("label") % 4).cast("double"), "fl_y": F.lit(20.0), "cx": F.lit(31.5), "cy": F.lit(23.5)}
    own |= {f"k{i}": F.lit(0.0) for i in (1, 2, 3, 4)}
    return table(spark, d, "embeddings").select(F.concat(F.lit("left/"), F.lpad(k.cast("string"), 9, "0"), F.lit(".jpg")).alias("path"), m.alias("m"), *[v.alias(n) for n, v in own.items()])


def model_cameras(spark, d):
    cameras, posed = exports.model_tables(_frames(spark, d))
    n = posed.groupBy("camera_id").agg(F.count("*").alias("images"), F.min("image_id").alias("first"), F.min("name").alias("name"))
    return cameras.select("camera_id", "fl_x").join(n, "camera_id")


def model_places(spark, d):
    """Where each exported image stands in its camera's frame."""
    return exports.model_tables(_frames(spark, d))[1].select("image_id", "name", r6(F.abs("qw")).alias("qw"), r6(F.sqrt(sum((F.col(t) ** 2 for t in ("tx", "ty", "tz")), F.lit(0.0)))).alias("far"))


def pair_files(spark, d):
    """Pairs of names written as a pair list, and read back."""
    path = scratch_path(spark, "pairs")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o/"), "l_orderkey").alias("a"), F.concat(F.lit("s/"), "l_suppkey").alias("b")).distinct()
    capture.write_pair_list(e, path)
    return capture.pair_list(spark, path).groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("first"))


def strided_cloud(spark, d):
    """Points written as a cloud, and loaded with a bound on their number."""
    path = scratch_path(spark, "cloud") + ".parquet"
    points(spark, d).select("idx", "x", "y", "z").write.parquet(path)
    return clouds.load_xyz(spark, path, 100).select("idx", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


def window_similarity(spark, d):
    """Lines as images of mean discount and tax over line number and quantity."""
    at = [(F.col("l_linenumber") - 1).alias("px"), (F.floor("l_quantity") - 1).cast("int").alias("py")]
    cells = table(spark, d, "lineitem").groupBy("l_returnflag", *at).agg(F.avg(F.col("l_discount").cast("double")).alias("a"), F.avg(F.col("l_tax").cast("double")).alias("b"))
    out = images.gaussian_ssim(cells.withColumn("m", (F.col("px") + F.col("py")) % 5 != 0), "l_returnflag", "a", "b", "m", size=(7, 50))
    return out.select("l_returnflag", r6("ssim").alias("ssim"), "n")


_E = "embedding[{}]::double"
_TURN = "sqrt(pow(embedding[1]::double, 2) + pow(embedding[2]::double, 2) + pow(embedding[3]::double, 2) + pow(embedding[4]::double, 2))"
_FRAMES = f"""f AS (SELECT 'left_' || lpad(vec_id::varchar, 9, '0') || '.jpg' AS name, (20 + label % 4)::double AS fl_x, row_number() OVER (ORDER BY lpad(vec_id::varchar, 9, '0')) AS image_id,
abs(embedding[4]::double) / {_TURN} AS qw, sqrt(pow(embedding[5]::double, 2) + pow(embedding[6]::double, 2) + pow(embedding[7]::double, 2)) AS far FROM embeddings)"""
_AUDIT = """b AS (SELECT p_partkey AS k, p_size::double AS fx, p_retailprice::double AS cx FROM part), a AS (SELECT k, fx, cx, fx * (1 + (k % 5) / 64.0::double) AS fx2, cx + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS cx2, (k % 3) / 64.0::double AS dk FROM b),
c AS (SELECT abs(fx2 - fx) / fx AS focal, abs(fx2 - fx) AS df, abs(cx2 - cx) AS dc, dk FROM a),
s AS (SELECT stage, focal, dk, CASE stage WHEN 1 THEN greatest(df, dc, dk) WHEN 2 THEN greatest(dc, dk) ELSE dc END AS fixed FROM c, (VALUES (1), (2), (3)) t(stage))"""

SQL = {
    "unbound_manifests": """WITH m AS (SELECT c_custkey AS k, sha256(c_name) AS found FROM customer WHERE c_custkey % 17 <> 0),
o AS (SELECT o_orderkey AS name, o_custkey AS refers, sha256(CASE WHEN o_orderkey % 7 = 0 THEN c_name || '-' ELSE c_name END) AS sha256 FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT name, refers, sha256, found FROM o LEFT JOIN m ON k = refers WHERE sha256 IS DISTINCT FROM found""",
    "pose_set_problems": """WITH e AS (SELECT vec_id AS k, CASE WHEN vec_id % 50 = 1 THEN vec_id - 1 ELSE vec_id END AS id, vec_id // 2 AS rig, CASE WHEN vec_id % 19 = 0 THEN 'top' WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM embeddings),
p AS (SELECT 'repeated_image' AS problem FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'not_rigid' FROM e WHERE k % 13 = 0 UNION ALL SELECT 'invalid_side' FROM e WHERE side = 'top'
UNION ALL SELECT 'incomplete_rig' FROM e GROUP BY rig HAVING count(*) FILTER (side = 'left') = 0 OR count(*) FILTER (side = 'right') = 0) SELECT problem, count(*) AS n FROM p GROUP BY problem""",
    "stage_audits": f"WITH {_AUDIT} SELECT stage, count(*) AS n, count(*) FILTER (fixed <= 1e-10::double AND focal <= 0.05 AND dk <= 0.02) AS passed, round(max(focal), 6) AS focal, round(max(fixed), 6) AS fixed FROM s GROUP BY stage",
    "decided_documents": "SELECT source, CASE WHEN l.doc_id IS NULL THEN 'review' WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS decision, count(*) AS n, (SELECT count(*) > 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS refused FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "model_cameras": f"WITH {_FRAMES}, c AS (SELECT fl_x, count(*) AS images, min(image_id) AS first, min(name) AS name FROM f GROUP BY fl_x) SELECT row_number() OVER (ORDER BY first) AS camera_id, fl_x, images, first, name FROM c",
    "model_places": f"WITH {_FRAMES} SELECT image_id, name, round(qw, 6) AS qw, round(far, 6) AS far FROM f",
    "pair_files": "SELECT 's/' || l_suppkey AS b, count(DISTINCT l_orderkey) AS n, min('o/' || l_orderkey) AS first FROM lineitem GROUP BY l_suppkey",
    "strided_cloud": f"WITH {POINTS} SELECT idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts WHERE idx % (SELECT greatest(1, ceil(count(*) / 100.0)::bigint) FROM pts) = 0",
    "window_similarity": """WITH c AS (SELECT l_returnflag AS g, l_linenumber - 1 AS px, floor(l_quantity)::int - 1 AS py, avg(l_discount::double) AS a, avg(l_tax::double) AS b FROM lineitem GROUP BY ALL), v AS (SELECT * FROM c WHERE (px + py) % 5 <> 0),
o AS (SELECT (i - 6)::int AS s, exp(-0.5::double * pow((i - 6) / 1.5::double, 2)) AS k FROM range(13) t(i)),
t AS (SELECT v.g, v.px, v.py, y.k * x.k AS k, CASE WHEN v.px + x.s < 0 THEN -v.px - x.s - 1 WHEN v.px + x.s > 6 THEN 13 - v.px - x.s ELSE v.px + x.s END AS qx, CASE WHEN v.py + y.s < 0 THEN -v.py - y.s - 1 WHEN v.py + y.s > 49 THEN 99 - v.py - y.s ELSE v.py + y.s END AS qy FROM v, o x, o y),
m AS (SELECT t.g, t.px, t.py, sum(k * a) / sum(k) AS mx, sum(k * b) / sum(k) AS my, sum(k * a * a) / sum(k) AS xx, sum(k * b * b) / sum(k) AS yy, sum(k * a * b) / sum(k) AS xy FROM t JOIN v ON v.g = t.g AND v.px = t.qx AND v.py = t.qy GROUP BY t.g, t.px, t.py)
SELECT g AS l_returnflag, round(avg((2 * mx * my + 0.0001::double) * (2 * (xy - mx * my) + 0.0009::double) / ((mx * mx + my * my + 0.0001::double) * (xx - mx * mx + yy - my * my + 0.0009::double))), 6) AS ssim, count(*) AS n FROM m GROUP BY g""",
}
QUERIES = [unbound_manifests, pose_set_problems, stage_audits, decided_documents, model_cameras, model_places, pair_files, strided_cloud, window_similarity]


def record_problems(spark, d):
    """Lines as records of their suppliers' person-mask manifests; some repeat, lack a path, leave the folder or have no hash."""
    c = F.col
    key, name = c("l_orderkey") % 997, F.concat(F.lit("m/"), (c("l_orderkey") * 8 + c("l_linenumber")).cast("string"))
    made = table(spark, d, "lineitem").select(
        "l_suppkey", key.alias("image_id"), F.when(c("l_partkey") % 23 != 0, name).alias("person_mask_path"),
        F.when(c("l_partkey") % 29 == 0, F.concat(F.lit("a/../"), name)).when(c("l_partkey") % 31 == 0, F.concat(F.lit("/"), name)).otherwise(name).alias("source_image_path"),
        F.sha2(name, 256).alias("person_mask_sha256"), F.when(c("l_partkey") % 37 == 0, F.md5(name)).otherwise(F.sha2(name, 256)).alias("source_image_sha256"),
    )
    out = manifests.record_violations(made, "person", ["l_suppkey"])
    return out.groupBy("l_suppkey", "field", "problem").agg(F.count("*").alias("n"), F.min("value").alias("first"))


SQL["record_problems"] = """WITH l AS (SELECT *, 'm/' || (l_orderkey * 8 + l_linenumber) AS name FROM lineitem),
r AS (SELECT l_suppkey, (l_orderkey % 997)::varchar AS image_id, CASE WHEN l_partkey % 23 <> 0 THEN name ELSE '' END AS mask,
  CASE WHEN l_partkey % 29 = 0 THEN 'a/../' || name WHEN l_partkey % 31 = 0 THEN '/' || name ELSE name END AS source, CASE WHEN l_partkey % 37 = 0 THEN md5(name) ELSE sha256(name) END AS hash FROM l),
p AS (SELECT l_suppkey, 'image_id' AS field, image_id AS value, 'repeated' AS problem FROM r GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT l_suppkey, 'person_mask_path', mask, CASE WHEN mask = '' THEN 'missing' ELSE 'repeated' END FROM r GROUP BY ALL HAVING mask = '' OR count(*) > 1
  UNION ALL SELECT DISTINCT l_suppkey, 'person_mask_path', mask, 'unsafe_path' FROM r WHERE mask = ''
  UNION ALL SELECT DISTINCT l_suppkey, 'source_image_path', source, 'unsafe_path' FROM r WHERE source LIKE '/%' OR source LIKE '%/../%'
  UNION ALL SELECT DISTINCT l_suppkey, 'source_image_sha256', hash, 'invalid_hash' FROM r WHERE length(hash) <> 64)
SELECT l_suppkey, field, problem, count(*) AS n, min(value) AS first FROM p GROUP BY ALL"""
QUERIES += [record_problems]
