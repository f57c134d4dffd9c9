"""Queries of statistics, audits, gates and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import gates, integrity, stats
from .tables import table, timed

r6 = lambda c: F.round(c, 6)


def length_distribution(spark, d):
    out = stats.distribution(table(spark, d, "documents"), "n_chars", ["lang"])
    return out.select("lang", "n", "min", r6("p50").alias("p50"), r6("p95").alias("p95"), "max")


def price_summary(spark, d):
    rows = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")))
    out = stats.finite_summary(rows, "v", ["l_returnflag"])
    return out.select("l_returnflag", "n", "finite_count", "infinite_count", r6("p50").alias("p50"), r6("p95").alias("p95"), "min", "max")


def quantity_histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


def histogram_quantile(spark, d):
    hist = stats.histogram(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return stats.histogram_quantile(hist, "l_quantity", 0.99, ["l_returnflag"])


def robust_limits(spark, d):
    out = stats.robust_limit(timed(spark, d), "value", 0.5, 6.0, ["event_type"])
    return out.select("event_type", r6("median").alias("median"), r6("mad").alias("mad"), r6("upper").alias("upper"))


def axis_spread(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(r6(F.stddev_pop("l_discount")).alias("discount"), r6(F.stddev_pop("l_tax")).alias("tax"))


def black_fraction(spark, d):
    black = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    return table(spark, d, "lineitem").agg(r6(F.avg(black.cast("int"))).alias("fraction"), F.count_if(black).alias("n"))


def masked_images(spark, d):
    """discount against tax as two images of each ship mode, masked by quantity."""
    out = stats.masked_error(table(spark, d, "lineitem"), "l_discount", "l_tax", F.col("l_quantity") > 10, ["l_returnflag"])
    return out.select("l_returnflag", "n", r6("mse").alias("mse"), r6("l1").alias("l1"), r6("psnr").alias("psnr"), "psnr_infinite")


def image_similarity(spark, d):
    out = stats.global_ssim(table(spark, d, "lineitem"), "l_discount", "l_tax", F.col("l_quantity") > 10, ["l_returnflag"])
    return out.select("l_returnflag", r6("ssim").alias("ssim"))


def depth_errors(spark, d):
    out = stats.depth_metrics(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_quantity", F.col("l_linenumber") < 5, ["l_returnflag"])
    return out.select("l_returnflag", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("abs_p95").alias("abs_p95"))


def training_loss(spark, d):
    errors = stats.masked_error(table(spark, d, "lineitem"), "l_discount", "l_tax", F.lit(True), ["l_returnflag"])
    ssim = stats.global_ssim(table(spark, d, "lineitem"), "l_discount", "l_tax", F.lit(True), ["l_returnflag"])
    depth = stats.depth_metrics(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_quantity", F.lit(True), ["l_returnflag"])
    joined = errors.join(ssim, "l_returnflag").join(depth.select("l_returnflag", "mae"), "l_returnflag")
    return stats.supervision_loss(joined, "l1", "ssim", "mae").select("l_returnflag", r6("loss").alias("loss"))


def residual_audit(spark, d):
    """Labelled documents as observations: length as the error, toxic as the flag."""
    obs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = stats.residual_audit(obs, "source", "n_chars", "toxic", 5000.0, 20, 0.3)
    return out.select("source", "observations", "flagged", "high", "high_flagged", r6("p50").alias("p50"), r6("p95").alias("p95"), "max", r6("overlap_fraction").alias("overlap_fraction"), "decision")


def ordered_digest(spark, d):
    """Each text is hashed where it is; a language's digest is over the hashes in path order."""
    docs = table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return stats.hash_of_rows(docs, "path", "hash", ["lang"])


def dense_ids(spark, d):
    return stats.first_seen_ids(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey")


def _brightness(spark, d):
    """Lines as pixels of a 60 x 50 image whose brightness falls off with the distance from its middle."""
    px, py = (F.col("l_suppkey") % 60).cast("double"), F.col("l_quantity").cast("double")
    far = F.hypot(px - 29.5, py - 25.5)
    return table(spark, d, "lineitem").select(px.alias("px"), py.alias("py"), F.greatest(220 - far * far / 4 + F.col("l_linenumber"), F.lit(3.0)).alias("v"))


def radial_profile(spark, d):
    out = stats.radial_profile(_brightness(spark, d), F.col("px"), F.col("py"), "v", 29.5, 25.5)
    return out.select("radius", r6("mean").alias("mean"), "n")


def image_circle(spark, d):
    """The first radius where an image's mean brightness is under 40."""
    return stats.first_dark_radius(stats.radial_profile(_brightness(spark, d), F.col("px"), F.col("py"), "v", 29.5, 25.5), 40.0)


def calibration_difference(spark, d):
    """Customer against supplier balances by nation as two calibrations."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 2).alias("mean"), F.max("c_acctbal").alias("top"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("mean"), F.max("s_acctbal").alias("top"))
    out = stats.signed_differences(a, b, ["k"], ["mean", "top"])
    return out.select("k", "name", F.round("difference", 2).alias("difference"), F.round("max_abs", 2).alias("max_abs"))


def _nation_metrics(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("top"), F.count("*").cast("double").alias("n"))
    return gates.metrics_long(c, ["mean", "top", "n"], ["c_nationkey"])


_GATES = [("mean", ">=", 4000.0), ("top", "<=", 9900.0), ("n", ">=", 50.0)]


def gate_results(spark, d):
    out = gates.evaluated(_nation_metrics(spark, d), _GATES, ["c_nationkey"])
    return out.select("c_nationkey", "name", r6("value").alias("value"), "operator", "threshold", "passed")


def gate_status(spark, d):
    out = gates.status(gates.evaluated(_nation_metrics(spark, d), _GATES, ["c_nationkey"]), ["c_nationkey"])
    return out.select("c_nationkey", "all_passed", F.array_join("failed", ",").alias("failed"), "status")


def acceptance(spark, d):
    out = gates.accepted(gates.evaluated(_nation_metrics(spark, d), _GATES, ["c_nationkey"]), "after", "before", ["c_nationkey"])
    return out.select("c_nationkey", "accepted", "published")


def before_and_after(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    first, last = o.agg(F.min("y"), F.max("y")).first()
    side = lambda y: o.filter(F.col("y") == y).groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("v"))
    out = gates.before_after(side(first), side(last), ["o_orderpriority"], "v")
    return out.select("o_orderpriority", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), r6(gates.improvement(F.col("before"), F.col("after"))).alias("improvement"))


def completeness(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = gates.completeness(docs, ["doc_id"], ["quality", "toxic"])
    return out.select("doc_id", F.size("warnings").alias("warnings"), "status")


def customers_without_orders(spark, d):
    """Customers without an order of over 200,000: every scale has some."""
    o = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return integrity.missing(table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


def pair_leaks(spark, d):
    """Parts and suppliers of lines as match pairs of items; every seventh item is held out, and some have no split."""
    line = table(spark, d, "lineitem")
    pairs = line.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 150).alias("b")).filter("a % 3 = 0")
    split = F.when(F.col("s_suppkey") % 7 == 0, "val").otherwise("train").alias("split")
    assigned = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), split)
    return integrity.pair_leaks(pairs, assigned).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))


def duplicate_keys(spark, d):
    return integrity.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


def key_set_difference(spark, d):
    a = table(spark, d, "documents").select("doc_id")
    return integrity.key_set_difference(a, table(spark, d, "labels").select("doc_id"), ["doc_id"])


def key_overlap(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    return integrity.overlap(a, b, ["k"])


def orphans(spark, d):
    return integrity.missing(table(spark, d, "labels"), table(spark, d, "documents").filter("n_chars > 500"), ["doc_id"]).select("doc_id")


def incomplete_turns(spark, d):
    """Conversations whose first two turns aren't one of each role."""
    t = table(spark, d, "conversations").filter("turn < 2")
    out = integrity.incomplete_groups(t, ["conv_id"], "role", ["user", "assistant"])
    return out.select("conv_id", "n_user", "n_assistant", "n")


def split_violations(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 10 == 0, "val").when(F.col("event_id") % 97 == 0, "odd").otherwise("train").alias("split")).distinct()
    return integrity.split_violations(e, "user_id", "split", e.filter("user_id < 20").select("user_id").distinct())


def merged_reasons(spark, d):
    e = table(spark, d, "events")
    tables = [e.filter(F.col("event_type") == k).select("user_id", F.lit(k).alias("reason")) for k in ("click", "view", "error")]
    return integrity.merged_reasons(tables, ["user_id"]).select("user_id", F.array_join("reasons", "+").alias("reasons"))


def url_paths(spark, d):
    p = table(spark, d, "pages")
    rest = F.regexp_replace("url", "^https?://[^/]+/", "")
    return p.select("page_id", scalar.normalised_path(rest).alias("path"), scalar.stable_id("page_", F.col("page_id"), F.col("url")).alias("stable_id"))


def size_texts(spark, d):
    n = F.col("n_chars").cast("decimal(19,0)") * 37  # a long text's cube is beyond 64 bits
    return table(spark, d, "documents").select("doc_id", scalar.size_text(n).alias("size"), scalar.size_text(n * n * n).alias("cube"))


def colour_bytes(spark, d):
    v = F.when(F.col("l_linenumber") < 7, F.floor(F.col("l_extendedprice")) % 65536)
    return table(spark, d, "lineitem").groupBy(scalar.rgb_to_bytes(v, False).alias("v")).agg(F.count("*").alias("n"))


_NM = "c AS (SELECT c_nationkey, avg(c_acctbal) AS mean, max(c_acctbal) AS top, count(*)::double AS n FROM customer GROUP BY 1), m AS (SELECT c_nationkey, unnest(['mean', 'top', 'n']) AS name, unnest([mean, top, n]) AS value FROM c), g AS (SELECT *, CASE name WHEN 'mean' THEN '>=' WHEN 'top' THEN '<=' ELSE '>=' END AS operator, CASE name WHEN 'mean' THEN 4000::double WHEN 'top' THEN 9900::double ELSE 50::double END AS threshold FROM m), e AS (SELECT *, CASE WHEN operator = '>=' THEN value >= threshold ELSE value <= threshold END AS passed FROM g)"
_SSIM = "(2*mx*my + 0.0001::double) * (2*c + 0.0009::double) / ((mx*mx + my*my + 0.0001::double) * (vx + vy + 0.0009::double))"
_MOM = "avg(l_discount) AS mx, avg(l_tax) AS my, var_pop(l_discount) AS vx, var_pop(l_tax) AS vy, covar_pop(l_discount, l_tax) AS c"
_AUDIT = "count(*) AS observations, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (n_chars >= 5000) AS high, count(*) FILTER (n_chars >= 5000 AND toxic = 1) AS high_flagged, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars)::double AS max"
_SIZE = " ".join(f"CASE WHEN {{n}} < {1024 ** (i + 1)} THEN printf('%.1f{u}', {{n}} / {1024**i}::double) ELSE" for i, u in enumerate(("B", "KB", "MB", "GB"))) + f" printf('%.1fTB', {{n}} / {1024**4}::double) END END END END"
_BRIGHT = """f AS (SELECT l_linenumber, sqrt(pow((l_suppkey % 60) - 29.5::double, 2) + pow(l_quantity::double - 25.5::double, 2)) AS far FROM lineitem), v AS (SELECT far, greatest(220 - far * far / 4 + l_linenumber, 3.0::double) AS v FROM f)"""
SQL = {
    "length_distribution": "SELECT lang, count(n_chars) AS n, min(n_chars)::double AS min, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars)::double AS max FROM documents GROUP BY lang",
    "price_summary": "WITH v AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS f FROM lineitem) SELECT l_returnflag, count(*) AS n, count(f) AS finite_count, count(*) - count(f) AS infinite_count, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.95), 6) AS p95, min(f) AS min, max(f) AS max FROM v GROUP BY 1",
    "quantity_histogram": "SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL",
    "histogram_quantile": "SELECT l_returnflag, quantile_disc(l_quantity, 0.99) AS quantile FROM lineitem GROUP BY 1",
    "robust_limits": "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1), d AS (SELECT event_type, median, quantile_cont(abs(value - median), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY ALL) SELECT event_type, round(median, 6) AS median, round(mad, 6) AS mad, round(greatest(0.5::double, median + 6 * 1.4826::double * mad), 6) AS upper FROM d",
    "axis_spread": "SELECT l_linestatus, round(stddev_pop(l_discount), 6) AS discount, round(stddev_pop(l_tax), 6) AS tax FROM lineitem GROUP BY 1",
    "black_fraction": "SELECT round(avg(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 ELSE 0 END), 6) AS fraction, count(*) FILTER (l_discount = 0 AND l_tax = 0) AS n FROM lineitem",
    "masked_images": "WITH m AS (SELECT l_returnflag, count(*) AS n, avg(pow(l_discount - l_tax, 2)) AS mse, avg(abs(l_discount - l_tax)) AS l1 FROM lineitem WHERE l_quantity > 10 GROUP BY 1) SELECT l_returnflag, n, round(mse, 6) AS mse, round(l1, 6) AS l1, round(-10 * log10(mse), 6) AS psnr, mse = 0 AS psnr_infinite FROM m",
    "image_similarity": f"WITH m AS (SELECT l_returnflag, {_MOM} FROM lineitem WHERE l_quantity > 10 GROUP BY 1) SELECT l_returnflag, round({_SSIM}, 6) AS ssim FROM m",
    "depth_errors": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * abs(l_tax - l_discount)) / sum(l_quantity), 6) AS mae, round(sqrt(sum(l_quantity * pow(l_tax - l_discount, 2)) / sum(l_quantity)), 6) AS rmse, round(quantile_cont(abs(l_tax - l_discount), 0.95), 6) AS abs_p95 FROM lineitem WHERE l_linenumber < 5 AND l_quantity > 0 GROUP BY 1",
    "training_loss": f"WITH m AS (SELECT l_returnflag, {_MOM}, avg(abs(l_discount - l_tax)) AS l1, sum(l_quantity * abs(l_tax - l_discount)) / sum(l_quantity) AS mae FROM lineitem GROUP BY 1) SELECT l_returnflag, round(0.8::double * l1 + 0.2::double * (1 - {_SSIM}) + 0.05::double * mae, 6) AS loss FROM m",
    "residual_audit": f"WITH o AS (SELECT * FROM documents JOIN labels USING (doc_id)), a AS (SELECT source, grouping(source) AS t, {_AUDIT} FROM o GROUP BY GROUPING SETS ((source), ())) SELECT source, observations, flagged, high, high_flagged, p50, p95, max, round(CASE WHEN high = 0 THEN 0 ELSE high_flagged / high END, 6) AS overlap_fraction, CASE WHEN t = 0 THEN NULL WHEN high < 20 THEN 'INSUFFICIENT_HIGH_RESIDUAL_OBSERVATIONS' WHEN high_flagged / high >= 0.3 THEN 'RERUN_MASKED_BA_RECOMMENDED' ELSE 'RETAIN_CURRENT_BA' END AS decision FROM a",
    "ordered_digest": "SELECT lang, sha256(string_agg(doc_id::varchar || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id::varchar)) AS digest, count(*) AS n FROM documents GROUP BY lang",
    "dense_ids": "WITH f AS (SELECT l_suppkey, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_seen, l_suppkey) - 1 AS dense_id FROM f",
    "radial_profile": f"WITH {_BRIGHT} SELECT floor(far)::int AS radius, round(avg(v), 6) AS mean, count(*) AS n FROM v GROUP BY 1",
    "image_circle": f"WITH {_BRIGHT}, m AS (SELECT floor(far)::int AS radius, avg(v) AS mean FROM v GROUP BY 1) SELECT min(radius) AS radius FROM m WHERE mean < 40",
    "calibration_difference": "WITH a AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 2) AS mean, max(c_acctbal) AS top FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 2) AS mean, max(s_acctbal) AS top FROM supplier GROUP BY 1), d AS (SELECT k, a.mean - b.mean AS dm, a.top - b.top AS dt FROM a JOIN b USING (k)) SELECT k, unnest(['mean', 'top']) AS name, round(unnest([dm, dt]), 2) AS difference, round(greatest(abs(dm), abs(dt)), 2) AS max_abs FROM d",
    "gate_results": f"WITH {_NM} SELECT c_nationkey, name, round(value, 6) AS value, operator, threshold, passed FROM e",
    "gate_status": f"WITH {_NM} SELECT c_nationkey, bool_and(passed) AS all_passed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT passed), '') AS failed, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM e GROUP BY 1",
    "acceptance": f"WITH {_NM} SELECT c_nationkey, bool_and(passed) AS accepted, CASE WHEN bool_and(passed) THEN 'after' ELSE 'before' END AS published FROM e GROUP BY 1",
    "before_and_after": "WITH y AS (SELECT *, year(o_orderdate) AS y FROM orders), s AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) FILTER (y = (SELECT min(y) FROM y)) AS b, quantile_cont(o_totalprice, 0.5) FILTER (y = (SELECT max(y) FROM y)) AS a FROM y GROUP BY 1) SELECT o_orderpriority, round(b, 4) AS before, round(a, 4) AS after, round((b - a) / b, 6) AS improvement FROM s",
    "completeness": "SELECT d.doc_id, ((quality IS NULL)::int + (toxic IS NULL)::int) AS warnings, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM documents d LEFT JOIN labels USING (doc_id)",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "pair_leaks": """WITH p AS (SELECT l_suppkey AS a, l_partkey % 150 AS b FROM lineitem WHERE l_suppkey % 3 = 0), s AS (SELECT s_suppkey AS k, s_suppkey % 7 = 0 AS held FROM supplier),
u AS (SELECT a AS i FROM p UNION SELECT b FROM p), r AS (SELECT 'not_canonical' AS problem, a AS item FROM p WHERE a >= b UNION ALL SELECT 'repeated_pair', a FROM (SELECT a, b FROM p GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unknown_item', i FROM u WHERE i NOT IN (SELECT k FROM s) UNION ALL SELECT 'leaks', i FROM u JOIN s ON i = k WHERE held UNION ALL SELECT 'unpaired', k FROM s WHERE NOT held AND k NOT IN (SELECT i FROM u))
SELECT problem, count(*) AS n, count(DISTINCT item) AS items FROM r GROUP BY problem""",
    "duplicate_keys": "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "key_set_difference": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "key_overlap": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "orphans": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)",
    "incomplete_turns": "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) AS n FROM conversations WHERE turn < 2 GROUP BY conv_id HAVING NOT (count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AND count(*) = 2)",
    "split_violations": "WITH e AS (SELECT DISTINCT user_id, CASE WHEN event_id % 10 = 0 THEN 'val' WHEN event_id % 97 = 0 THEN 'odd' ELSE 'train' END AS split FROM events) SELECT user_id, 'several_splits' AS problem FROM e GROUP BY 1 HAVING count(DISTINCT split) > 1 UNION ALL SELECT user_id, 'unknown_split' FROM e WHERE split = 'odd' UNION ALL SELECT DISTINCT user_id, 'golden_not_val' FROM e WHERE user_id < 20 AND user_id NOT IN (SELECT user_id FROM e WHERE split = 'val')",
    "merged_reasons": "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS reasons FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1",
    "url_paths": r"WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '/{2,}', '/', 'g'), '^(\./)+', '') AS p FROM pages) SELECT page_id, CASE WHEN p = '' OR regexp_matches(p, '(^|/)\.\.(/|$)') OR regexp_matches(p, '^(/|[A-Za-z]:)') THEN NULL ELSE p END AS path, 'page_' || substr(sha256(page_id::varchar || chr(0) || url), 1, 24) AS stable_id FROM p",
    "size_texts": f"WITH s AS (SELECT doc_id, n_chars * 37 AS n FROM documents) SELECT doc_id, {_SIZE.format(n='n')} AS size, {_SIZE.format(n='(n * n * n)')} AS cube FROM s",
    "colour_bytes": "SELECT CASE WHEN l_linenumber < 7 THEN greatest(0, least(255, round_even((floor(l_extendedprice)::bigint % 65536) / 257.0::double, 0)))::int ELSE 180 END AS v, count(*) AS n FROM lineitem GROUP BY 1",
}
QUERIES = [
    length_distribution, price_summary, quantity_histogram, histogram_quantile, robust_limits, axis_spread, black_fraction, masked_images,
    image_similarity, depth_errors, training_loss, residual_audit, ordered_digest, dense_ids, radial_profile, image_circle, calibration_difference,
    gate_results, gate_status, acceptance, before_and_after, completeness, customers_without_orders, pair_leaks, duplicate_keys, key_set_difference, key_overlap,
    orphans, incomplete_turns, split_violations, merged_reasons, url_paths, size_texts, colour_bytes,
]
