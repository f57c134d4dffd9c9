import random

import pytest
from pyspark.sql import functions as F

from kelpie.operators import gates, integrity, joins, stats, windows


def greedy(left, right, tolerance):
    pairs = sorted((abs(a - b), a, b, i, j) for i, a in left for j, b in right if abs(a - b) <= tolerance)
    used_l, used_r, out = set(), set(), set()
    for _, _, _, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.add((i, j))
    return out


def test_tolerance_pairs_are_greedy(spark):
    for seed in range(3):
        rng = random.Random(seed)
        left, right = ([(i, rng.randrange(300)) for i in range(40)] for _ in "lr")
        a, b = spark.createDataFrame(left, "id long, t long"), spark.createDataFrame(right, "id long, t long")
        assert {(r["l_id"], r["r_id"]) for r in joins.tolerance_pairs(a, b, 7).collect()} == greedy(left, right, 7)
    none = joins.tolerance_pairs(spark.createDataFrame([(1, 1000)], "id long, t long"), spark.createDataFrame([(1, 60_000_001)], "id long, t long"), 50_000)
    assert none.count() == 0
    with pytest.raises(ValueError):
        joins.tolerance_pairs(none, none, 0)


def test_splits(spark):
    df = spark.range(23).withColumn("x", F.col("id") * 0.3)
    out = windows.block_split(df, ["id"], 0.2, 5, 1).collect()
    assert sorted(r["id"] for r in out if r["split"] == "val") == [5, 6, 7, 8, 9]
    assert [r["pos"] for r in sorted(out, key=lambda r: r["id"])] == list(range(23))
    with pytest.raises(ValueError):
        windows.manual_split(df, spark.createDataFrame([(0, "val")], "id long, split string"), "id")
    full = df.select("id", F.lit("train").alias("split"))
    assert windows.manual_split(df, full, "id").count() == 23
    for n in range(1, 12):
        for k in range(1, n + 1):
            got = spark.range(1).select(windows.even_positions(F.lit(n).cast("bigint"), k)).first()[0]
            want = [0] if k == 1 else [n - 1 if i == k - 1 else int(i * ((n - 1) / (k - 1))) for i in range(k)]
            assert got == want


def test_audit_and_gates(spark):
    obs = spark.createDataFrame([("a", 1.0, False), ("a", 6.0, True), ("b", 7.0, True), ("b", 8.0, True), ("b", 9.0, False)], "image string, error double, on boolean")
    total = stats.residual_audit(obs, "image", "error", "on", 5.0, 4, 0.3).filter("is_total = 1").first()
    assert (total["high"], total["high_flagged"], total["overlap_fraction"], total["decision"]) == (4, 3, 0.75, "RERUN_MASKED_BA_RECOMMENDED")
    with pytest.raises(ValueError):
        stats.residual_audit(obs.withColumn("error", F.lit(-1.0)), "image", "error", "on")
    m = spark.createDataFrame([(n, 1e9 if "black" in n else (0.0 if op == "<=" else 1e9)) for n, op, _ in gates.DEFAULT_GATES], "name string, value double")
    out = gates.evaluated(m, gates.DEFAULT_GATES)
    assert [r["name"] for r in out.filter("not passed").collect()] == ["point_cloud.black_rgb_fraction"]
    assert gates.status(out).first()["status"] == "FAIL" and gates.status(out, override=True).first()["status"] == "WARNING_OVERRIDDEN"
    unknown = gates.evaluated(m.withColumn("value", F.lit(None).cast("double")), gates.DEFAULT_GATES)
    assert gates.accepted(unknown, "after", "before").first()["published"] == "before"
    a = spark.createDataFrame([("c", 100.0)], "k string, focal double")
    moved = gates.parameter_bounds(a, a.withColumn("focal", F.lit(106.0)), ["k"], {"focal": (0.05, True)}).first()
    assert not moved["passed"] and abs(moved["change"] - 0.06) < 1e-12


def test_masks_and_planes(spark):
    obs = spark.createDataFrame([("a", 5.5, 6.5, 1.0), ("a", 2.0, 2.0, 1.0)], "image string, x double, y double, e double")
    mask = spark.createDataFrame([("a", 6, 6)], "image string, px int, py int")
    assert sorted(r["on_mask"] for r in joins.flagged_by_mask(obs, mask, "image", "x", "y", 10, 10).collect()) == [False, True]
    with pytest.raises(ValueError):
        joins.flagged_by_mask(obs.withColumn("x", F.lit(11.0)), mask, "image", "x", "y", 10, 10)
    plane = spark.range(144).select("id", (F.col("id") % 12).cast("double").alias("x"), F.floor(F.col("id") / 12).cast("double").alias("y"), F.lit(0.0).alias("z"))
    for r in joins.local_geometry(plane, 9).collect():
        assert abs(r["nz"] - 1) < 1e-9 and abs(r["e0"]) < 1e-12
    with pytest.raises(ValueError):
        integrity.require_none(plane, "rows")
    paths = spark.createDataFrame([("a/b.png", False), ("/a", True), ("a/../b", True), ("a\\b", True), ("C:/x", True), ("", True), (None, True)], "p string, bad boolean")
    assert paths.filter(integrity.unsafe_path(F.col("p")) != F.col("bad")).count() == 0


def test_numbered_positions_are_whole(spark):
    """More rows than the sampling of range bounds takes, and plans that need different columns."""
    df = spark.range(0, 40_000, 1, 4).select(F.xxhash64("id").alias("t"), F.col("id").alias("x"))
    got = windows.numbered(df, ["t"]).select("pos", "x").toPandas()
    assert sorted(got["pos"]) == list(range(40_000))


def test_row_hashes_stream(spark):
    """The digest of the whole text, with no row that gathers a group."""
    import hashlib

    rows = [(g, str(i), None if i == 7 else "x" * i) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, p string, c string").repartition(5)
    text = "".join(f"{p}\0{c}\n" for g, p, c in sorted(rows[:40], key=lambda r: r[1]) if c is not None)
    want = (hashlib.sha256(text.encode()).hexdigest(), 40)
    out = stats.hash_of_rows(df, "p", "c", ["g"])
    assert {r["g"]: (r["digest"], r["n"]) for r in out.collect()} == dict.fromkeys(["a", "b", None], want)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(stats.hash_of_rows(df.filter("g = 'a'"), "p", "c").first()) == want
    assert tuple(stats.hash_of_rows(df.limit(0), "p", "c").first()) == (hashlib.sha256().hexdigest(), 0)


def test_baseline_gates(spark):
    rows = [("edge", 2.0, 2.0), ("score", 2.0, 2.0)]
    m = spark.createDataFrame(rows, "name string, baseline double, candidate double")
    got = {r["name"]: (r["status"], r["passed"]) for r in gates.against_baseline(m, ["edge", "unknown"], ["score"]).collect()}
    assert got == {"edge": ("FAIL", False), "unknown": ("NOT_RUN", False), "score": ("PASS", True)}
    with pytest.raises(ValueError):
        gates.against_baseline(spark.createDataFrame([("edge", -1.0, 2.0)], m.schema), ["edge"], [])
