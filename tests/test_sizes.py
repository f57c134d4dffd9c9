"""Queries on tables larger or longer than the driver's smallest ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kelpie.operators import joins, manifests, windows
from kelpie.plans import audits, captures
from kelpie.sources import capture, exports


def test_size_texts_of_long_documents(spark, tmp_path):
    """A cube beyond 64 bits."""
    spark.createDataFrame([(1, 10), (2, 128_657), (3, 50_000_000)], "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["size"], r["cube"]) for r in audits.size_texts(spark, str(tmp_path)).collect()}
    cube = lambda n: f"{(37 * n) ** 3 / 1024**4:.1f}TB"
    assert got == {1: ("370.0B", "48.3MB"), 2: ("4.5MB", cube(128_657)), 3: ("1.7GB", cube(50_000_000))}


def _embeddings(spark, path, n):
    e = F.array(*[(F.sin((F.col("id") + 1) * (i + 1)) / 2).cast("float") for i in range(8)])
    spark.range(n).select(F.col("id").alias("vec_id"), e.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_exports_of_many_frames(spark, tmp_path):
    """More frames than one file of the driver's may hold."""
    n = 100_001
    d = _embeddings(spark, tmp_path, n)
    images = captures.model_text(spark, d).agg(F.count("*"), F.count_distinct("image_id"), F.max("image_id"), F.count_distinct("name")).first()
    assert tuple(images) == (n, n, n, n)
    assert tuple(captures.transforms_file(spark, d).agg(F.count("*"), F.count_distinct("path")).first()) == (n, n)


def test_transforms_in_parts(spark, tmp_path):
    """The same frames as from one file, in files of two; none of none."""
    m = F.array(*[F.lit(1.0) + F.col("id") if i == 3 else F.lit(float(i % 5 == 0)) for i in range(16)])
    f = spark.range(7).select(F.concat(F.lit("a/"), "id").alias("path"), m.alias("m"), *[F.lit(1.5).alias(c) for c in exports.INTRINSICS])
    exports.write_transforms(f, str(tmp_path / "one.json"))
    exports.write_transforms_parts(f, str(tmp_path / "parts"), part=2)
    read = lambda p: sorted((r["file_path"], list(r["m"])) for r in capture.transforms(spark, str(tmp_path / p)).collect())
    assert read("parts") == read("one.json") and len(list((tmp_path / "parts").glob("transforms-*.json"))) >= 4
    exports.write_transforms_parts(f.limit(0), str(tmp_path / "none"))
    assert read("none") == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_values_around_are_kept_up_row_by_row(spark):
    """A frame up to the end of its part is added up anew for every row: the square of the part."""
    rows = spark.createDataFrame([(t, v) for t, v in ((1, None), (2, 7), (4, None), (5, 9), (6, None))], "t int, v int")
    out = windows.known_around(rows, [], "t", F.col("v"), "lo", "hi")
    assert [(r["lo"], r["hi"]) for r in out.orderBy("t").collect()] == [(None, 7), (7, 7), (7, 9), (9, 9), (9, None)]
    by = windows.known_around(rows, ["v"], "t", F.col("v"), "lo", "hi")
    assert "unboundedfollowing" not in _plan(by)


def test_lawful_values_stay_in_their_tasks(spark):
    """Values that need not be unique are judged before rows are grouped."""
    rows = spark.createDataFrame([(i, f"p{i}", f"../{i}" if i == 3 else f"s{i}", "a" * 64, "b" * (64 - (i == 5))) for i in range(9)], "image_id int, person_mask_path string, source_image_path string, person_mask_sha256 string, source_image_sha256 string")
    found = manifests.record_violations(rows, "person")
    assert {(r["field"], r["value"], r["problem"]) for r in found.collect()} == {("source_image_path", "../3", "unsafe_path"), ("source_image_sha256", "b" * 63, "invalid_hash")}
    plan = _plan(found)
    assert "rlike" in plan[plan.index("aggregate") :]


@pytest.mark.parametrize("chain", [1_000_000, 40])
def test_pairs_of_one_long_chain(spark, chain):
    """Times without a gap over the tolerance, many equal: the greedy choice, and no row travels once for each candidate."""
    rng = random.Random(5)
    left, right = ([(i, rng.randrange(20_000) // k) for i in range(n)] for n, k in ((900, 1), (700, 2)))
    left += [(900 + i, 5000) for i in range(20)]
    right += [(900 + i, 5000 + i % 2) for i in range(30)]
    want, ls, rs = set(), set(), set()
    for _, _, _, i, j in sorted((abs(a - b), a, b, i, j) for i, a in left for j, b in right if abs(a - b) <= 60):
        if i not in ls and j not in rs:
            want, ls, rs = want | {(i, j)}, ls | {i}, rs | {j}
    df = lambda rows: spark.createDataFrame(rows, "id long, t long")
    got = joins.tolerance_pairs(df(left), df(right), 60, chain=chain).collect()
    assert {(r["l_id"], r["r_id"]) for r in got} == want and len(got) == len(want)


def test_choices_near_a_range_end_wait():
    """Whatever lies beyond the ends, the pairs that a range settles are those of all rows."""
    rng = random.Random(11)
    for _ in range(400):
        rows = sorted((rng.randrange(300), rng.randrange(2)) for _ in range(rng.randrange(4, 120)))
        t, side = [r[0] for r in rows], [r[1] for r in rows]
        whole, rest = joins._greedy(t, side, 25, None, None)
        assert not rest
        inside = [i for i, x in enumerate(t) if 100 <= x < 200]
        some, left = joins._greedy([t[i] for i in inside], [side[i] for i in inside], 25, 99, 200)
        settled, waits = {(inside[i], inside[j]) for i, j in some}, {inside[i] for i in left}
        assert settled <= set(whole)
        assert all((i, j) in settled or not {i, j} & (set(inside) - waits) for i, j in whole)


def test_neighbours_are_dealt_by_queries(spark, monkeypatch):
    """A join of neighbours takes tasks by its queries, not by the bytes that it reads."""
    monkeypatch.setattr(joins, "QUERIES", 16)
    seen, within = [], joins.within_radius
    monkeypatch.setattr(joins, "within_radius", lambda *a: (seen.append(a[-1]), within(*a))[1])
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random()) for i in range(100)]
    got = {(r["q_id"], r["rank"]): r["b_id"] for r in joins.nearest(*[spark.createDataFrame(rows, "id int, x double, y double")] * 2, ["x", "y"], 2).collect()}
    assert seen[0] == 7
    for i, x, y in rows:
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v in rows)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in near]
