"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a fixed shuffled order and repeated in up to MAX_EPOCHS rounds. A copy's virtual
finish time is its source's words up to and including it, divided by the source's target. All copies are ordered by
finish time and taken while the words so far stay within the total budget.

Running totals never gather a source, or the corpus, in one task: rows are cut into buckets of about BUCKET_ROWS by the
shuffle hash (within a source) or by finish time (globally), the buckets' sums are totalled, and each bucket adds up
its own rows from there.

Defined results. A null text has size 0; a null source is a source of its own, after all others; sizes of 0 take
nothing and stay once. Rows that repeat a doc_id are separate documents, ordered by size within their tie; rows equal in id, source
and size are interchangeable. All sizes 0, or an empty table: targets 0, nothing taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 500
SEED = "mix-1"


def targets(per_source: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with sid, target, budget. Water filling: sources in order of cap over weight are capped
    as long as their share of what is left is at least their cap; the others share the rest by weight. One row per
    source, so plain windows do."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(whole))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("capped_before")).cast("double") / F.sum("w").over(rest))
        .withColumn("is_capped", F.col("level") * F.col("w") >= F.col("cap"))
        .withColumn("share", F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(whole)["level"])
    )
    target = F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("w"))
    return filled.select("source", "source_size", "sid", target.alias("target"), "budget")


def running_total(rows: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """rows with out: the sum of value up to and including the row, in each group, by (bucket, order)."""
    keys = [*groups, bucket]
    sums = common.written(rows.groupBy(*keys).agg(F.sum(value).alias("__sum")), "mix-buckets")
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, keys).withColumn(out, F.col("__before") + F.sum(value).over(own)).drop("__before")


def schedule(sizes: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (row_no, doc_id, source, size) -> row_no, doc_id, size, source_size, target, copies, taken."""
    n = sizes.count()
    buckets = max(1, min(1 << 24, n // BUCKET_ROWS))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = common.written(targets(per_source, weights, epochs), "mix-targets").withColumnRenamed("source", "t_source")
    # The size parts rows that share an id, or have none.
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    in_hash = F.expr(f"cast(conv(substring(key, 1, 6), 16, 10) as bigint) * {buckets} div 16777216")
    rows = (
        sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .select("row_no", "doc_id", "size", "source_size", "sid", "target", "budget", key.alias("key"))
        .withColumn("b", in_hash)
    )
    rows = common.written(running_total(rows, ["sid"], "b", ["key", "doc_id", "size", "row_no"], "size", "cum"), "mix-order")
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("upto", F.col("epoch") * F.col("source_size") + F.col("cum"))
    # A copy that starts beyond its source's target is never taken; each document keeps one row all the same.
    copies = copies.withColumn("eligible", F.col("upto") - F.col("size") < F.col("target")).filter("eligible or epoch = 0")
    finish = F.coalesce(F.try_divide(F.col("upto").cast("double"), F.col("target")), F.lit(0.0))
    copies = (
        copies.withColumn("finish", finish)
        .withColumn("f", F.least(F.floor(F.col("finish") * buckets), F.lit(2 * buckets)))
    )
    ordered = running_total(copies.filter("eligible and size > 0"), [], "f", ["finish", "sid", "epoch", "key", "doc_id", "size", "row_no"], "size", "total")
    # Others add nothing to the running total, and most of them would share the first or the last bucket. An empty document
    # takes nothing and stays once.
    out = ["row_no", "doc_id", "size", "source_size", "target"]
    taken = ordered.select(*out, F.when(F.col("total") <= F.col("budget"), 1).otherwise(0).alias("is_taken"))
    others = copies.filter("(not eligible and size > 0) or (size = 0 and epoch = 0)").select(*out, F.when(F.col("size") > 0, 0).otherwise(1).alias("is_taken"))
    return (
        taken.unionByName(others)
        .groupBy(*out)
        .agg(F.sum("is_taken").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def _size_of(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("bigint")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size_of(F.col(text_col)).alias("size")
    )
    return schedule(common.written(sizes, "mix-sizes"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, with all their columns, each as often as it is taken."""
    no = common.fresh(docs, "row_no")
    rows = common.written(docs.withColumn(no, F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.select(F.col(no).alias("row_no"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size_of(F.col(text_col)).alias("size"))
    c_no, copies, nth = (common.fresh(rows, x) for x in ("chosen_no", "copies", "nth"))
    chosen = schedule(common.written(sizes, "mix-sizes")).filter("copies > 0").select(F.col("row_no").alias(c_no), F.col("copies").alias(copies))
    out = rows.join(chosen, F.col(no) == F.col(c_no))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op6_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    return plan(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op6_fair_queue_mix": rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM s),
c AS (SELECT *, [5, 2, 1][(sid % 3 + 1)::int] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
        / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, sid, budget, CASE WHEN level * w >= cap THEN cap::double
        ELSE (SELECT arg_min(level, row(cap / w, sid)) FROM l WHERE NOT level * w >= cap) * w END AS target FROM l),
o AS (SELECT d.row_no, d.doc_id, d.size, t.*, md5('{SEED}:' || coalesce(d.doc_id::varchar, '') || ':' || d.size::varchar) AS key FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size, row_no ROWS UNBOUNDED PRECEDING) AS cum FROM o),
e AS (SELECT *, epoch * source_size + cum AS upto FROM k, (SELECT unnest([0, 1, 2]) AS epoch)),
f AS (SELECT *, upto - size < target AS eligible, coalesce(CASE WHEN target <> 0 THEN upto::double / target END, 0) AS finish FROM e),
g AS (SELECT *, sum(CASE WHEN eligible THEN size ELSE 0 END) OVER (ORDER BY finish, sid, epoch, key, doc_id, size, row_no ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT doc_id, size, source_size, target, (sum(CASE WHEN eligible AND total <= budget THEN size ELSE 0 END))::bigint AS taken
FROM g GROUP BY row_no, doc_id, size, source_size, target
"""
}
