"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 turns the hash of each normalised text into K slots of a bit array, counts the rows of each slot (partial sums first;
only slot numbers move, never a text, a hash or an id), and sets the bits of slots that two or more rows hit. Pass 2 looks
each row's slots up: a row with a slot that only it hit cannot have a copy and passes straight through; the others, the
possibly repeated ones, shuffle by SHA-256, which decides. A filter is broadcast, so it is bounded by MAX_BITS; where more
rows come, the hashes are cut into ranges, and each range has a filter of its own. A range's rows are written with the
filter's verdict, and the filter deleted, before the next range's is made, so no two filters stand together.

Defined results. Texts: null counts as empty, so null and empty texts are copies of one another. Of equal texts the
row with the largest doc_id stays; a null doc_id is smaller than any other; among rows with equal text and equal doc_id
exactly one stays. An empty table gives an empty table. Extra columns, whatever their names, are ignored by decisions()
and kept by filtered().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET = 32768  # bits in one bitmap of bitmap_construct_agg


def _hash_of(text: Column) -> Column:
    return F.xxhash64(common.ascii_lower(F.coalesce(text, F.lit(""))))


def _sha_of(text: Column) -> Column:
    return F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _slots(h: Column, bits: int, k: int) -> list[Column]:
    part = bits // k
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(part)) + F.lit(i * part) for i in range(k)]


BITS_PER_ROW, MAX_BITS = 32, 1 << 30  # 128 MB


def filter_bits(n_rows: int, bits_per_row: int = 16, max_bits: int = MAX_BITS) -> int:
    """A power of two, at most max_bits. With fewer bits for each row more rows count as possibly repeated, and the result
    stays the same."""
    bits = BUCKET
    while bits < min(n_rows * bits_per_row, max_bits):
        bits *= 2
    return bits


def repeated_slots(hashes: DataFrame, bits: int, k: int, least: int = 2) -> DataFrame:
    """hashes (h) -> (bucket, bitmap) of the slots that `least` or more rows hit; at most bits / 8 bytes in all."""
    slot = F.explode(F.array(*_slots(F.col("h"), bits, k))).alias("slot")
    twice = hashes.select(slot).groupBy("slot").count().filter(F.col("count") >= least)
    return twice.groupBy(F.expr(f"slot div {BUCKET}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bitmap")
    )


def possibly_repeated(rows: DataFrame, h: str, bitmaps: DataFrame, bits: int, k: int, flag: str) -> DataFrame:
    """rows with the boolean column flag: all K slots of the hash in column h are set."""
    out, tests, drop = rows, [], []
    for i, slot in enumerate(_slots(F.col(h), bits, k)):
        b, m, s = (common.fresh(rows, f"{x}{i}") for x in ("bucket", "bitmap", "slot"))
        out = out.withColumn(s, slot)
        own = bitmaps.select(F.col("bucket").alias(b), F.col("bitmap").alias(m))
        out = out.join(F.broadcast(own), F.expr(f"`{s}` div {BUCKET}") == F.col(b), "left")
        pos = F.col(s) % BUCKET
        byte = F.conv(F.hex(F.substring(F.col(m), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False)))
        drop += [b, m, s]
    both = tests[0]
    for t in tests[1:]:
        both = both & t
    return out.withColumn(flag, both).drop(*drop)


def flagged_among(rows: DataFrame, h: str, hashes: DataFrame, flag: str, name: str) -> DataFrame:
    """rows with the boolean column flag: column h is perhaps one of hashes (h); certainly not where flag is false."""
    hashes = common.written(hashes.distinct(), name)
    bits = filter_bits(hashes.count())
    bitmaps = common.written(repeated_slots(hashes, bits, 2, 1), name)
    return possibly_repeated(rows, h, bitmaps, bits, 2, flag)


def only_among(rows: DataFrame, h: str, hashes: DataFrame, name: str) -> DataFrame:
    flag = common.fresh(rows, "maybe")
    return flagged_among(rows, h, hashes, flag, name).filter(F.col(flag)).drop(flag)


def _judged(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, k: int, max_bits: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and h (the hash that the filters know) of every row."""
    n = docs.count()
    ranges = max(1, -(-n * bits_per_row // max_bits))
    h = _hash_of(F.col(text_col))
    sig = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), h.alias("h"), _sha_of(F.col(text_col)).alias("text_sha256"))
    if ranges > 1:
        sig = sig.withColumn("in_range", F.pmod(F.xxhash64("h", F.lit(11)), F.lit(ranges)))
    sig = common.written(sig, "exact-signatures", ["in_range"] if ranges > 1 else [])
    path = common.scratch_path(docs.sparkSession, "exact-flagged")
    for i in range(ranges):
        own = sig.filter(F.col("in_range") == i).drop("in_range") if ranges > 1 else sig
        bits = filter_bits(n // ranges, bits_per_row, max_bits)
        bitmaps = common.written(repeated_slots(own.select("h"), bits, k), "exact-bitmaps")
        flagged = possibly_repeated(own, "h", bitmaps, bits, k, "maybe")
        if ranges > 1:
            flagged.write.mode("append").parquet(path)
            common.forget(bitmaps)
            flagged = docs.sparkSession.read.schema(flagged.schema).parquet(path)
    if ranges > 1:
        common.forget(sig)
    maybe = flagged.filter("maybe").select("doc_id", "row_no", "text_sha256", "h")
    # Written: a join of two plain exchanges is one that adaptive execution can split where a group is hot.
    groups = common.written(
        maybe.groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best"))
        .filter("group_size > 1"),
        "exact-groups",
    )
    judged = maybe.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("best.row_no") == F.col("row_no"), F.lit(True)).alias("kept"),
        "text_sha256",
        "h",
    )
    alone = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "h"
    )
    return alone.unionByName(judged)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, k: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return _judged(docs, id_col, text_col, bits_per_row, k, max_bits).drop("h")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, k: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Texts without a copy don't shuffle."""
    judged = _judged(docs, id_col, text_col, bits_per_row, k, max_bits)
    repeated = common.written(judged.filter("group_size > 1 and kept").select("h", "doc_id", "text_sha256"), "exact-repeated")
    h, sha, some, w_sha, w_id = (common.fresh(docs, x) for x in ("h", "sha", "some", "w_sha", "w_id"))
    flagged = flagged_among(docs.withColumn(h, _hash_of(F.col(text_col))), h, repeated.select("h"), some, "exact-bitmaps")
    winners = repeated.select(F.col("text_sha256").alias(w_sha), F.col("doc_id").alias(w_id))
    rows = flagged.filter(F.col(some)).withColumn(sha, _sha_of(F.col(text_col)))
    # The join is on text and id together, so a hot group is spread over its ids; of rows that repeat text and id one remains.
    held = rows.join(winners, (F.col(sha) == F.col(w_sha)) & F.col(id_col).eqNullSafe(F.col(w_id)), "left_semi").dropDuplicates([id_col, sha])
    # The filter lets some texts through that are alone.
    others = rows.join(winners.select(w_sha).distinct(), F.col(sha) == F.col(w_sha), "left_anti")
    return flagged.filter(~F.col(some)).select(*docs.columns).unionByName(held.select(*docs.columns)).unionByName(others.select(*docs.columns))


def op5_bloom_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(common.documents(spark, sf_dir))


SQL = {
    "op5_bloom_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
