"""Set checks and referential integrity: each returns the rows that violate it, so that a count, a report or an error can
follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing(child: DataFrame, parent: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(*key).distinct(), list(key), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on both sides."""
    return a.select(*key).intersect(b.select(*key))


def key_set_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only, with side; empty if both have the same keys. One shuffle: sides are marks to add up."""
    marked = a.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = marked.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l <> r")
    return sides.select(*key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def merged_reasons(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of tables (key, reason) with the sorted set of reasons of each key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def incomplete_groups(df: DataFrame, group: Sequence[str], side: str, sides: Sequence[str]) -> DataFrame:
    """Groups that don't have exactly one row of each side."""
    counts = [F.count_if(F.col(side) == s).alias(f"n_{s}") for s in sides]
    out = df.groupBy(*group).agg(*counts, F.count("*").alias("n"))
    return out.filter(~(F.expr(" and ".join(f"n_{s} = 1" for s in sides)) & (F.col("n") == len(sides))))


def split_violations(assigned: DataFrame, key: str, split: str, golden: DataFrame | None = None) -> DataFrame:
    """(key, problem): keys in several splits, unknown splits, golden keys outside val."""
    many = assigned.groupBy(key).agg(F.count_distinct(split).alias("n")).filter("n > 1").select(key, F.lit("several_splits").alias("problem"))
    odd = assigned.filter(~F.col(split).isin("train", "val") | F.col(split).isNull()).select(key, F.lit("unknown_split").alias("problem"))
    out = many.unionByName(odd)
    if golden is not None:
        out = out.unionByName(golden.select(key).join(assigned.filter(F.col(split) == "val").select(key), key, "left_anti").select(key, F.lit("golden_not_val").alias("problem")))
    return out


def pair_leaks(pairs: DataFrame, assigned: DataFrame, a: str = "a", b: str = "b", key: str = "key", split: str = "split") -> DataFrame:
    """(item, problem) of match pairs that a training run may not use, against the split of every item: pairs that aren't in
    order (not_canonical), that repeat (repeated_pair), whose items have no split (unknown_item), are in several
    (several_splits) or are held out (leaks), and training items without a pair (unpaired). Empty if the pairs use the training items exactly."""
    named = lambda rows, problem: rows.select(F.col("item").cast("string").alias("item"), F.lit(problem).alias("problem"))
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    off = both.filter(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") >= F.col("b"))).select(F.col("a").alias("item"))
    twice = duplicates(both, ["a", "b"]).select(F.col("a").alias("item"))
    used = both.select(F.explode(F.array("a", "b")).alias("item")).filter("item is not null").distinct()
    sides = assigned.groupBy(F.col(key).alias("item")).agg(F.count_distinct(split).alias("n"), F.bool_or(F.col(split) != "train").alias("held"))
    found = used.withColumn("used", F.lit(True)).join(sides, "item", "full")
    problem = (
        F.when(F.col("n").isNull(), "unknown_item").when(F.col("n") > 1, "several_splits").when(F.col("used") & F.col("held"), "leaks").when(F.col("used").isNull() & ~F.col("held"), "unpaired")
    )
    return named(off, "not_canonical").unionByName(named(twice, "repeated_pair")).unionByName(found.select(F.col("item").cast("string").alias("item"), problem.alias("problem")).filter("problem is not null"))


def unsafe_path(path: Column) -> Column:
    """Absolute, drive or backslash paths, and those with a .. part."""
    return path.isNull() | F.contains(path, F.lit("\\")) | F.rlike(path, F.lit(r"^(/|[A-Za-z]:)")) | F.rlike(path, F.lit(r"(^|/)\.\.(/|$)")) | (path == "")


def require_none(violations: DataFrame, message: str, show: int = 4) -> None:
    """Raises if there are violations, with a few of them."""
    if some := violations.limit(show).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in some]}")
