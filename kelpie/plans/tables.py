"""The driver tables, and views of them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: idx, x, y, z, label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")], "label")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, the time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


#: The same views for the SQL twins.
POINTS = "pts AS (SELECT vec_id AS idx, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, label FROM embeddings)"
TIMED = "ev AS (SELECT *, epoch_us(ts) AS t FROM events)"
