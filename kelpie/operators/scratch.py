"""Tables that are written once, so that all that reads them sees the same rows in the same partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where none is set and all runs on one
    machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="kelpie-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, parts: list[str] | None = None, **options) -> DataFrame:
    """Writes df as a table (in folders by the columns parts) in the shared folder and reads it back: the lineage ends there,
    and a lost executor costs no recomputation of what came before. options: the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.options(**options)
    (out.partitionBy(*parts) if parts else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
