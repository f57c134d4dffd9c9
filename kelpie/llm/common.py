"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from ..operators.scratch import scratch_path, shared_root, written  # noqa: F401

#: Fixed value: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def forget(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_root(spark)
    for file in df.inputFiles()[:1]:
        table = file[file.index(root.removeprefix("file://")) :].removeprefix(root.removeprefix("file://")).lstrip("/").split("/")[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    have, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def text_slices(batches, most: int, column: str = "text"):
    """Arrow batches cut to about `most` bytes of the texts in column, so that a task works on few very long ones at a
    time. Spark itself bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set)."""
    for b in batches:
        if b.num_rows:
            sizes = pc.binary_length(b.column(column)).fill_null(0).to_pylist()
            for a, z in spans.chunks(sizes, most):
                yield b.slice(a, z - a)


def text_chunks(batches, most: int, column: str = "text"):
    """Small text_slices, of one Arrow batch or several, put together until they have `most` bytes."""
    held, size = [], 0
    for b in text_slices(batches, most // 4, column):
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        held.append(b)
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def raw_texts(batch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def batch(**columns) -> pa.RecordBatch:
    """An Arrow batch of numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def ascii_lower(text):
    """Lower-cases A-Z only. lower() does that for ASCII texts, at a fraction of translate()'s cost."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def local_path(uri: str) -> str:
    """file:///a/b -> /a/b"""
    return uri[5:].replace("//", "", 1) if uri.startswith("file:") and uri.startswith("file://") else uri.removeprefix("file:")


def crc_remainder(doc_id, n: int = 5):
    """crc32 of the decimal doc_id, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
