"""Arrays and masks as files: NPZ archives and grey PNG images, coded to the same bytes every time, in tasks."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .staged import files_below, opened

#: The arrays of a sparse depth file and their types.
SPARSE = {"shape": "<i4", "pixel_index": "<i4", "range_m": "<f4", "confidence": "<f4", "source_index": "<i8", "support_count": "<i4"}
#: What an archive's members say of their time, system and rights, and how hard they are compressed.
MEMBER_TIME, MEMBER_SYSTEM, MEMBER_RIGHTS, MEMBER_LEVEL = (1980, 1, 1, 0, 0, 0), 3, 0o600, 6
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20


def _npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def npz_bytes(arrays: Mapping[str, np.ndarray]) -> bytes:
    """A compressed archive with members by name, without times, so equal arrays are equal bytes."""
    if odd := [n for n in arrays if not n or "/" in n or "\\" in n]:
        raise ValueError(f"unsafe array name: {odd[0]!r}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, array in sorted(arrays.items()):
            member = zipfile.ZipInfo(name + ".npy", MEMBER_TIME)
            member.create_system, member.external_attr = MEMBER_SYSTEM, MEMBER_RIGHTS << 16
            z.writestr(member, _npy(array), zipfile.ZIP_DEFLATED, MEMBER_LEVEL)
    return out.getvalue()


def npz_files(rows: DataFrame, name: Column, arrays: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """rows with array columns -> name, content and the columns keep: an archive of the arrays (column: NumPy type) for each
    row. Rows are what one file holds, so each must fit a task."""
    picked = rows.select(name.cast("string").alias("name"), *keep, *arrays)
    types = picked.select("name", *keep).schema.add("content", T.BinaryType())

    def code(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = {k: np.asarray(b.column(k)[i].values.to_numpy(zero_copy_only=False), t) for k, t in arrays.items()}
                own = [b.column(c).slice(i, 1) for c in ("name", *keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([npz_bytes(one)], pa.binary())], ["name", *keep, "content"])

    return picked.mapInArrow(code, types)


@dataclass
class Files(InputPartition):
    paths: list[str]


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.fields = path.rstrip("/"), [(f.name, f.dataType) for f in schema]

    def partitions(self) -> list[Files]:
        out, held = [Files([])], 0
        for p, n in files_below(self.path):
            if p.endswith(".npz"):
                if held + n > TASK_BYTES and out[-1].paths:
                    out.append(Files([]))
                    held = 0
                out[-1].paths.append(p)
                held += n
        return out

    def read(self, partition: Files):
        from pyspark.sql.pandas.types import to_arrow_type

        there, at = opened(self.path)
        for path in partition.paths:
            with there.open_input_file(f"{at}/{path}") as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
                missing = sorted({n for n, _ in self.fields} - {"path"} - set(z.files))
                if missing:
                    raise KeyError(f"{path} is missing arrays: {', '.join(missing)}")
                columns = [pa.array([path]) if n == "path" else pa.array([z[n].ravel()], to_arrow_type(t)) for n, t in self.fields]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in self.fields])


class NpzSource(DataSource):
    """format("npz") with a schema of array columns, all of which each file must have, and path, if asked for."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], schema)


def npz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").schema(schema).load(path)


def sparse_depth(spark: SparkSession, path: str) -> DataFrame:
    """path and the arrays of sparse depth files."""
    kinds = {"<i4": "int", "<i8": "bigint", "<f4": "float"}
    return npz(spark, path, "path string, " + ", ".join(f"{n} array<{kinds[t]}>" for n, t in SPARSE.items()))


def sparse_problems(depth: DataFrame) -> DataFrame:
    """(path, problem) of sparse depth rows that break their contract: a positive height and width, arrays of one length,
    pixels that ascend strictly within the image, finite positive ranges, confidences in (0, 1]."""
    c = F.col
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shape = (F.size("shape") == 2) & F.forall("shape", lambda x: x > 0)
    pixels = F.when(shape, c("shape")[0].cast("bigint") * c("shape")[1].cast("bigint"))
    length = F.size("pixel_index")
    climbs = F.forall(F.sequence(F.lit(1), length - 1), lambda i: F.get(c("pixel_index"), i) > F.get(c("pixel_index"), i - 1))
    checks = {
        "shape": ~shape,
        "length": F.greatest(*[F.abs(F.size(n) - length) for n in ("range_m", "confidence", "source_index", "support_count")]) > 0,
        "pixel": F.exists("pixel_index", lambda p: (p < 0) | (p >= pixels)),
        "order": F.when(length > 1, ~climbs).otherwise(False),
        "range": F.exists("range_m", lambda r: ~(finite(r) & (r > 0))),
        "confidence": F.exists("confidence", lambda r: ~(finite(r) & (r > 0) & (r <= 1))),
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda x: x.isNotNull())
    return depth.select("path", F.explode(found).alias("problem"))


def sparse_pixels(depth: DataFrame) -> DataFrame:
    """path, px, py, distance, confidence, source, support of every pixel of sparse depth rows."""
    zipped = F.arrays_zip("pixel_index", "range_m", "confidence", "source_index", "support_count")
    p, w = F.col("p.pixel_index"), F.col("w")
    return depth.select("path", F.col("shape")[1].alias("w"), F.explode(zipped).alias("p")).select(
        "path", (p % w).alias("px"), F.expr("p.pixel_index div w").cast("int").alias("py"), F.col("p.range_m").alias("distance"), "p.confidence", F.col("p.source_index").alias("source"), F.col("p.support_count").alias("support")
    )


# --- grey PNG ----------------------------------------------------------------------------------------------------------

_HEAD = b"\x89PNG\r\n\x1a\n"


def _png_part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_grey(pixels: np.ndarray) -> bytes:
    """8-bit grey pixels (rows, columns). Each row is stored as it is, less its left neighbours or less the row above, whichever has the
    least sum of signed bytes."""
    rows = np.ascontiguousarray(pixels, np.uint8)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])
    cost = np.abs(ways.view(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    coded = np.concatenate([best.astype(np.uint8)[:, None], ways[best, np.arange(len(rows))]], axis=1)
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)
    return _HEAD + _png_part(b"IHDR", head) + _png_part(b"IDAT", zlib.compress(coded.tobytes(), 9)) + _png_part(b"IEND", b"")


def read_png_grey(raw: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey image without interlace."""
    if raw[:8] != _HEAD:
        raise ValueError("not a PNG file")
    at, data, size = 8, [], None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError("a part's checksum doesn't match")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    coded = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    out, above = np.empty((size[1], size[0]), np.uint8), np.zeros(size[0], np.uint8)
    for y, (way, row) in enumerate(zip(coded[:, 0].tolist(), coded[:, 1:], strict=True)):
        if way == 1:
            row = np.cumsum(row, dtype=np.uint8)
        elif way == 2:
            row = row + above
        elif way:
            row = _mixed(way, row.tolist(), above.tolist())
        out[y] = above = row
    return out


def _mixed(way: int, row: list[int], above: list[int]) -> np.ndarray:
    """A row that is stored less the mean of left and above (3), or less the nearest of left, above and their corner (4)."""
    out, corner, left = [], 0, 0
    for x, up in zip(row, above, strict=True):
        if way == 3:
            near = (left + up) // 2
        else:
            guess = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(guess - v))
        left, corner = (x + near) % 256, up
        out.append(left)
    return np.array(out, np.uint8)


def mask_files(masks: DataFrame, images: DataFrame, width: int, height: int, group: str = "camera", image: str = "image", folder: str = "masks") -> DataFrame:
    """masks (camera, px, py: the pixels that are set), images (image, camera) -> name, content, image, camera and
    valid_fraction: an image of 0 and 255 for each row of images. A camera's mask is coded once and shared by its images;
    cameras without a pixel have an empty mask."""
    kind = dict(images.dtypes)[group]

    def code(t: pa.Table) -> pa.Table:
        grid = np.zeros((height, width), np.uint8)
        px, py = (t.column(c).drop_null().to_numpy() for c in ("px", "py"))
        grid[py, px] = 255
        return pa.table({group: t.column(group).slice(0, 1), "content": [png_grey(grid)], "valid_fraction": [float((grid > 0).mean())]})

    every = images.select(group).distinct().join(masks.select(group, F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).distinct(), group, "left")
    templates = every.groupBy(group).applyInArrow(code, f"`{group}` {kind}, content binary, valid_fraction double")
    name = F.concat(F.lit(f"{folder}/"), F.col(image).cast("string"), F.lit(".png"))
    return images.join(templates, group).select(name.alias("name"), "content", image, group, "valid_fraction")


def mask_pixels(spark: SparkSession, path: str) -> DataFrame:
    """name, px, py of the pixels that are set in the grey images below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                y, x = np.nonzero(read_png_grey(b.column("content")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("name")[i].as_py()] * len(x), pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["name", "px", "py"])

    return named.mapInArrow(decode, "name string, px int, py int")
