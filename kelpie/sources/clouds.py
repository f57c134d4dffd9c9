"""Point-cloud files: a LAS reader that tasks share by record ranges, PLY in and out, and a loader by extension."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import stats, voxel

#: Record length and the place of red, green, blue for the LAS point formats that are read.
LAS_FORMATS = {0: (20, None), 1: (28, None), 2: (26, 20), 3: (34, 28), 6: (30, None), 7: (36, 30), 8: (38, 30)}
LOCAL_LIMIT = 100_000.0
#: What points without colours count as, and the most LAS points that are loaded without a bound.
NO_COLOUR = 180
UNBOUNDED_LAS = 5_000_000


def _open(path: str):
    from pyarrow import fs

    there, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return there.open_input_file(at)


def las_header(path: str) -> dict:
    with _open(path) as f:
        size, h = f.size(), f.read(375)
    if h[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, fmt, length, count = struct.unpack_from("<I", h, 96)[0], h[104] & 0x3F, struct.unpack_from("<H", h, 105)[0], struct.unpack_from("<I", h, 107)[0]
    if h[25] >= 4 and len(h) >= 255 and not count:
        count = struct.unpack_from("<Q", h, 247)[0]
    if fmt not in LAS_FORMATS or length < LAS_FORMATS[fmt][0]:
        raise ValueError(f"point format {fmt} isn't read")
    if size < offset + count * length:
        raise ValueError(f"the header counts {count} points, the file has room for {max(0, size - offset) // length}")
    d = struct.unpack_from("<12d", h, 131)
    return {"offset": offset, "format": fmt, "length": length, "count": count, "scale": d[:3], "shift": d[3:6], "max": d[6:12:2], "min": d[7:12:2]}


class Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class LasReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.h = path, rows, las_header(path)

    def partitions(self):
        return [Range(i, min(self.rows, self.h["count"] - i)) for i in range(0, self.h["count"], self.rows)] or [Range(0, 0)]

    def read(self, part):
        import pyarrow as pa

        h, step = self.h, 1 << 18
        rgb = LAS_FORMATS[h["format"]][1]
        with _open(self.path) as f:
            for first in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - first)
                f.seek(h["offset"] + first * h["length"])
                raw = np.frombuffer(f.read(n * h["length"]), np.uint8).reshape(n, h["length"])
                xyz = raw[:, :12].copy().view("<i4") * np.array(h["scale"]) + np.array(h["shift"])
                colour = raw[:, rgb : rgb + 6].copy().view("<u2").astype(np.int32) if rgb else None
                cols = [pa.array(np.arange(first, first + n)), *[pa.array(xyz[:, i]) for i in range(3)]]
                cols += [pa.array(colour[:, i]) if rgb else pa.nulls(n, pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(cols, ["idx", "x", "y", "z", "red", "green", "blue"])


class LasSource(DataSource):
    """spark.dataSource.register(LasSource); spark.read.format("las").load(path)"""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return "idx bigint, x double, y double, z double, red int, green int, blue int"

    def reader(self, schema):
        return LasReader(self.options["path"], int(self.options.get("rowsPerPartition", 1 << 20)))


def las(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("rowsPerPartition", rows).load(path)


CHANNELS = ["red", "green", "blue"]


def colour_histogram(points: DataFrame) -> DataFrame:
    """(channel, value, n) of 16-bit colours: 196,608 rows at most, counted in tasks first. Missing colours don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS])).alias("p")
    return points.select(pairs).select("p.*").filter("value is not null").groupBy("channel", "value").agg(F.count("*").alias("n"))


def channel_colours(points: DataFrame) -> DataFrame:
    """channel, n, min, median, p99, max; no row for a channel without a colour."""
    return stats.quantiles_of_histogram(colour_histogram(points), "value", {"min": 0.0, "median": 0.5, "p99": 0.99, "max": 1.0}, ["channel"])


def pooled_colours(points: DataFrame) -> DataFrame:
    """One row over the three channels together: n, min, median, p99, max and mode (none, uint8 where p99 is 255 at most,
    uint16). Without any colour all figures are NO_COLOUR."""
    pooled = colour_histogram(points).groupBy("value").agg(F.sum("n").alias("n"))
    q = stats.quantiles_of_histogram(pooled, "value", {"min": 0.0, "median": 0.5, "p99": 0.99, "max": 1.0})
    mode = F.when(F.col("p99").isNull(), "none").when(F.col("p99") <= 255, "uint8").otherwise("uint16")
    return q.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(NO_COLOUR)).alias(c) for c in ("min", "median", "p99", "max")], mode.alias("mode"))


def colour_mode(points: DataFrame) -> str:
    """none, uint8 (99 % of the pooled values are 255 at most) or uint16."""
    return pooled_colours(points).first()["mode"]


def scan_summary(points: DataFrame) -> DataFrame:
    """One row: n_points, bounds and extent of each axis, and the share of points that are black in all channels (0.0 for
    no points)."""
    black = F.coalesce((F.col("red") == 0) & (F.col("green") == 0) & (F.col("blue") == 0), F.lit(False))
    out = points.agg(
        F.count("*").alias("n_points"), *[f(a).alias(f"{p}_{a}") for a in "xyz" for p, f in (("min", F.min), ("max", F.max))],
        F.coalesce(F.count_if(black) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("black_fraction"),
    )
    return out.withColumns({f"extent_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"})


def las_scan(spark: SparkSession, path: str) -> dict:
    """A LAS file's count and header bounds, and its pooled colours. No points, or points outside the header's bounds by
    more than a step of its scale, are errors."""
    h, p = las_header(path), las(spark, path)
    if not h["count"]:
        raise ValueError("the point cloud is empty")
    seen = voxel.bounds(p).first()
    for i, a in enumerate("xyz"):
        if seen[f"min_{a}"] < h["min"][i] - h["scale"][i] or seen[f"max_{a}"] > h["max"][i] + h["scale"][i]:
            raise ValueError(f"points lie outside the header's bounds on {a}")
    return {"n_points": h["count"], "bounds_min": list(h["min"]), "bounds_max": list(h["max"]), "colours": pooled_colours(p).first().asDict()}


PLY_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def _ply_header(n: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {a}" for a in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header", ""]
    return "\n".join(lines).encode()


def ply(spark: SparkSession, path: str) -> DataFrame:
    """Canonical binary PLY (float xyz, byte colours): idx, x, y, z, red, green, blue. More or fewer bytes than the header
    says are an error. A file is one task's; large clouds belong in Parquet or LAS."""

    def decode(batches):
        for b in batches:
            for raw in b["content"]:
                raw = bytes(raw)
                end = raw.find(b"end_header\n") + len(b"end_header\n")
                n = int(raw[:end].split(b"element vertex ")[1].split(b"\n")[0])
                if raw[:end] != _ply_header(n) or len(raw) != end + n * PLY_POINT.itemsize:
                    raise ValueError("not a canonical PLY file")
                p = np.frombuffer(raw, PLY_POINT, n, end)
                yield pd.DataFrame({"idx": np.arange(n), **{k: p[k] for k in PLY_POINT.names}})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(decode, "idx bigint, x float, y float, z float, red int, green int, blue int")


def write_ply(points: DataFrame, path: str, order: str = "idx", most: int = 1_000_000) -> int:
    """Writes points in order as one PLY file; at most `most`, as a file of this kind is an initial model, whose size the
    voxel budget bounds. Tasks pack the points, so the driver only joins bytes, a partition at a time."""
    import pyarrow as pa

    from .sinks import atomic_bytes

    n = points.count()
    if n > most:
        raise ValueError(f"{n} points are more than {most}")

    def pack(batches):
        for b in batches:
            out = np.zeros(b.num_rows, PLY_POINT)
            for name in PLY_POINT.names:
                if b.column(name).null_count:
                    raise ValueError(f"points lack {name}")
                out[name] = b.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["packed"])

    packed = points.orderBy(order).select(*PLY_POINT.names).mapInArrow(pack, "packed binary")
    atomic_bytes(path, b"".join([_ply_header(n), *(bytes(r[0]) for r in packed.toLocalIterator())]))
    return n


def numpy_xyz(spark: SparkSession, path: str) -> DataFrame:
    """idx, x, y, z from a .npy file of shape (n, 3), or the array xyz of an .npz file. A file is one task's."""

    def decode(batches):
        import io

        for b in batches:
            for raw in b["content"]:
                loaded = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
                xyz = loaded["xyz"] if hasattr(loaded, "files") else loaded
                if xyz.ndim != 2 or xyz.shape[1] != 3:
                    raise ValueError("points must have the shape (n, 3)")
                for i in range(0, len(xyz), 1 << 18):
                    part = xyz[i : i + (1 << 18)].astype(np.float64)
                    yield pd.DataFrame({"idx": np.arange(i, i + len(part)), **{a: part[:, j] for j, a in enumerate("xyz")}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "idx bigint, x double, y double, z double")


def load_xyz(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """idx, x, y, z from .parquet, .las, .ply, .npy or .npz, finite, in the local frame and not empty; with `most`, every
    ceil(n / most)-th row. A LAS file of over UNBOUNDED_LAS points needs `most`."""
    if most is not None and most <= 0:
        raise ValueError("most must be positive")
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "las" and most is None and las_header(path)["count"] > UNBOUNDED_LAS:
        raise ValueError(f"over {UNBOUNDED_LAS} points need a bound")
    readers = {"parquet": lambda s, at: s.read.parquet(at), "las": las, "ply": ply, "npy": numpy_xyz, "npz": numpy_xyz}
    if kind not in readers:
        raise ValueError(f"{kind} files aren't read")
    p = readers[kind](spark, path).select("idx", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    odd = F.exists(F.array("x", "y", "z"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LOCAL_LIMIT))
    seen = p.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    if seen["odd"]:
        raise ValueError("coordinates must be finite and in the local frame")
    if not seen["n"]:
        raise ValueError("the point cloud is empty")
    return p if most is None else p.filter(F.col("idx") % max(1, -(-seen["n"] // most)) == 0)
