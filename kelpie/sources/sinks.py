"""Small files that the driver writes: manifests, models. Tables go through Spark's own writers."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

from ..functions.scalar import canonical_json, signed


def atomic_bytes(path: str, data: bytes) -> None:
    """A temporary file in the same folder, flushed to disk, then renamed. path may be a URI of any file system."""
    if "://" in path and not path.startswith("file://"):
        there, at = fs.FileSystem.from_uri(path)
        own = f"{at.rpartition('/')[0]}/.tmp-{uuid.uuid4().hex}"
        with there.open_output_stream(own) as f:
            f.write(data)
        there.move(own, at)
        return
    path = path.removeprefix("file://")
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, own = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, path)
    except BaseException:
        if os.path.exists(own):
            os.unlink(own)
        raise


def write_manifest(manifest: dict, folder: str, name: str = "manifest.json", force: bool = False) -> str:
    """A signed manifest. A folder that isn't empty is refused without force."""
    if os.path.isdir(folder) and os.listdir(folder) and not force:
        raise FileExistsError(f"{folder} isn't empty")
    path = os.path.join(folder, name)
    atomic_bytes(path, canonical_json(signed(manifest)))
    return path


def write_points3d(points: DataFrame, path: str, most: int = 1_000_000) -> int:
    """points3D.bin of a reconstruction without tracks: id, xyz, rgb, error 0."""
    rows = points.orderBy("idx").select("x", "y", "z", "red", "green", "blue").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    body = b"".join(struct.pack("<Q3d3BdQ", i + 1, *r[:3], *r[3:], 0.0, 0) for i, r in enumerate(map(tuple, rows)))
    atomic_bytes(path, struct.pack("<Q", len(rows)) + body)
    return len(rows)
