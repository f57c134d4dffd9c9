"""The extension point for segmenters: a class of one's own runs inside tasks, its instances become pixel rows.

A segmenter is made once for each worker process and gets one image after another, as a NumPy array (rows, columns); it
returns instances: mappings with mask (values or booleans of the image's shape), score (0 to 1) and, optionally, box (four
numbers). What it returns is checked; thresholds and the union of instances are joins.instance_mask's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import dilated, instance_mask


class Segmenter(Protocol):
    def segment(self, image: np.ndarray) -> Iterable[Mapping[str, Any]]: ...


def grids(pixels: DataFrame, image: str, value: str, width: int, height: int) -> DataFrame:
    """pixels (image, px, py, value) -> image, width, height, content (32-bit floats, row by row; 0 where there is no
    pixel; the largest of several). A group is the pixels of one image."""
    kind = dict(pixels.dtypes)[image]

    def lay(t: pa.Table) -> pa.Table:
        grid = np.zeros((height, width), np.float32)
        px, py, v = (t.column(c).to_numpy() for c in ("px", "py", "v"))
        np.maximum.at(grid, (py, px), v.astype(np.float32))
        return pa.table({image: t.column(image).slice(0, 1), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "content": [grid.tobytes()]})

    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    best = pixels.filter(inside).groupBy(image, "px", "py").agg(F.max(F.col(value).cast("double")).alias("v"))
    return best.groupBy(image).applyInArrow(lay, f"`{image}` {kind}, width int, height int, content binary")


_made: dict[Callable[[], Segmenter], Segmenter] = {}


def _of_this_worker(make: Callable[[], Segmenter]) -> Segmenter:
    if make not in _made:
        _made[make] = make()
    return _made[make]


def _checked(found: Mapping[str, Any], shape: tuple[int, int]) -> tuple[float, np.ndarray]:
    score, mask = float(found.get("score", float("nan"))), np.asarray(found.get("mask"))
    if not 0 <= score <= 1:
        raise ValueError("a score must be from 0 to 1")
    if mask.shape != shape:
        raise ValueError(f"a mask has the shape {mask.shape}, its image {shape}")
    box = found.get("box")
    if box is not None and (len(box) != 4 or not np.isfinite(np.asarray(box, float)).all()):
        raise ValueError("a box must be four finite numbers")
    return score, mask.astype(np.float64)


def instances(images: DataFrame, make: Callable[[], Segmenter], image: str = "image") -> DataFrame:
    """images (image, width, height, content) -> image, instance, px, py, score, value of the pixels whose value isn't 0, in
    batches of one image's instances."""
    picked = images.select(image, "width", "height", "content")

    def work(batches):
        model = _of_this_worker(make)
        for b in batches:
            for i in range(b.num_rows):
                shape = b.column("height")[i].as_py(), b.column("width")[i].as_py()
                grid = np.frombuffer(b.column("content")[i].as_buffer(), np.float32).reshape(shape)
                for k, found in enumerate(model.segment(grid)):
                    score, mask = _checked(found, shape)
                    y, x = np.nonzero(mask)
                    own = b.column(image).take(pa.array([i] * len(x), pa.int32()))
                    columns = [own, pa.array([k] * len(x), pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array([score] * len(x), pa.float64()), pa.array(mask[y, x])]
                    yield pa.RecordBatch.from_arrays(columns, [image, "instance", "px", "py", "score", "value"])

    return picked.mapInArrow(work, f"`{image}` {dict(images.dtypes)[image]}, instance int, px int, py int, score double, value double")


def segmented(images: DataFrame, make: Callable[[], Segmenter], least_score: float, least_value: float, width: int, height: int, grow: int = 0, image: str = "image") -> DataFrame:
    """The pixels (image, px, py) of the instances that reach the thresholds, grown by `grow`."""
    mask = instance_mask(instances(images, make, image), image, "score", "value", least_score, least_value)
    return dilated(mask, image, grow, width, height) if grow else mask
