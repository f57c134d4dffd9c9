import numpy as np
import pytest

from kelpie.operators import segment


def test_segmenter(spark):
    class Corner:
        def segment(self, image):
            if image[0, 0] < 0:
                return [{"mask": image[:1], "score": 0.5}]
            return [{"mask": np.where(image > 1, 0.7, 0.2), "score": min(1.0, float(image.max()) / 4), "box": [0, 0, 1, 1]}, {"mask": image > 99, "score": 1.0}]

    class Wrong:
        def segment(self, image):
            return [{"mask": image > 0, "score": float("nan")}]

    rows = [("a", 0, 0, 4.0), ("a", 2, 1, 3.0), ("a", 2, 1, 2.0), ("a", 9, 9, 9.0), ("b", 1, 1, 1.0)]
    grids = segment.grids(spark.createDataFrame(rows, "image string, px int, py int, v double"), "image", "v", 3, 2)
    content = {r["image"]: np.frombuffer(bytes(r["content"]), np.float32).reshape(2, 3).tolist() for r in grids.collect()}
    assert content == {"a": [[4, 0, 0], [0, 0, 3]], "b": [[0, 0, 0], [0, 1, 0]]}
    found = segment.instances(grids, Corner).collect()
    assert len(found) == 12 and {r["score"] for r in found} == {1.0, 0.25}
    got = {tuple(r) for r in segment.segmented(grids, Corner, 0.65, 0.5, 3, 2).collect()}
    assert got == {("a", 0, 0), ("a", 2, 1)}
    assert segment.segmented(grids, Corner, 0.65, 0.5, 3, 2, 5).count() == 6
    assert segment.segmented(grids.limit(0), Corner, 0.65, 0.5, 3, 2).count() == 0
    for make, rows in ((Wrong, [("a", 0, 0, 1.0)]), (Corner, [("a", 1, 0, 1.0)])):
        bad = segment.grids(spark.createDataFrame(rows, "image string, px int, py int, v double"), "image", "v", 3, 2)
        if make is Corner:
            from pyspark.sql import functions as F

            bad = bad.withColumn("content", F.lit(np.full((2, 3), -1, np.float32).tobytes()))
        with pytest.raises(Exception, match="score must be|has the shape"):
            segment.instances(bad, make).collect()
