"""Large groups of near copies are compared whole."""

import random

import numpy as np

from kelpie.llm import near_dedup


def test_large_groups_lose_no_link(spark, monkeypatch):
    """A group beyond windows, buckets and the blocks that passes would replace: the classes of all its pairs."""
    rng = random.Random(17)
    base, texts = [f"word{i}" for i in range(120)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99999)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "WINDOW", 20)
    monkeypatch.setattr(near_dedup, "BUCKET", 30)
    monkeypatch.setattr(near_dedup, "PASSES", 0)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    idf = near_dedup.document_frequencies(docs.select("text"))
    link = near_dedup.similarities(*near_dedup.shingles([t.encode() for t in texts], idf)) >= near_dedup.THRESHOLD - near_dedup.ROUNDING
    a, b = np.nonzero(np.triu(link, 1))
    assert len(a) > 100 and all(got[i] == got[j] for i, j in zip(a.tolist(), b.tolist(), strict=True))
