"""Periodic runs, importance resampling and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kelpie.llm import importance, packing, periodic_runs, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, runs int, `no` string, ids string, weight int, pos int, score int, n int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, 4, 5) for i, t in rows], SCHEMA)


def slow_runs(w, shortest=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= shortest:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, e, p) for (a, e), p in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            kinds, most, w = rng.choice([1, 2, 3, 20]), rng.choice([5, 20, 60, 200]), []
            while len(w) < most:
                if w and rng.random() < 0.4:
                    a = rng.randrange(len(w))
                    w += w[a : a + rng.randrange(1, 30)] * rng.randrange(1, 4)
                w += [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 8))]
            texts.append(w)
        texts.append(texts[0])
        shortest = rng.choice([5, 12])
        assert [sorted(r) for r in periodic_runs.runs_of_texts(texts, shortest)] == [slow_runs(w, shortest) for w in texts]


def test_runs_of_known_words():
    f, g = [b"a"], [b"a", b"b"]
    while len(g) < 600:
        f, g = g, g + f
    for w in (g, [b"a"] * 300, [b"a"] * 299 + [b"b"], [b"a", b"b"] * 200, [], [b"x"]):
        assert periodic_runs.runs_of_texts([w])[0] == slow_runs(w)


def test_long_texts_of_runs():
    """Some hundred thousand words that are all repeated."""
    rng = random.Random(1)
    for w, n in (([b"a"] * 200_000, 1), ([b"%d" % (i % 40_000) for i in range(200_000)], 1), ([b"%d" % rng.randrange(2) for _ in range(100_000)], None)):
        found = periodic_runs.runs_of_texts([w])[0]
        assert n is None or len(found) == n
        assert all(w[a:e][p:] == w[a:e][:-p] and e - a >= max(12, 2 * p) for a, e, p in found)


def run_rows():
    rng = random.Random(5)
    rows = [(None, "a b " * 20), (None, None), (1, ""), (2, " \n\t "), (3, "x " * 40), (3, "x " * 40), (4, "é ü " * 15 + "tail")]
    rows += [(i, " ".join(str(rng.randrange(400)) for _ in range(rng.randrange(0, 90)))) for i in range(10, 200)]
    return rows


def run_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = sorted(slow_runs(w), key=lambda r: (r[0], r[2]))
    keep = [True] * n
    for a, e, p in found:
        keep[a + p : e] = [False] * (e - a - p)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *top, sha("".join(f"{a},{e - a},{p}\n" for a, e, p in found)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_run_query(spark, tmp_path):
    make(spark, run_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.op11_lpf_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((run_row(*r) for r in run_rows()), key=str)
    assert any(r[1] for r in got if r[0] and r[0] >= 10)  # some became periodic
    found = periodic_runs.find(make(spark, [(1, "a b c d " * 5 + "e")])).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 20, 4)] and found["text"] == "a b c d e"
    assert periodic_runs.find(make(spark, []).limit(0)).count() == 0


def slow_weights(rows, target, gram, buckets):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + m]) for m in range(1, gram + 1) for i in range(len(w) - m + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for i, x in rows:
        n, own = features(x)
        out.append((i, n, len(own), sum(gain(bucket(f)) for f in own) // len(own) if own else 0))
    return out


def draw_rows():
    rng = random.Random(2)
    words = ["Alpha", "beta", "été", "x9", "日本", "GAMMA"] + [f"w{i}" for i in range(200)]
    rows = [(None, "only Beta, beta"), (None, None), (1, ""), (2, "--- !"), (3, "İ K é"), (7, "alpha beta " * 15), (7, "alpha beta " * 15)]
    return rows + [(i, " ".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(20, 120)]


@pytest.mark.parametrize(("gram", "size"), [(1, 1 << 20), (1, 500), (3, 700)])
def test_weights(spark, monkeypatch, gram, size):
    monkeypatch.setattr(importance, "CHUNK_BYTES", size)
    rows, target = draw_rows(), ["alpha beta gamma w1 w2", None, "w1 w2 w3 " * 4]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.weights(make(spark, rows).repartition(3), aim, gram=gram, buckets=97)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, slow_weights(rows, target, gram, 97)))


def test_rows_of_chunks_are_small(spark):
    """However many words, documents or tuples a chunk has: executors read many rows at a time."""
    rows = [(1, " ".join(f"w{i}" for i in range(40_000))), *((i, f"w{i}") for i in range(2, 30_000))]
    found = importance.chunks(make(spark, rows).coalesce(1), "doc_id", "text", 1, 0)
    sizes = [F.size(c).alias(c) for c, kind in found.dtypes if kind.startswith("array")]
    got = found.select(*sizes).groupBy().agg(*[F.max(c).alias(f"{c}_most") for c in found.columns if c in {"words", "grams", "doc_ids"}], F.sum("words"), F.sum("doc_ids")).first()
    assert max(got[:3]) <= 10_000 and tuple(got[3:]) == (40_000, len(rows))


@pytest.mark.parametrize("gram", [1, 2])
def test_weights_of_chunks_in_many_rows(spark, monkeypatch, gram):
    monkeypatch.setattr(importance, "PIECE", 7)
    rows, target = draw_rows(), ["alpha beta gamma w1 w2", None]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.weights(make(spark, rows).repartition(2), aim, gram=gram, buckets=97)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, slow_weights(rows, target, gram, 97)))


def test_words_of_one_id(spark, monkeypatch):
    """Where a seed gives two words one id, another is taken."""
    plain = importance.word_ids
    monkeypatch.setattr(importance, "word_ids", lambda w, seed: plain(w, seed) % (5 if seed == 0 else 2**62))
    rows = draw_rows()
    got = importance.weights(make(spark, rows), spark.createDataFrame([("alpha w3",)], "text string"), buckets=97)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, slow_weights(rows, ["alpha w3"], 1, 97)))


def test_draw(spark):
    rows = draw_rows()
    docs, aim = make(spark, rows), spark.createDataFrame([("alpha beta w5",)], "text string")
    got = [r.asDict() for r in importance.drawn(importance.weights(docs, aim)).collect()]
    ready = [r for r in got if r["n_words"] >= 20]
    most = len(ready) // 10
    for r in got:
        h = int(hashlib.sha256(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        assert r["score"] == r["weight"] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    order = sorted(ready, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in order] == [*range(1, most + 1), *[None] * (len(ready) - most)]
    assert all(r["rank"] is None for r in got if r["n_words"] < 20)
    chosen = importance.resampled(docs, aim, percent=50)
    assert chosen.columns == docs.columns and chosen.count() == len(ready) // 2
    assert importance.drawn(importance.weights(docs.limit(0), aim)).count() == 0
    assert importance.weights(docs, aim.limit(0)).count() == len(rows)


def fullest(left, capacity):
    sums = {0}
    for n, c in left.items():
        for _ in range(min(c, capacity // n)):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_combinations_are_the_fullest():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 30, 64])
        counts = {n: rng.randrange(0, 9) for n in range(1, capacity + 1) if rng.random() < 0.4}
        left = Counter(counts)
        for bins, own in packing.combinations(counts, capacity):
            for _ in range(bins):
                assert sum(n * k for n, k in own) == fullest(left, capacity)
                left.subtract(dict(own))
        assert not any(left.values())


def test_plan_of_a_billion_pieces():
    x = np.minimum(np.exp(np.random.default_rng(1).normal(6.2, 1.0, 200_000)).astype(int) + 1, 2048)
    counts = {n: int(c) * 5000 for n, c in enumerate(np.bincount(x)) if c}
    plan = packing.combinations(counts)
    bins, total = sum(b for b, _ in plan), sum(n * c for n, c in counts.items())
    assert len(plan) < 16_000 and bins <= 1.0001 * total / 2048


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    rng = random.Random(4)
    rows = [(None, "null id"), (1, None), (1, ""), (2, "dup"), (2, "dup"), ((1 << 60) + 1, "long " * 5000)]
    rows += [(i, "word " * rng.randrange(0, 40)) for i in range(10, 90)]
    docs = make(spark, rows).repartition(4)
    from kelpie.llm.common import written

    table = written(packing.pieces(docs, BYTE, capacity=capacity), "test-pieces")
    got = packing.packed(table, capacity)
    back = got.collect()
    tok = tokens.load(BYTE)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, n in enumerate(packing.cut(len(ids), capacity)):
            want.append((i, k, at, n, np.asarray(ids[at : at + n], "<u4").tobytes()))
            at += n
        assert at == len(ids) and all(n == capacity for n in packing.cut(len(ids), capacity)[1:])
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"]))) for r in back)
    bins = {}
    for r in back:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for own in bins.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) <= 1.1 * -(-sum(len(r["ids"]) // 4 for r in back) // capacity) + 1
    whole = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in packing.sequences(got).collect()}
    assert whole == {k: (sum(n for _, n, _ in v), b"".join(x for _, _, x in sorted(v))) for k, v in bins.items()}
    assert packing.packed(written(packing.pieces(docs.limit(0), BYTE), "test-pieces")).count() == 0
    assert got.select(F.sum("length")).first()[0] == sum(r[3] for r in want)
