"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. The ordinary one is trained on windows of
ordinary documents and, over a few rounds, on the ordinary words that compress best with the toxic one. The toxic one is
trained on the words of toxic documents that have 5-character pieces which toxic documents have far more often than
ordinary ones. zstd's trainer leaves out some short ones of these words; those that its dictionary doesn't compress are put
before its content. The toxic compressor has the ordinary content, too, so that the bytes it saves on a window of WINDOW
words, its distance, come from the toxic content alone. A document's largest distances go through a logistic curve that is
calibrated on labelled documents which the dictionaries have not seen.

The fit takes place in one task. It uses at most SAMPLE labelled documents of each kind, the first by a hash of their id,
as far as SAMPLE_BYTES of text in all. The logistic curve weights each kind by the labelled rows that its sample stands for, so a
score is a probability at the table's own share of toxic documents, whatever the sample's. Scoring takes every window of
every text.

Defined results. A null or empty text has no window, and the score of distances of 0. A null doc_id is not held out.
Without labelled documents of both kinds every score is the share of toxic ones (0 where there are none). Repeated rows
get the same score; an empty table gives an empty table. Extra columns are ignored, and kept by kept().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

WINDOW = 8
SAMPLE = {1: 2500, 0: 5000}
SAMPLE_BYTES = 48 << 20
PIECE = 5
ROUNDS = 4
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 16_384, 60_000, 1_024
#: What the trainer is given and how it cuts: windows (evenly spaced ones), and the lengths of segments and of their pieces.
TRAINING_WINDOWS, SEGMENT, MER = 60_000, 16, 6
CHUNK = 1 << 18
LEVEL = 3
#: Of three labelled documents two make the dictionaries and one calibrates.
CALIBRATE = 3


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # of the features, and the constant last

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.toxic)


def _compressor(content: bytes):
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=80, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, A-Z lower-cased and white space as blanks; begin and length of each window; the windows
    before each text's first, and in all). A window has WINDOW words and a blank on either side where there is one."""
    buf, bounds = spans.joined(raw)
    begins, ends = spans.words(buf, bounds[:-1])
    buf = spans.lower(buf)
    buf[(buf >= 9) & (buf <= 13)] = 32
    first_word = np.searchsorted(begins, bounds)
    counts = -(-np.diff(first_word) // WINDOW)
    upto = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    a = first_word[text] + WINDOW * (np.arange(upto[-1]) - upto[text])
    z = np.minimum(a + WINDOW, first_word[text + 1]) - 1
    low, high = np.maximum(begins[a] - 1, bounds[text]), np.minimum(ends[z] + 1, bounds[text + 1])
    return buf, np.stack([low, high - low], axis=1), upto


def distances(pair, buf: np.ndarray, segments: np.ndarray) -> np.ndarray:
    if not len(segments):
        return np.zeros(0, np.int64)
    given = zstandard.BufferWithSegments(buf.tobytes(), segments.astype("<u8").tobytes())
    size = [np.fromiter(map(len, got), np.int64, len(got)) for got in (c.multi_compress_to_buffer(given, threads=1) for c in pair)]
    return size[0] - size[1]


def features(pair, raw: list[bytes]) -> np.ndarray:
    """For each text: its largest distance, the sum of its three largest, how many are 5 and more, log of its windows."""
    out = np.zeros((len(raw), 4))
    for a, z in spans.chunks(list(map(len, raw)), 1 << 18):
        buf, segments, upto = windows(raw[a:z])
        d = distances(pair, buf, segments)
        for i in range(z - a):
            own = d[upto[i] : upto[i + 1]]
            if len(own):
                top = np.sort(np.partition(own, -3)[-3:] if len(own) > 3 else own)[::-1]
                out[a + i] = max(0, top[0]), np.maximum(top, 0).sum(), np.log1p((own >= 5).sum()), np.log1p(len(own))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the constant is last. rows: how many each row counts as."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (rows * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _spelled(raw: bytes) -> list[bytes]:
    return spans.lower(np.frombuffer(raw, np.uint8)).tobytes().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")


def trained(samples: list[bytes], size: int, segment: int | None = None) -> bytes:
    """The content of a dictionary that zstd trains on samples; their own bytes where they are too few to train on."""
    cut = {} if segment is None else {"k": segment, "d": MER}
    try:
        return zstandard.train_dictionary(size, [x for x in samples if len(x) >= 8], level=LEVEL, **cut).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts end to end; begin and length of each."""
    at = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), np.stack([at[:-1], np.diff(at)], axis=1)


def fit(toxic: list[bytes], ordinary: list[bytes], stands_for: tuple[float, float] | None = None) -> Model:
    """stands_for: how many toxic and ordinary documents the lists are samples of; themselves where it isn't given."""
    if not toxic or not ordinary:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return Model(b"", b"", [0, 0, 0, 0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))])
    few = min(len(toxic), len(ordinary)) < CALIBRATE  # then the same documents calibrate
    fit_t, fit_o = ([x for i, x in enumerate(g) if few or i % CALIBRATE] for g in (toxic, ordinary))
    cal_t, cal_o = ([x for i, x in enumerate(g) if few or not i % CALIBRATE] for g in (toxic, ordinary))

    def pieces(raw: bytes) -> set[bytes]:
        t = b" ".join(x for x in _spelled(raw) if x)
        return {t[i : i + PIECE] for i in range(len(t) - PIECE + 1)}

    in_t, in_o = Counter(p for x in fit_t for p in pieces(x)), Counter()
    for x in fit_o:
        in_o.update(pieces(x) & in_t.keys())
    rich = {p for p, k in in_t.items() if k >= max(3, 0.004 * len(fit_t)) and k / len(fit_t) >= 30 * (in_o[p] + 0.5) / len(fit_o)}
    found: list[bytes] = []
    for x in fit_t:
        spelled = (b" " + w + b" " for w in _spelled(x))
        found += [w for w in spelled if any(w[i : i + PIECE] in rich for i in range(len(w) - PIECE + 1))]

    plain = []
    for a, z in spans.chunks(list(map(len, fit_o)), 1 << 20):
        buf, segments, _ = windows(fit_o[a:z])
        whole = buf.tobytes()
        plain += [whole[b : b + n] for b, n in segments.tolist()]
    every, segments = _laid_out(plain)
    base = trained(plain[:: len(plain) // TRAINING_WINDOWS + 1], ORDINARY_BYTES)
    own = trained(found, TOXIC_BYTES, SEGMENT)
    words = [w for w, _ in Counter(found).most_common()]
    saved = distances((_compressor(base), _compressor(base + own)), *_laid_out(words))
    missed = b"".join(w for w, d in zip(words, saved.tolist(), strict=True) if 2 * d < len(w) - 2)[:TOXIC_BYTES]
    own = missed + own

    shared, hard, near = {own[i : i + 4] for i in range(len(own) - 3)}, b"", []
    for _ in range(ROUNDS):
        d = distances((_compressor(hard + base), _compressor(hard + base + own)), every, segments)
        more = (b" " + w + b" " for i in np.flatnonzero(d >= 2).tolist() for w in plain[i].split())
        more = [w for w in more if any(w[j : j + 4] in shared for j in range(len(w) - 3))]
        if not more:
            break
        near += more
        # Of one word, what the trainer leaves out stays hard; later rounds show it again.
        counted = Counter(near)
        hard = (trained(near, HARD_BYTES // 6, SEGMENT) + b"".join(w for w, _ in counted.most_common(2500)[::-1]))[-HARD_BYTES:]
    model = Model(hard + base, hard + base + own, [])
    x = features(model.compressors(), cal_t + cal_o)
    # Rows count as the documents they stand for, scaled to the rows at hand so that the ridge keeps its strength.
    total_t, total_o = stands_for or (len(toxic), len(ordinary))
    rows = np.r_[np.full(len(cal_t), total_t / len(cal_t)), np.full(len(cal_o), total_o / len(cal_o))]
    model.weights = _logistic(x, np.r_[np.ones(len(cal_t)), np.zeros(len(cal_o))], rows * (len(rows) / rows.sum())).tolist()
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(toxic, h, text) of labelled rows whose crc32 of the id modulo 5 is not 0, within the bounds above, and how many such
    labels there are of either kind."""
    i = F.col("__label_id")
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("toxic").alias("__toxic"))
    marks = marks.filter(common.crc_remainder(i) != 0)
    labelled = {r["__toxic"]: r["count"] for r in marks.groupBy("__toxic").count().collect()}  # two numbers
    firsts = [marks.filter(F.col("__toxic") == kind).orderBy(F.xxhash64(i), i).limit(n) for kind, n in SAMPLE.items()]
    chosen = firsts[0].unionByName(firsts[1])  # SAMPLE rows at most, so a broadcast; no text is shuffled but theirs
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("__id") == i).select(F.col("__toxic").cast("int").alias("toxic"), F.xxhash64(i).alias("h"), "text"), labelled


def _scores(model: Model, pair, raw: list[bytes]) -> np.ndarray:
    x = features(pair, raw)
    w = np.asarray(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, labelled = sample(docs, labels, id_col, text_col)
    most = dict(SAMPLE)
    room = {kind: SAMPLE_BYTES * n // sum(most.values()) for kind, n in most.items()}

    def in_one_task(batches):
        got, size = {0: [], 1: []}, {0: 0, 1: 0}
        for b in batches:
            for kind, raw in zip(b.column("toxic").to_pylist(), common.raw_texts(b), strict=True):
                if kind in got and len(got[kind]) < most[kind] and size[kind] < room[kind]:
                    got[kind].append(raw)
                    size[kind] += len(raw)
        # What was read of a kind, by either bound, stands for all labels of the kind.
        m = fit(got[1], got[0], (labelled.get(1, 0), labelled.get(0, 0)))
        yield common.batch(ordinary=[m.ordinary], toxic=[m.toxic], weights=pa.array([[float(x) for x in m.weights]]))

    ordered = rows.repartition(1).sortWithinPartitions("h", "text")
    row = ordered.mapInArrow(in_one_task, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(row["ordinary"]), bytes(row["toxic"]), list(row["weights"])) if row else fit([], [])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""

    def score(batches):
        pair = model.compressors()
        for b in common.text_slices(batches, CHUNK):
            s = _scores(model, pair, common.raw_texts(b))
            yield common.batch(doc_id=b.column("doc_id"), score=s, predicted=(s >= 0.5).astype(np.int32))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, score double, predicted int")


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""

    def keep(batches):
        pair = model.compressors()
        for b in common.text_slices(batches, CHUNK, text_col):
            yield b.filter(pa.array(_scores(model, pair, [x or b"" for x in common.raw_texts(b, text_col)]) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op4_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(common.crc_remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
