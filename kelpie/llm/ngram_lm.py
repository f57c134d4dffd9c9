"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting. Tasks hash words to 64 bits, count the bigrams of about FLUSH tokens at a time and hand them out by shard; a
shard adds up its bigrams, writes them as one file (sorted keys, one-byte counts, an overflow table), and passes on what
each first word (tokens and bigram types that follow it, by count 1, 2, 3 and more) and each second word (tokens, bigram
types that end in it) has in the shard. A second shuffle adds those up by word shard and writes the words' files. A
bigram's shard is its first word's, except for words that take more than a 2000th of a sample of the text: their bigrams
are dealt out by the bigram's own hash. The sample only decides the routing, not the counts.

Scoring. Each worker maps the files and looks up the sorted distinct keys of some SCORED bytes of text, shard by shard.
Visits to shards grow with the text times the shards, so they are made for as much text as memory allows. The model grows
with the corpus; what a worker holds in memory of its own does not.

p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w), p(w) = max(N(.w) - D'(N(.w)), 0) / N(..) + g' / (V + 1), with the
discounts D, D' for counts 1, 2 and 3 and more from the counts of counts, g and g' the mass they free. A word never seen
has g' / (V + 1); after a word never seen, p(w).

Order 2 is what fits the disk and time budgets at 0.5 GB (9 bytes a bigram type; trigrams would take 2.5 times as much).

Defined results. A null or empty text is its end token. A null doc_id is not held out and learns. Repeated rows count and
score as rows. Without training tokens base_score is that of N = V = 0 and score is that of p = 1. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

FLUSH = 1 << 21
SHARD_BYTES = 16 << 20
MOST_BITS = 20
CHUNK = 1 << 19
SCORED = 4 << 20
#: Hashes of the marks before and after a text; no word hashes to them but by chance.
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)
PAIR = np.uint64(0x9FB21C651E98DF25)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return spans.mix(spans.mix(v * PAIR) + w)


def keys_of(v: np.ndarray, w: np.ndarray, heavy: np.ndarray, is_heavy: np.ndarray | None = None) -> np.ndarray:
    """Bigram keys: the MOST_BITS highest bits route (the first word's, or the pair's own after a heavy word, see is_heavy
    where that is known)."""
    h = pair_hash(v, w)
    route = np.where(np.isin(v, heavy) if is_heavy is None else is_heavy, h, v) if len(heavy) else v
    low = np.uint64(MOST_BITS)
    return (route >> np.uint64(64 - MOST_BITS) << np.uint64(64 - MOST_BITS)) | (h << low >> low)


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, where each text's tokens begin and the last end)."""
    buf, bounds = spans.joined(raw)
    begins, ends = spans.words(buf, bounds[:-1])
    h = spans.word_hashes(spans.lower(buf), begins, ends)
    first = np.searchsorted(begins, bounds)
    at = first + np.arange(len(bounds))
    t = np.full(at[-1], END, np.uint64)
    is_word = np.ones(at[-1], bool)
    is_word[at[1:] - 1] = False
    t[is_word] = h
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[at[:-1]] = BEGIN
    return before, t, at


def _sums(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys, and the sum of each array of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(x[order], first) if len(keys) else x for x in values]


def _by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, first, last) of sorted keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else []
    return [(int(shard[a]), int(a), int(z)) for a, z in zip(edges, edges[1:], strict=False)]


def _heavy(train: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of words with over a 2000th of the tokens of a fiftieth of the texts: at most 2000."""

    def count(batches):
        for b in common.text_slices(batches, 1 << 22):
            _, t, _ = tokens(common.raw_texts(b))
            keys, n = np.unique(t, return_counts=True)
            often = n * 4000 > len(t)
            yield common.batch(h=keys[often].astype(np.int64), n=n[often], m=np.full(int(often.sum()), len(t), np.int64))

    some = train.filter(F.pmod(F.xxhash64("text"), F.lit(50)) == 0)
    found = some.mapInArrow(count, "h bigint, n bigint, m bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return np.array([r["h"] for r in found.filter("n * 2000 > m").orderBy(F.desc("n")).limit(2000).collect()], np.int64).astype(np.uint64)


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: the arrays' lengths, then the arrays. Written under a name of its own and renamed."""
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    there.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with there.open_output_stream(own) as f:
        f.write(np.array([len(a) for a in arrays], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes())
    there.move(own, f"{path}/{name}")


def _map(folder: str, name: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped. A file in a store without paths is copied to an unnamed local file first."""
    if folder.startswith("file:"):
        raw = np.memmap(f"{common.local_path(folder)}/{name}", np.uint8, "r").view(np.ndarray)
    else:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        with tempfile.NamedTemporaryFile() as f, there.open_input_stream(f"{path}/{name}") as src:
            while block := src.read(1 << 22):
                f.write(block)
            f.flush()
            raw = np.memmap(f.name, np.uint8, "r").view(np.ndarray)
    sizes, at, out = np.frombuffer(raw[: 8 * len(kinds)], "<i8"), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        end = at + n * np.dtype(kind).itemsize
        out.append(raw[at:end].view(kind) if end - at and at % np.dtype(kind).itemsize == 0 else np.frombuffer(raw[at:end], kind))
        at = end
    return out


BIGRAM_FILE = ["<u8", "<u8", "<u8", "u1"]  # keys, places and counts over 254, counts
WORD_FILE = ["<u8", "<u8", "<u8", "<u4", "<u4", "<u4", "<u4"]  # hash, tokens, tokens as first word, types after it by count, types that end in it


class Model:
    """Where the files are and the numbers that hold for all of them."""

    def __init__(self, folder: str, bits: int, heavy: np.ndarray, n: int, v: int, types: int, d2: list[float], d1: list[float], free: float):
        self.folder, self.bits, self.heavy, self.n, self.v, self.types, self.d2, self.d1, self.free = folder, bits, heavy, n, v, types, d2, d1, free
        self.files: dict[str, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    def _file(self, kind: str, shard: int) -> list[np.ndarray]:
        name = f"{kind}-{shard:07d}"
        if name not in self.files:
            self.files[name] = _map(self.folder, name, BIGRAM_FILE if kind == "bigrams" else WORD_FILE)
        return self.files[name]

    def _found(self, kind: str, keys: np.ndarray):
        """(file, places in keys, places in the file) of the sorted keys that are there."""
        have = self.names[kind]
        for shard, a, z in _by_shard(keys, self.bits):
            if shard in have:
                f = self._file(kind, shard)
                i = np.minimum(np.searchsorted(f[0], keys[a:z]), len(f[0]) - 1)
                hit = np.flatnonzero(f[0][i] == keys[a:z])
                yield f, a + hit, i[hit]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float64)
        for f, k, i in self._found("bigrams", keys):
            c = f[3][i].astype(np.float64)
            big = np.flatnonzero(c == 255)
            c[big] = f[2][np.searchsorted(f[1], i[big])]
            out[k] = c
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((6, len(keys)), np.float64)
        for f, k, i in self._found("words", keys):
            for row, x in zip(out, f[1:], strict=True):
                row[k] = x[i]
        return out

    def scores(self, raw: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        before, t, at = tokens(raw)
        vocab, inverse = np.unique(np.append(t, BEGIN), return_inverse=True)
        own, first = inverse[:-1], np.roll(inverse, 1)[:-1]
        first[at[:-1]] = inverse[-1]
        c, total, n1, n2, n3, ends = self.words(vocab)
        p1 = np.maximum(ends - _discount(self.d1, ends), 0) / max(1, self.types) + self.free / (self.v + 1)
        g = np.where(total > 0, (self.d2[0] * n1 + self.d2[1] * n2 + self.d2[2] * n3) / np.maximum(total, 1), 1.0)
        keys, pair = np.unique(keys_of(before, t, self.heavy, np.isin(vocab, self.heavy)[first]), return_inverse=True)
        c2 = self.counts(keys)[pair]
        p = np.maximum(c2 - _discount(self.d2, c2), 0) / np.maximum(total, 1)[first] + g[first] * p1[own]
        base = np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))
        by_text = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  each text has its end
        return np.diff(at), by_text((c > 0).astype(np.int64)[own]), by_text(base[own]), by_text(np.log10(np.maximum(p, 1e-300)))


def _discount(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def _discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2, 3 and more, from how many types have counts 1 to 4; within 0 and the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(min(max(x, 0.05), k)) for x, k in zip(raw, (0.95, 1.9, 2.85), strict=True)]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows' texts, its files in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 4
    while bits < MOST_BITS and size > SHARD_BYTES << bits:
        bits += 1
    heavy, folder = _heavy(rows, "text"), common.scratch_path(spark, "lm")

    def flush(held):
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, index, n = np.unique(keys_of(v, w, heavy), return_index=True, return_counts=True)
        v, w, out = v[index], w[index], []
        for shard, a, z in _by_shard(keys, bits):
            order = np.argsort(v[a:z], kind="stable")
            firsts, runs = np.unique(v[a:z], return_counts=True)
            out.append((shard, firsts.tobytes(), runs.astype("<u4").tobytes(), w[a:z][order].tobytes(), n[a:z][order].astype("<u4").tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(blocks_schema.names, x, strict=True)) for x in out], blocks_schema)

    blocks_schema = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in ("v", "runs", "w", "n"))])

    def count(batches):
        held, n = [], 0
        for b in common.text_slices(batches, CHUNK):
            v, w, _ = tokens(common.raw_texts(b))
            held.append((v, w))
            n += len(w)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def add_up(b):
        v = np.repeat(np.frombuffer(b"".join(b["v"]), "<u8"), np.frombuffer(b"".join(b["runs"]), "<u4"))
        w, n = np.frombuffer(b"".join(b["w"]), "<u8"), np.frombuffer(b"".join(b["n"]), "<u4").astype(np.int64)
        keys = keys_of(v, w, heavy)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        c, keys, v, w = np.add.reduceat(n[order], first), keys[first], v[order][first], w[order][first]
        over = np.flatnonzero(c >= 255)
        _save(folder, f"bigrams-{b['shard'].iloc[0]:07d}", [keys.astype("<u8"), over.astype("<u8"), c[over].astype("<u8"), np.minimum(c, 255).astype("u1")])
        one = np.ones(len(c), np.int64)
        zero = np.zeros(len(c), np.int64)
        of_first = [zero, c, (c == 1) * one, (c == 2) * one, (c >= 3) * one, zero]
        of_second = [c, zero, zero, zero, zero, one]
        # Each kind summed on its own first, so that no array is twice as long.
        a_keys, a = _sums(v, of_first)
        z_keys, z = _sums(w, of_second)
        words, sums = _sums(np.concatenate([a_keys, z_keys]), [np.concatenate(x) for x in zip(a, z, strict=True)])
        counts = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        out = [
            (s, words[a:z].tobytes(), np.stack([x[a:z] for x in sums[:2]]).astype("<u8").tobytes(), np.stack([x[a:z] for x in sums[2:]]).astype("<u4").tobytes(), counts if i == 0 else [0] * 4)
            for i, (s, a, z) in enumerate(_by_shard(words, bits))
        ]
        return pd.DataFrame(out, columns=["shard", "words", "long", "short", "counts"])

    def add_words(b):
        keys, longs, shorts = [], [], []
        for w, x, y in zip(b["words"], b["long"], b["short"], strict=True):
            keys.append(np.frombuffer(w, "<u8"))
            longs.append(np.frombuffer(x, "<u8").reshape(2, -1))
            shorts.append(np.frombuffer(y, "<u4").reshape(4, -1))
        longs, shorts = np.concatenate(longs, axis=1).astype(np.int64), np.concatenate(shorts, axis=1).astype(np.int64)
        words, sums = _sums(np.concatenate(keys), [*longs, *shorts])
        _save(folder, f"words-{b['shard'].iloc[0]:07d}", [words.astype("<u8"), *(x.astype(k) for x, k in zip(sums, WORD_FILE[1:], strict=True))])
        ends = sums[5]
        return pd.DataFrame([(b["shard"].iloc[0], int(sums[0].sum()), int((sums[0] > 0).sum()), int(ends.sum()), *(int((ends == k).sum()) for k in (1, 2, 3, 4)), int((ends >= 3).sum()))],
                            columns=["shard", "n", "v", "types", "n1", "n2", "n3", "n4", "n3_up"])

    blocks = rows.mapInArrow(count, "shard int, v binary, runs binary, w binary, n binary")
    shards = common.written(
        blocks.groupBy("shard").applyInPandas(add_up, "shard int, words binary, long binary, short binary, counts array<bigint>"), "lm-sums"
    )
    of_words = common.written(
        shards.drop("counts").groupBy("shard").applyInPandas(add_words, "shard int, n bigint, v bigint, types bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n3_up bigint"), "lm-words"
    )
    # A few numbers for each shard, added up.
    pairs = shards.agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(4)]).first()
    s = of_words.agg(*[F.sum(x).alias(x) for x in ("n", "v", "types", "n1", "n2", "n3", "n4", "n3_up")]).first()
    common.forget(shards)
    d1 = _discounts([s[x] or 0 for x in ("n1", "n2", "n3", "n4")])
    free = (d1[0] * (s["n1"] or 0) + d1[1] * (s["n2"] or 0) + d1[2] * (s["n3_up"] or 0)) / max(1, s["types"] or 0) if s["types"] else 1.0
    model = Model(folder, bits, heavy, s["n"] or 0, s["v"] or 0, s["types"] or 0, _discounts([pairs[i] or 0 for i in range(4)]), d1, free)
    model.names = _shards(spark, folder)
    return model


def _shards(spark, folder: str) -> dict[str, set[int]]:
    """The shards that have a file, of each kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in there.listStatus(path)] if there.exists(path) else []
    return {k: {int(n.rsplit("-", 1)[1]) for n in names if n.startswith(k)} for k in ("bigrams", "words")}


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    def score(batches):
        for b in common.text_chunks(batches, SCORED):
            n, known, base, own = model.scores(common.raw_texts(b))
            yield common.batch(doc_id=b.column("doc_id"), n_tokens=n, n_known=known, base_score=base, score=own)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = F.coalesce(common.crc_remainder(F.col("doc_id")) == 1, F.lit(False))
    model = train(docs.filter(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
