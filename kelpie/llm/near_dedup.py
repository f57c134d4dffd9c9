"""Near duplicates: improved consistent weighted sampling over weighted shingles, banding, weighted Jaccard.

Shingles are runs of SHINGLE words (all words of a shorter text). A shingle weighs its count in the text times the mean
damped inverse document frequency, sqrt(ln(1 + n / df)), of its words. Word frequencies are counted over all documents in
a table of DF_BINS hashed bins, which bounds what tasks hold; bins that words share only smooth the weights.

1. Each text gets BANDS x ROWS consistent weighted samples of 16 bits. Equal texts (by two 64-bit hashes) are one text
   from here on, with a number of its own. ROWS samples make a band's key; texts with a key in common are a bucket.
2. In a bucket, texts of which AGREE samples and more agree are joined (a pair at THRESHOLD has fewer once in 10^4 times);
   a bucket of over BUCKET texts is joined as a whole. The components of these joins are the groups that can hold a class.
3. A group of up to WINDOW texts (and WINDOW_BYTES) meets in one task, its texts travelling once, and the weighted Jaccard
   similarity of every pair of it is computed. Pairs of THRESHOLD and more are links; links make classes.
4. A larger group is dealt into blocks of half a window, and each pair of blocks meets in one task, so every pair of texts
   is compared, at a cost that grows with the square of the group; no task holds more than two blocks.
5. Only with exact=False, a group of over PASSES + 1 blocks (some 2,800 texts or 22 MB) is sorted by its samples PASSES times, each time beginning with another band's, and cut into
   windows of WINDOW texts: texts that share more first samples than most meet, as if by keys that are as long as the group
   is large. Every pair of a window is compared. Work is in proportion to the group, however alike or unlike its texts are;
   a pair at the threshold may be missed by all passes, but a class hangs together by all of its links (see the README for
   the recall measured).
6. A class is named after its smallest member.

Pairs of a window are compared by a matrix product over the shingles that they share; only a star for each class found
there leaves the task.

Defined results. Null and empty texts have no shingle: they are copies of each other, as any equal texts are. A null
doc_id is smaller than any other, and then names its class (class_id null). Rows with equal text are in one class,
repeated ids included. An empty table gives an empty table. Extra columns are ignored by classes() and kept by kept().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exact_dedup, ngram_lm, spans

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
AGREE = 22
BUCKET = 512
WINDOW, WINDOW_BYTES = 512, 4 << 20
PASSES = 10
DF_BINS = 1 << 20
CHUNK = 1 << 18
#: Pairs of a computed similarity this much below the threshold are links: sums differ in their last digits.
ROUNDING = 1e-9


def _idf_bins(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (DF_BINS - 1)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), and where each text's begin (and the last ends)."""
    buf, bounds = spans.joined(raw)
    begins, ends = spans.words(buf, bounds[:-1])
    return spans.word_hashes(spans.lower(buf), begins, ends), np.searchsorted(begins, bounds)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many texts have a word of each bin; summed in tasks, then by bin; float32 inverse frequencies, 4 MB."""

    def count(batches):
        total, n = np.zeros(DF_BINS, np.int64), 0
        for b in common.text_slices(batches, CHUNK):
            h, at = word_hashes(common.raw_texts(b))
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            seen = np.unique(text * DF_BINS + _idf_bins(h)) % DF_BINS
            bins, k = np.unique(seen, return_counts=True)
            total[bins] += k
            n += b.num_rows
        found = np.flatnonzero(total)
        yield common.batch(part=np.r_[found >> 10, -1].astype("i4"), at=np.r_[found & 1023, 0].astype("i4"), n=np.r_[total[found], n])

    sums = texts.select("text").mapInArrow(count, "part int, at int, n bigint").groupBy("part", "at").agg(F.sum("n").alias("n"))

    def pack(b):
        dense = np.zeros(1024, "<i8")
        dense[b["at"]] = b["n"]
        return pd.DataFrame({"part": b["part"].iloc[:1], "bins": [dense.tobytes()]})

    # 8 KB for each 1,024 bins come back, whatever the input.
    df, n = np.zeros(DF_BINS), 0
    for r in sums.groupBy("part").applyInPandas(pack, "part int, bins binary").collect():
        dense = np.frombuffer(bytes(r["bins"]), "<i8")
        if r["part"] < 0:
            n = int(dense[0])
        else:
            df[r["part"] * 1024 : r["part"] * 1024 + 1024] = dense
    return np.sqrt(np.log(1 + n / np.maximum(df, 1))).astype(np.float32)


def shingles(raw: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight of one, count, where each text's begin): distinct in each text, sorted by shingle there."""
    h, at = word_hashes(raw)
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    upto = np.concatenate([[0], np.cumsum(count)])
    first = at[text] + np.arange(upto[-1]) - upto[text]
    size = np.minimum(n[text], SHINGLE)
    w = idf[_idf_bins(h)] if len(h) else np.zeros(0, np.float32)
    key, weight = np.zeros(len(first), np.uint64), np.zeros(len(first), np.float32)
    for k in range(SHINGLE):
        there = size > k
        word = np.where(there, first + k, 0)
        key = np.where(there, spans.mix(key * ngram_lm.PAIR + h[word] + np.uint64(k)), key) if len(h) else key
        weight += np.where(there, w[word], 0) if len(h) else weight
    weight /= np.maximum(size, 1)
    order = np.lexsort((key, text))
    key, weight, text = key[order], weight[order], text[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) if len(key) else np.zeros(0, np.int64)
    return key[new], weight[new], np.diff(np.append(new, len(key))), np.searchsorted(text[new], np.arange(len(n) + 1))


_TINY = np.float32(1e-9)


def _uniform(h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each hash."""
    x = spans.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    scale = np.float32(2.0**-32)
    return (x >> np.uint64(32)).astype(np.float32) * scale + _TINY, (x & np.uint64(0xFFFFFFFF)).astype(np.float32) * scale + _TINY


def samples(key: np.ndarray, weight: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n samples (64-bit) for each text that has shingles: improved consistent weighted sampling. With r and c from
    Gamma(2, 1) and b uniform, t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the shingle of the
    smallest a, with its t, is the sample."""
    out = np.zeros((n, len(at) - 1), np.uint64)
    log_s = np.log(weight)
    sizes = np.diff(at)
    for j in range(n):
        (u1, u2), (u3, u4), (b, _) = _uniform(key, 3 * j + 1), _uniform(key, 3 * j + 2), _uniform(key, 3 * j + 3)
        r = -np.log(u1 * u2)
        t = np.floor(log_s / r + b)
        a = np.log(-np.log(u3 * u4)) - r * (t - b) - r
        least = np.minimum.reduceat(a, at[:-1])
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, at[:-1])]
        out[j] = spans.mix(key[first] + t[first].astype(np.int64).astype(np.uint64) * ngram_lm.PAIR)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts' (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    i = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][i] == b[0]
    least = float(np.minimum(a[1][i[hit]], b[1][hit]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most


#: A shingle that at least so many texts of a window have is a column of the matrix product; for others pairs are listed.
DENSE = 8
COLUMNS = 2048


def similarities(key: np.ndarray, weight: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of all pairs of texts (as shingles() gives them). A shingle that a text has k times is k columns of
    the shingle's weight, so the sum of minima is a product of the column matrix with itself."""
    n = len(at) - 1
    weight = weight.astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(at))
    total = np.bincount(text, weights=weight * count, minlength=n)
    layer = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key, weight, text = np.repeat(key, count), np.repeat(weight, count), np.repeat(text, count)
    order = np.lexsort((text, layer, key))
    key, weight, text, layer = key[order], weight[order], text[order], layer[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (layer[1:] != layer[:-1])]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    least = np.zeros((n, n))
    for k in range(2, min(DENSE, n + 1)):
        at_k = first[size == k]
        if len(at_k):
            for i in range(k):
                for j in range(i):  # texts ascend in a column
                    least += np.bincount(text[at_k + j] * n + text[at_k + i], weights=weight[at_k], minlength=n * n).reshape(n, n)
    least += least.T
    wide = np.flatnonzero(size >= DENSE)
    for a in range(0, len(wide), COLUMNS):
        some = wide[a : a + COLUMNS]
        entries = np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
        x = np.zeros((n, len(some)))
        x[text[entries], np.repeat(np.arange(len(some)), size[some])] = np.sqrt(weight[entries])
        least += x @ x.T
    return least / np.maximum(total[:, None] + total[None, :] - least, 1e-300)


def classes_of(link: np.ndarray) -> np.ndarray:
    """The smallest index that each index hangs together with, from a symmetric matrix of links."""
    n = len(link)
    link = link | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _signed(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """texts (h1, h2, text) -> h1, h2, n_bytes, samples (2 bytes each) of each row with a shingle."""

    def sign(batches):
        for b in common.text_slices(batches, CHUNK):
            raw = common.raw_texts(b)
            key, weight, count, at = shingles(raw, idf)
            some = np.flatnonzero(np.diff(at))
            if len(some):
                s = samples(key, weight * count.astype(np.float32), np.append(at[some], at[-1]), BANDS * ROWS)
                flat = np.ascontiguousarray((s.T >> np.uint64(48)).astype("<u2"))
                rows = b.take(pa.array(some))
                yield common.batch(h1=rows.column("h1"), h2=rows.column("h2"), n_bytes=np.array([len(raw[i]) for i in some], np.int64), samples=[x.tobytes() for x in flat])

    return texts.select("h1", "h2", "text").mapInArrow(sign, "h1 bigint, h2 bigint, n_bytes bigint, samples binary")


def _by_size(size: np.ndarray, first: np.ndarray):
    """(rows of each group) as one matrix for each size of groups."""
    for g in np.unique(size[size > 1]).tolist():
        yield first[size == g][:, None] + np.arange(g)


def _joins(met: DataFrame) -> DataFrame:
    """met (key, nid, samples) -> (a, b): in each bucket a star for each set of texts whose samples agree."""

    def found(key, nid, s):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for rows in _by_size(np.diff(np.append(first, len(key))), first):
            g = rows.shape[1]
            if g <= 16:
                link = np.zeros((len(rows), g, g), bool)
                for i in range(g):
                    for j in range(i):
                        link[:, i, j] = link[:, j, i] = (s[rows[:, i]] == s[rows[:, j]]).sum(axis=1) >= AGREE
                label = np.tile(np.arange(g), (len(rows), 1))
                for _ in range(g):
                    label = np.minimum(label, np.where(link, label[:, None, :], g).min(axis=2))
            else:
                label = np.stack([classes_of(sum((x[:, None] == x[None, :]).astype(np.uint8) for x in s[r].T) >= AGREE) for r in rows])
            root = np.take_along_axis(rows, label, axis=1)
            own = root != rows
            yield nid[root[own]], nid[rows[own]]

    def compare(batches):
        held = None
        for b in batches:
            now = (b.column("key").to_numpy(), b.column("nid").to_numpy(), np.frombuffer(b"".join(b.column("samples").to_pylist()), "<u2").reshape(b.num_rows, -1))
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            held = tuple(x[cut:] for x in now)
            for a, z in found(*(x[:cut] for x in now)) if cut else ():
                yield common.batch(a=a, b=z)
        for a, z in found(*held) if held is not None else ():
            yield common.batch(a=a, b=z)

    dealt = met.select("key", "nid", "samples").repartition("key").sortWithinPartitions("key", "nid")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _links(dealt: DataFrame, idf: np.ndarray, threshold: float, windows: bool = False) -> DataFrame:
    """dealt (unit, nid, text), sorted by unit -> (a, b): stars of the classes in each unit, or in each of its windows of up
    to WINDOW texts or WINDOW_BYTES."""

    def stars(windows):
        raw = [x for w in windows for x in w[1]]
        key, weight, count, at = shingles(raw, idf)
        upto, out = 0, []
        for nids, own in windows:
            ids, i = np.asarray(nids, np.int64), at[upto : upto + len(own) + 1]
            upto += len(own)
            if len(ids) == 2:
                one, two = ((key[a:z], weight[a:z].astype(np.float64) * count[a:z]) for a, z in zip(i, i[1:], strict=False))
                label = np.array([0, 0]) if similarity(one, two) >= threshold - ROUNDING else np.array([0, 1])
            else:
                a, z = i[0], i[-1]
                label = classes_of(similarities(key[a:z], weight[a:z], count[a:z], i - a) >= threshold - ROUNDING)
            own = label != np.arange(len(ids))
            out.append((ids[label[own]], ids[own]))
        return common.batch(a=np.concatenate([x[0] for x in out]), b=np.concatenate([x[1] for x in out]))

    def compare(batches):
        unit, nids, raw, size, ready, waiting = None, [], [], 0, [], 0
        for b in common.text_slices(batches, CHUNK):
            for u, i, t in zip(b.column("unit").to_pylist(), b.column("nid").to_pylist(), common.raw_texts(b), strict=True):
                full = windows and (len(nids) >= WINDOW or size + len(t) > WINDOW_BYTES and len(nids) > 1)
                if nids and (u != unit or full):
                    if len(nids) > 1:
                        ready.append((nids, raw))
                        waiting += size
                    nids, raw, size = [], [], 0
                    if waiting >= CHUNK:
                        yield stars(ready)
                        ready, waiting = [], 0
                unit, size = u, size + len(t)
                nids.append(i)
                raw.append(t)
        if len(nids) > 1:
            ready.append((nids, raw))
        if ready:
            yield stars(ready)

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) -> (node, root): root is the component's smallest node. Each round hooks every node's root to the smallest
    root among its neighbours and halves the paths; rounds are few, as the edges are stars around leaders."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.written(both, name)
    state = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), name)
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        # The smallest root seen from anywhere in the component is passed on to the old root, too.
        seen = state.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "m").alias("m"))
        hooks = seen.groupBy("root").agg(F.min("m").alias("h"))
        moved = seen.join(hooks, "root").select("node", F.least("m", "h").alias("new"), "root")
        up = moved.select(F.col("node").alias("n2"), F.col("new").alias("up"))
        after = moved.join(up, F.col("new") == F.col("n2"), "left").select("node", F.least(F.coalesce("up", "new"), "new").alias("root"), F.col("root").alias("was"))
        after = common.written(after, name)
        changed = after.filter("root <> was").limit(1).count()
        common.forget(state)
        state = after.drop("was")
        if not changed:
            return state


def _sizes(groups: DataFrame, exact: bool) -> DataFrame:
    """groups (root, n_bytes of a text) -> root, size, blocks: 1 where a group meets whole, the blocks it is dealt into, or
    0 where it goes by passes."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    half, half_bytes = WINDOW // 2, WINDOW_BYTES // 2
    dealt = F.greatest(F.lit(2), F.ceil(F.col("n") / half), F.ceil(F.col("size") / half_bytes)).cast("int")
    in_blocks = F.lit(exact) | (F.col("n") <= WINDOW) | (dealt <= PASSES + 1)
    whole = (F.col("n") <= WINDOW) & (F.col("size") <= WINDOW_BYTES)
    return sizes.select("root", "size", F.when(whole, 1).when(in_blocks, dealt).otherwise(0).alias("blocks"))


def _pairs_of_blocks(texts: DataFrame) -> DataFrame:
    """texts (root, blocks, nid, text) -> (unit, nid, text): a unit for each pair of a group's blocks."""
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    other = F.explode(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))).alias("other")
    met = texts.withColumn("own", own).select("root", "own", other, "nid", "text")
    return met.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "nid", "text")


def _classes_of_texts(docs: DataFrame, idf: np.ndarray, threshold: float, exact: bool) -> DataFrame | None:
    """docs (h1, h2, text) -> (h1, h2, r1, r2) of the texts that have a near copy: their and their class's hashes; None if
    none has."""
    signed = _signed(docs, idf).groupBy("h1", "h2").agg(F.max("samples").alias("samples"), F.max("n_bytes").alias("n_bytes"))
    known = common.written(signed.select(F.monotonically_increasing_id().alias("nid"), "h1", "h2", "n_bytes", "samples"), "near-samples")
    own = lambda i: F.substring("samples", 2 * ROWS * i + 1, 2 * ROWS)
    bands = known.select("nid", F.posexplode(F.array(*[own(i) for i in range(BANDS)])).alias("band", "piece")).select(F.xxhash64("piece", "band").alias("key"), "nid")
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("least")).filter("n > 1")
    met = common.written(bands.join(shared, "key"), "near-buckets")
    whole = met.filter((F.col("n") > BUCKET) & (F.col("nid") != F.col("least"))).select(F.col("least").alias("a"), F.col("nid").alias("b"))
    joins = _joins(met.filter(F.col("n") <= BUCKET).join(known.select("nid", "samples"), "nid"))
    groups = components(joins.unionByName(whole), "near-groups")
    sizes = common.written(_sizes(groups.join(known.select(F.col("nid").alias("node"), "n_bytes"), "node"), exact), "near-sizes")
    by_passes, by_blocks = F.when(F.col("blocks") == 0, F.col("size")), F.when(F.col("blocks") > 1, F.col("size") * (F.col("blocks") - 1))
    total = sizes.agg(F.count("*"), F.sum(by_passes), F.sum(by_blocks)).first()
    if not total[0]:
        return None
    hashed = known.select(F.col("nid").alias("node"), "h1", "h2", "samples")
    members = groups.join(sizes.select("root", "blocks"), "root").join(hashed, "node").select("h1", "h2", F.col("node").alias("nid"), "root", "blocks", F.when(F.col("blocks") == 0, F.col("samples")).alias("samples"))
    members = common.written(members, "near-members")
    # Only texts of a group shuffle, equal ones once from each task.
    some = exact_dedup.only_among(docs, "h1", members.select(F.col("h1").alias("h")), "near-bitmaps").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = common.written(some.join(members, ["h1", "h2"]).select("nid", "root", "blocks", "samples", "text"), "near-texts")
    small = texts.filter("blocks = 1").select(F.col("root").alias("unit"), "nid", "text").repartition("unit").sortWithinPartitions("unit", "nid")
    found = common.written(_links(small, idf, threshold).select(F.col("b").alias("node"), F.col("a").alias("root")), "near-classes")
    wide = []
    if total[2]:
        pairs = _pairs_of_blocks(texts.filter("blocks > 1")).repartition(total[2] // (8 * WINDOW_BYTES) + 1, "unit")
        wide.append(common.written(_links(pairs.sortWithinPartitions("unit", "nid"), idf, threshold), "near-links"))
    if total[1]:
        place = lambda p: F.concat(F.expr(f"substring(samples, {2 * ROWS * p + 1})"), F.substring("samples", 1, 2 * ROWS * p))
        passes = F.posexplode(F.array(*[place(p) for p in range(PASSES)])).alias("pass", "place")
        placed = texts.filter("blocks = 0").select("root", passes, "nid", "text")
        order = ["root", "pass", "place", "nid"]
        dealt = placed.repartitionByRange(total[1] * PASSES // (2 * WINDOW_BYTES) + 1, *order).sortWithinPartitions(*order)
        wide.append(common.written(_links(dealt.select(F.xxhash64("root", "pass").alias("unit"), "nid", "text"), idf, threshold, True), "near-links"))
    if wide:
        found = found.unionByName(components(reduce(DataFrame.unionByName, wide), "near-classes").filter("node <> root"))
    of = known.select(F.col("nid").alias("root"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    return found.join(hashed.drop("samples"), "node").join(of, "root").select("h1", "h2", "r1", "r2")


def _hashes(text) -> tuple:
    """Two independent hashes of a text."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, kept (one row of each class), h1 and h2 (the text's
    hashes). Every pair of every group is compared, however large the group is; without exact, larger groups go by passes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.written(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), *_hashes(text)), "near-rows")
    texts = docs.select(*_hashes(text), text.alias("text"))
    state = _classes_of_texts(texts, document_frequencies(texts), threshold, exact)
    if state is None:
        of_rows = rows.withColumns({"r1": F.col("h1"), "r2": F.col("h2")})
    else:
        of_rows = rows.join(state, ["h1", "h2"], "left").withColumns({"r1": F.coalesce("r1", "h1"), "r2": F.coalesce("r2", "h2")})
    of_rows = common.written(of_rows.select("doc_id", "row_no", "h1", "h2", "r1", "r2"), "near-roots")
    firsts = of_rows.groupBy("r1", "r2").agg(F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNotNull().alias("filled"), "doc_id", "row_no")).alias("f"))
    firsts = common.written(firsts, "near-firsts")
    return of_rows.join(firsts, ["r1", "r2"]).select("doc_id", F.col("f.doc_id").alias("class_id"), "class_size", (F.col("row_no") == F.col("f.row_no")).alias("kept"), "h1", "h2")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns. Rows that are alone in their class don't shuffle."""
    found = common.written(classes(docs, id_col, text_col, threshold), "near-rows-of-classes")
    h1, h2, some = (common.fresh(docs, x) for x in ("h1", "h2", "some"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({h1: _hashes(text)[0], h2: _hashes(text)[1]})
    flagged = exact_dedup.flagged_among(rows, h1, found.filter("class_size > 1").select(F.col("h1").alias("h")), some, "near-bitmaps")
    s1, s2, s_id = (common.fresh(rows, x) for x in ("stay1", "stay2", "stay_id"))
    stay = found.filter("kept").select(F.col("h1").alias(s1), F.col("h2").alias(s2), F.col("doc_id").alias(s_id))
    # Rows with equal id and text lie together after the join; one of them stays.
    same = (F.col(h1) == F.col(s1)) & (F.col(h2) == F.col(s2)) & F.col(id_col).eqNullSafe(F.col(s_id))
    held = flagged.filter(F.col(some)).join(stay, same, "left_semi").dropDuplicates([h1, h2, id_col])
    return flagged.filter(~F.col(some)).unionByName(held).select(*docs.columns)


def op9_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir)).drop("h1", "h2")
