"""Removal of long repeated byte strings with run-length suffix indexes.

A string of LENGTH bytes that starts at two places or more of the corpus is removed at all of them. No index of the
whole corpus could be built or held anywhere, so the corpus is first cut so that equal strings meet:

1. Every LENGTH-byte window has an anchor, the smallest hash of its GRAM-byte substrings. Runs of windows with one anchor
   are a context, so each window lies in exactly one context, and equal windows have equal anchors. Anchors that a Bloom
   filter (built from counts over all anchors) shows to be alone are dropped: about 1 % of the text's length in rows takes
   part, whatever the text. Where one filter would be too large, hashes are cut into ranges with a filter each.
2. Equal contexts (by the anchor and a 64-bit hash of their bytes) are put together with their number; one of each is fetched from
   its document. Equal texts, by two hashes, are one document with its number from here on, however often they occur.
3. Contexts are dealt by anchor to indexes of about INDEX_BYTES. An index is the run-length Burrows-Wheeler transform of
   its contexts, with the suffix-array samples at run ends and the common-prefix length across each run boundary. These
   samples are enough to stream matching statistics over the contexts: within a run, the match of the next position is
   the last one less 1, so the length of the longest match elsewhere follows from the last sample before each position
   (on both sides, in suffix order). Contexts that occur several times match themselves.
4. Windows with a match of LENGTH are marked, and the marks go back to all documents that have the context.

Defined results. Null and empty texts have 0 bytes and no spans. Texts shorter than LENGTH keep all. Rows that repeat a
doc_id, and rows equal in all columns, are documents of their own (equal rows of LENGTH bytes and more lose everything
they share). An empty table gives an empty table. Extra columns are ignored.

A very common short string (GRAM bytes and more) between ever different neighbours is one anchor with as many contexts as
it has occurrences. Where the contexts of a key exceed an index, their windows get finer keys: the set of the DEPTHS[0]
smallest different hashes of the window's substrings, then DEPTHS[1], and so on up to all of them. Equal windows have equal
keys at every depth, so they still meet; runs of windows of one key are cut out, those whose key is alone are dropped,
and equal ones are put together with their number as above. What stays beyond an index after that is windows with exactly
the same substrings: periodic text of very many different lengths.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exact_dedup, spans

LENGTH = 200
GRAM = 40
INDEX_BYTES = 1 << 18
#: Bits for each anchor in the filter, and in one filter at most (128 MB); more anchors are filtered in ranges of their hash.
ANCHOR_BITS, FILTER_BITS = 8, 1 << 30
CHUNK = 1 << 20
#: How many of a window's smallest hashes are its key, where contexts of one key exceed an index. The last is all of them.
DEPTHS = (4, 16, 64, 1 << 30)
WINDOW_ROWS = 2048


def contexts(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, windows, again) of each context of one text of length bytes and more. again:
    the anchor is the smallest at two places of the text, so that the context may repeat a window of its own."""
    sums = spans.prefix(text)
    h = spans.hashes(sums, np.arange(len(text) - gram + 1), np.arange(gram, len(text) + 1))
    w = length - gram + 1
    least = _sliding(np.minimum, h, w)
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    places = np.sort(h[_sliding(np.maximum, around, w) == h])  # a place is some window's smallest
    twice = np.unique(places[1:][places[1:] == places[:-1]])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(np.append(first, len(least)))
    return least[first], _digests(text, first, n - 1 + length), first, n, np.isin(least[first], twice)


def _digests(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw = memoryview(text)
    return np.array([xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)], np.uint64)


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f (a minimum or maximum) over each run of w: from running ones in both directions of blocks of w."""
    blocks = np.append(x, np.full(-len(x) % w, x[-1])).reshape(-1, w)
    up = f.accumulate(blocks, axis=1).ravel()
    down = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(down[: len(x) - w + 1], up[w - 1 : len(x)])


# --- the index -------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffixes of all strings of text (string k is text[bounds[k]:bounds[k+1]]), each ending with its string; equal
    ones in the order of their strings. Prefix tripling: ranks by 8 bytes, then 24, 72, ... for those still tied."""
    n = len(text)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    left = ends - np.arange(n)
    key = np.ndarray((n,), ">u8", text.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    near = np.flatnonzero(left < 8)  # nothing of the next string
    key[near] &= ~np.uint64(0) << (np.uint64(64) - 8 * left[near].astype(np.uint64))
    # A string's end sorts before any byte; a NUL byte in a text must not look like one.
    short = np.minimum(left, 8).astype(np.uint64)
    order = np.argsort(key)
    new = key[order[1:]] != key[order[:-1]]
    if (text == 0).any():
        order = np.lexsort((short, key))
        new = (key[order[1:]] != key[order[:-1]]) | (short[order[1:]] != short[order[:-1]])
    else:
        new |= (left[order[1:]] < 8) & (left[order[:-1]] != left[order[1:]])
    rank = np.empty(n, np.int64)
    # Ranks are 1 + the place of the group's first suffix, so they stay in order while groups are split.
    firsts = np.flatnonzero(np.append(True, new))
    sizes = np.diff(np.append(firsts, n))
    rank[order] = np.repeat(firsts, sizes) + 1
    bits, h = np.uint64(max(1, int(n + 1).bit_length())), 8
    three = 3 * int(bits) <= 63
    tied = order[np.repeat(sizes > 1, sizes)]
    while len(tied):
        tied = tied[left[tied] > h]  # those that end within h bytes are equal to their whole group
        if not len(tied):
            break
        at = lambda d: np.where(left[tied] > d, rank[np.minimum(tied + d, n - 1)], 0).astype(np.uint64)
        key = rank[tied].astype(np.uint64) << bits | at(h)
        if three:
            key = key << bits | at(2 * h)
        own = np.argsort(key)
        tied, key = tied[own], key[own]
        group = rank[tied]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        g_first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        g_size = np.diff(np.append(g_first, len(group)))
        # Members that ended stand before the others of their group: they keep its first places.
        gone = np.bincount(rank, minlength=n + 2)[group[g_first]] - g_size
        start = np.repeat(group[g_first] + gone, g_size) + np.arange(len(group)) - np.repeat(g_first, g_size)
        rank[tied] = np.repeat(start[first], size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 3 if three else 2
    return np.argsort(rank * n + np.arange(n))  # equal suffixes by place


def common_prefixes(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, by hashes of doubling, then halving, length."""
    sums, most = spans.prefix(text), np.minimum(left[a], left[b])
    same = lambda x, y, k: spans.hashes(sums, x, x + k) == spans.hashes(sums, y, y + k)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    step = 8
    steps = []
    while len(live):  # grow
        steps.append(step)
        can = out[live] + step <= most[live]
        live = live[can]
        x, y = a[live] + out[live], b[live] + out[live]
        hit = same(x, y, np.full(len(live), step))
        live = live[hit]
        out[live] += step
        step *= 2
    for step in [2**k for k in reversed(range(max(1, steps[-1].bit_length())))] if steps else []:
        live = np.flatnonzero(out + step <= most)
        hit = same(a[live] + out[live], b[live] + out[live], np.full(len(live), step))
        out[live[hit]] += step
    return out


class RunIndex:
    """Run-length BWT of strings: where runs begin, the suffix-array samples on both sides of each run boundary, and the
    common-prefix length across it."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray):
        n = len(text)
        self.n, self.left = n, np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
        sa = suffix_array(text, bounds)
        before = np.append(np.uint8(0), text[:-1]).astype(np.int16)
        before[bounds[:-1][np.diff(bounds) > 0]] = -1  # the symbol before a string is like no other
        bwt = before[sa]
        self.starts = np.flatnonzero(np.append(True, (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0))) if n else np.zeros(0, np.int64)
        self.symbols = bwt[self.starts]
        self.heads, self.tails = sa[self.starts], sa[np.append(self.starts[1:], n) - 1] if n else sa
        self.across = common_prefixes(text, self.left, self.tails[:-1], self.heads[1:])

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text, the length of its longest match that starts elsewhere in the text."""
        best, every = np.zeros(self.n, np.int64), np.arange(self.n)
        if not self.n:
            return best
        # The first suffix of all has none before it, the last none after it: they match nothing on that side.
        before = (self.heads, np.append(0, self.across))
        after = (self.tails, np.append(self.across, 0))
        for places, lengths in (before, after):
            sample, last = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
            sample[places], last[places] = lengths, places
            last = np.maximum.accumulate(last)  # every string begins with a sample, so nothing streams across strings
            best = np.maximum(best, sample[last] - (every - last))
        return np.minimum(best, self.left)


def repeated_windows(strings: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the windows [first, end), as flat pairs, that occur twice or more, strings counted as often as
    they occur."""
    text, bounds = spans.joined(strings)
    index = RunIndex(text, bounds)
    match = index.matching_statistics()
    match = np.maximum(match, np.where(np.repeat(counts, np.diff(bounds)) > 1, index.left, 0))
    hit = np.append((match >= length).astype(np.int8), np.int8(0))
    edge = np.flatnonzero(np.diff(hit, prepend=np.int8(0)))
    string = np.searchsorted(bounds, edge[::2], side="right") - 1
    firsts, ends = edge[::2] - bounds[string], edge[1::2] - bounds[string]
    cut = np.searchsorted(string, np.arange(len(strings) + 1))
    # A hit stops LENGTH - 1 before its string's end at the latest, so no pair crosses strings.
    return [np.stack([firsts[a:z], ends[a:z]], axis=1).ravel() for a, z in zip(cut, cut[1:], strict=False)]


# --- the job ---------------------------------------------------------------------------------------------------------


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    names, kinds = ("h", "content", "t1", "t2", "s", "n", "again"), "h bigint, content bigint, t1 bigint, t2 bigint, s bigint, n bigint, again boolean"

    def cut(batches):
        for b in common.text_slices(batches, CHUNK):
            out = []
            for t1, t2, raw in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), common.raw_texts(b), strict=True):
                if len(raw) >= length:
                    h, content, first, n, again = contexts(np.frombuffer(raw, np.uint8), length, gram)
                    out.append((h.astype(np.int64), content.astype(np.int64), np.full(len(h), t1), np.full(len(h), t2), first, n, again))
            if out:
                yield common.batch(**{k: np.concatenate(x) for k, x in zip(names, zip(*out, strict=True), strict=True)})

    return docs.select("t1", "t2", "text").mapInArrow(cut, kinds)


def finer(raw: bytes, depth: int, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """(key, content hash, first window, windows, again) of each run of windows of raw with one key, which is a hash of the
    set of the depth smallest different hashes of the window's substrings. again: the run may repeat a window of its own."""
    text = np.frombuffer(raw, np.uint8)
    sums = spans.prefix(text)
    h = spans.hashes(sums, np.arange(len(text) - gram + 1), np.arange(gram, len(text) + 1))
    n = len(text) - length + 1
    every = np.lib.stride_tricks.sliding_window_view(h, length - gram + 1)
    key = np.empty(n, np.uint64)
    for a in range(0, n, WINDOW_ROWS):
        x = np.sort(every[a : a + WINDOW_ROWS], axis=1)
        new = np.ones(x.shape, bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]
        new &= np.cumsum(new, axis=1) <= depth
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        key[a : a + WINDOW_ROWS] = np.where(new, x, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.append(first, n))
    whole = spans.hashes(sums, np.arange(n), np.arange(length, len(text) + 1))
    _, at, times = np.unique(whole, return_inverse=True, return_counts=True)
    again = np.logical_or.reduceat(times[at] > 1, first)
    content = _digests(text, first, size - 1 + length)
    return list(zip(key[first].astype(np.int64).tolist(), content.astype(np.int64).tolist(), first.tolist(), size.tolist(), again.tolist(), strict=True))


def _alive(groups: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """groups (h, content, k, again, at) -> h and heavy of keys that may hold a repeated window. heavy: beyond an index."""
    size = F.sum(F.col("at.n") + (length - 1)) > index_bytes
    return groups.groupBy("h").agg(F.sum("k").alias("k"), F.max("again").alias("again"), size.alias("heavy")).filter("k > 1 or again").select("h", "heavy")


def _indexed(fetched: DataFrame, depths: tuple[int, ...], length: int, gram: int, index_bytes: int) -> DataFrame:
    """fetched (h, content, k, heavy, bytes), as written -> h, content, runs; a context may have several rows."""
    n_bytes, heavy = F.octet_length("bytes"), F.col("heavy") & F.lit(bool(depths))
    size, deep = fetched.agg(F.sum(F.when(~heavy, n_bytes)), F.sum(F.when(heavy, n_bytes))).first()
    dealt = fetched.filter(~heavy).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(max(1, (size or 0) // index_bytes + 1))))

    def index(b):
        b = b.drop_duplicates(["h", "content"])
        runs = repeated_windows(b["bytes"].tolist(), b["k"].to_numpy(), length)
        out = [(h, c, r.tolist()) for h, c, r in zip(b["h"], b["content"], runs, strict=True) if len(r)]
        return pd.DataFrame(out, columns=["h", "content", "runs"])

    found = dealt.select("part", "h", "content", "k", "bytes").groupBy("part").applyInPandas(index, "h bigint, content bigint, runs array<bigint>")
    if not deep:
        return common.written(found, "suffix-marks")
    return common.written(found, "suffix-marks").unionByName(_rekeyed(fetched.filter(heavy), depths, length, gram, index_bytes))


def _rekeyed(fetched: DataFrame, depths: tuple[int, ...], length: int, gram: int, index_bytes: int) -> DataFrame:
    """The marks of contexts by finer keys of their windows."""
    # Equal rows of the corpus hold a context once each.
    rows = common.written(fetched.dropDuplicates(["h", "content"]).select("h", "content", "k", "bytes"), "suffix-heavy")

    def cut(batches):
        for b in batches:
            out = [(h, c, k, *x) for h, c, k, raw in zip(b["h"], b["content"], b["k"], b["bytes"], strict=True) for x in finer(raw, depths[0], length, gram)]
            yield pd.DataFrame(out, columns=["h0", "content0", "k", "h", "content", "s", "n", "again"])

    pieces = rows.mapInPandas(cut, "h0 bigint, content0 bigint, k bigint, h bigint, content bigint, s bigint, n bigint, again boolean")
    pieces = common.written(pieces, "suffix-pieces")
    groups = pieces.groupBy("h", "content").agg(F.sum("k").alias("k"), F.max("again").alias("again"), F.min(F.struct("h0", "content0", "s", "n")).alias("at"))
    groups = common.written(groups, "suffix-piece-groups")
    shown = groups.join(_alive(groups, length, index_bytes), "h").select("h", "content", "k", "heavy", "at.*")
    own = rows.select(F.col("h").alias("h0"), F.col("content").alias("content0"), "bytes")
    part = F.col("bytes").substr(F.col("s").cast("int") + 1, F.col("n").cast("int") + F.lit(length - 1))
    again = common.written(shown.join(own, ["h0", "content0"]).select("h", "content", "k", "heavy", part.alias("bytes")), "suffix-contexts")
    found = _indexed(again, depths[1:], length, gram, index_bytes)
    common.forget(again)
    moved = F.transform(F.col("runs"), lambda x: x + F.col("s"))
    back = pieces.join(found, ["h", "content"]).select(F.col("h0").alias("h"), F.col("content0").alias("content"), moved.alias("runs"))
    return common.written(back, "suffix-marks")


def _candidates(docs: DataFrame, length: int, gram: int, filter_bits: int) -> DataFrame:
    """The contexts (as _anchors() gives them) whose anchor perhaps comes twice."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ANCHOR_BITS * 2 * size // (length - gram + 2) // filter_bits + 1  # two anchors a window's length, about
    anchors = _anchors(docs, length, gram)
    if ranges > 1:
        anchors = anchors.withColumn("in_range", F.pmod(F.xxhash64("h", F.lit(11)), F.lit(ranges)))
    anchors, out = common.written(anchors, "suffix-anchors", ["in_range"] if ranges > 1 else []), None
    for k in range(ranges):
        own = anchors.filter(F.col("in_range") == k).drop("in_range") if ranges > 1 else anchors
        bits = exact_dedup.filter_bits(own.count(), ANCHOR_BITS, filter_bits)
        bitmaps = common.written(exact_dedup.repeated_slots(own.select("h"), bits, 2), "suffix-bitmaps")
        some = exact_dedup.possibly_repeated(own, "h", bitmaps, bits, 2, "maybe").filter("maybe or again").drop("maybe")
        # A place of one text is one row, however many rows have the text.
        some = some.groupBy("h", "content", "t1", "t2", "s").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("again").alias("again"))
        some = common.written(some, "suffix-candidates")
        out = some if out is None else out.unionByName(some)
    common.forget(anchors)
    return out


#: Contexts that a fetching task remembers to have fetched.
FETCHED = 1 << 20


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs (t1, t2, text) -> t1, t2, runs: an array of (first window, end) of windows that repeat. t1, t2: the text's hashes."""
    some = _candidates(docs, length, gram, filter_bits)
    groups = some.groupBy("h", "content").agg(F.sum("k").alias("k"), F.max("again").alias("again"), F.min(F.struct("t1", "t2", "s", "n")).alias("at"))
    groups = common.written(groups, "suffix-groups")
    shown = groups.join(_alive(groups, length, index_bytes), "h").select("h", "content", "k", "heavy", "at.*")
    wanted = shown.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "content", "k", "heavy", "s", "n")).alias("wanted"))
    wanted = common.written(wanted, "suffix-wanted")
    having = exact_dedup.only_among(docs, "t1", wanted.select(F.col("t1").alias("h")), "suffix-bitmaps")
    once = having.join(wanted, ["t1", "t2"]).select("text", "wanted")

    def fetch(batches):
        seen: set[tuple[int, int]] = set()
        for b in common.text_slices(batches, CHUNK):
            out = []
            for raw, w in zip(common.raw_texts(b), b.column("wanted").to_pylist(), strict=True):
                if (w[0]["h"], w[0]["content"]) not in seen:  # an equal text was here
                    seen.add((w[0]["h"], w[0]["content"]))
                    out += [(x["h"], x["content"], x["k"], x["heavy"], raw[x["s"] : x["s"] + x["n"] - 1 + length]) for x in w]
            if len(seen) > FETCHED:
                seen.clear()
            if out:
                h, content, k, heavy, raw = zip(*out, strict=True)
                yield common.batch(h=h, content=content, k=k, heavy=heavy, bytes=raw)

    fetched = common.written(once.mapInArrow(fetch, "h bigint, content bigint, k bigint, heavy boolean, bytes binary"), "suffix-contexts")
    found = _indexed(fetched, DEPTHS, length, gram, index_bytes)
    common.forget(fetched)
    moved = F.transform(F.col("runs"), lambda x: x + F.col("s"))
    back = some.join(found, ["h", "content"]).select("t1", "t2", moved.alias("runs"))
    return common.written(back.groupBy("t1", "t2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "suffix-runs")


def _removed(n: int, runs, length: int) -> np.ndarray:
    """Which bytes go."""
    cover = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        r = np.asarray(runs, np.int64)
        np.add.at(cover, r[::2], 1)
        np.add.at(cover, r[1::2] - 1 + length, -1)
    return np.cumsum(cover)[:n] > 0


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    found = marks(rows.drop("doc_id"), length, gram, index_bytes, filter_bits)
    # Only texts that lose something shuffle.
    flagged = exact_dedup.flagged_among(rows, "t1", found.select(F.col("t1").alias("h")), "marked", "suffix-bitmaps")
    whole = flagged.filter("not marked").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("runs"))
    joined = flagged.filter("marked").join(found, ["t1", "t2"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        for b in common.text_slices(batches, CHUNK):
            out = []
            for raw, r in zip(common.raw_texts(b), b.column("runs").to_pylist(), strict=True):
                gone = _removed(len(raw), r, length)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), kept, hashlib.sha256(kept).hexdigest()))
            n, removed, runs, kept, sha = zip(*out, strict=True)
            yield common.batch(doc_id=b.column("doc_id"), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept=pa.array(kept, pa.binary()), kept_sha256=sha)

    return whole.unionByName(joined).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def op2_run_index_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(common.documents(spark, sf_dir)).drop("kept")
