"""Runs: maximal periodic stretches of words, found through longest previous factors.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least
max(MIN_LENGTH, 2 q) words, that no neighbouring word extends. Texts are independent, so nothing is shuffled: a task
works on slices of some CHUNK_BYTES of texts (or one longer text).

1. Words become integers. In a run of L words the L - q >= L / 2 words at either end are the same, and together they
   cover it, so each of its words lies in a gram of MIN_LENGTH / 2 words that its text has elsewhere too. Other words are
   left out; the stretches that remain are put end to end with a separator of its own after each.
2. Prefix doubling gives the suffix array. The ranks of every doubling are kept: two places have the same 2^k words where
   their k-th ranks are equal, so common prefixes and suffixes of any two places, and the LCP array, take a comparison
   for each k.
3. Suffix array and LCP give the longest-previous-factor array: places are unlinked from the suffix order, last first,
   and the neighbours that remain lie before them. Steps of that length are the LZ blocks.
4. A run that ends in a block and starts before it, or touches its ends, is found at the block's boundary from how far each period
   extends to both sides (Main); periods beyond the two blocks' lengths can't occur there.
5. A run inside a block is the copy of one in the block's earlier occurrence. Runs lie in buckets by their start; going
   through the blocks from left to right, those strictly inside the earlier occurrence are copied.

A run that is found with a multiple of its period has the same ends, so the smallest period of equal ends stays.

Defined results. Null and empty texts have no words and no runs. Rows are independent: repeated rows repeat. A null id
stays null. Extra columns are ignored. Memory: some 4 log2(n) bytes for each word that step 1 leaves of one slice.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

MIN_LENGTH = 12
CHUNK_BYTES = 2 << 20


def repeated_stretches(ids: np.ndarray, texts: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches of words covered by grams that their text (texts: its number for each word) has twice."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    key = texts[:n].astype(np.uint64)
    for j in range(gram):
        key = spans.mix(key + ids[j : j + n].astype(np.uint64) * np.uint64(2 * j + 1))
    inside = texts[:n] == texts[gram - 1 :]
    key, at = key[inside], np.flatnonzero(inside)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)  # two grams of one hash only cover more
    step[at[twice]] += 1
    step[at[twice] + gram] -= 1
    covered = np.cumsum(step[:-1]) > 0
    edge = covered.copy()
    edge[1:] &= ~(covered[:-1] & (texts[1:] == texts[:-1]))
    first = np.flatnonzero(edge)
    out = covered.copy()
    out[:-1] &= ~(covered[1:] & (texts[1:] == texts[:-1]))
    return list(zip(first.tolist(), (np.flatnonzero(out) + 1).tolist(), strict=True))


class Suffixes:
    """Suffix array of a row of integers, whose last one occurs once, and the ranks of all doublings."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        self.array = order
        self.ranks = [self._ranked(order, s[order], np.arange(n), np.empty(n, np.int32))]
        slots = self._open(np.arange(n))
        while len(slots):
            rank, step = self.ranks[-1], 1 << len(self.ranks) - 1
            own = self.array[slots]
            # What is still open repeats, so the 2^k words there end before a separator: own + step exists.
            key = rank[own].astype(np.int64) * n + rank[own + step]
            order = np.argsort(key, kind="stable")
            self.array[slots] = own[order]
            self.ranks.append(self._ranked(own[order], key[order], slots, rank.copy()))
            slots = slots[self._open(slots)]
        self.n = n

    @staticmethod
    def _ranked(places: np.ndarray, keys: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """A place's rank is the first slot of those that are equal so far."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        return rank

    def _open(self, slots: np.ndarray) -> np.ndarray:
        """Which of slots share their rank with a neighbour."""
        r = self.ranks[-1][self.array[slots]]
        same = np.zeros(len(r) + 1, bool)
        same[1:-1] = r[1:] == r[:-1]
        return np.flatnonzero(same[1:] | same[:-1])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j (i != j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            move = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += move
            j += move
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common suffix of what ends before i and before j (i > j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            room = j >= 1 << k
            back = np.maximum(j - (1 << k), 0)
            move = (room & (self.ranks[k][i - (1 << k) * room] == self.ranks[k][back])).astype(np.int64) << k
            i -= move
            j -= move
        return begin - i


def previous_factors(sa: Suffixes) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor there that also starts before, and where."""
    n = sa.n
    array = sa.array.tolist()
    lcp = [0, *sa.ahead(sa.array[:-1], sa.array[1:]).tolist(), 0]  # of slot r and the one before it
    slot = np.empty(n, np.int64)
    slot[sa.array] = np.arange(n)
    up, down = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [0] * n
    for i, r in zip(range(n - 1, -1, -1), slot[::-1].tolist(), strict=True):
        a, z = up[r], down[r]
        before, after = lcp[r], lcp[z]
        if before >= after:
            length[i], source[i] = before, array[a] if before else 0
            lcp[z] = after
        else:
            length[i], source[i] = after, array[z]
            lcp[z] = before
        down[a] = z  # for a = -1 this is the spare last element
        up[z] = a
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Where the LZ blocks begin, and the end."""
    out, i = [], 0
    while i < len(length):
        out.append(i)
        i += length[i] or 1
    return [*out, len(length)]


def boundary_runs(sa: Suffixes, begins: np.ndarray, shortest: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the runs that reach a boundary between blocks and end by the second one's end."""
    size = np.diff(begins)
    b, a, c = begins[1:-1], size[:-1], size[1:]
    out: dict[tuple[int, int], int] = {}
    for other, most in ((1, np.minimum(c, sa.n - 1 - b)), (-1, np.minimum(a + c, b))):
        # Periods from 1 to most, with the second place `other` periods from the boundary.
        ends = np.cumsum(most)
        at = np.repeat(b, most)
        p = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - most, most) + 1
        two = sa.ranks[min(1, len(sa.ranks) - 1)]
        # L - p >= 3 words are the same, so two are on one side of the boundary.
        low, high = (at, at + p) if other > 0 else (at - p, at)
        likely = (two[low] == two[high]) | ((low >= 2) & (two[low - 2 * (low >= 2)] == two[high - 2 * (low >= 2)]))
        low, high, p = low[likely], high[likely], p[likely]
        right, left = sa.ahead(low, high), sa.behind(high, low)
        good = (left + right >= p) & (p + left + right >= shortest)
        starts, stops = (low - left)[good].tolist(), (high + right)[good].tolist()
        for s, e, q in zip(starts, stops, p[good].tolist(), strict=True):
            if q < out.get((s, e), q + 1):
                out[s, e] = q
    return out


def runs(s: np.ndarray, shortest: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a row of integers whose last one occurs once, in order."""
    sa = Suffixes(s)
    length, source = previous_factors(sa)
    begins = blocks(length)
    found = boundary_runs(sa, np.asarray(begins), shortest)
    buckets: dict[int, dict[int, int]] = {}
    for (a, e), p in found.items():
        buckets.setdefault(a, {})[e] = p
    for b, e in pairwise(begins):
        if length[b] > shortest:
            d = b - source[b]
            for a in range(b + 1 - d, e - d - shortest):
                for z, p in list(buckets.get(a, {}).items()):
                    if z < e - d:
                        own = buckets.setdefault(a + d, {})
                        own[z + d] = min(p, own.get(z + d, p))
    return sorted((a, e, p) for a, own in buckets.items() for e, p in own.items())


def runs_of_texts(words: list[list[bytes]], shortest: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, period) of each text, in order."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for own in words for w in own], np.int64)
    sizes = np.array([len(own) for own in words], np.int64)
    texts, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    parts = [(a, z) for a, z in repeated_stretches(ids, texts, max(1, shortest // 2)) if z - a >= shortest]
    if not parts:
        return out
    joined = np.concatenate([np.append(ids[a:z], len(known) + i) for i, (a, z) in enumerate(parts)])
    at = np.cumsum([0, *(z - a + 1 for a, z in parts)])
    found = np.array(runs(joined, shortest), np.int64).reshape(-1, 3)
    part = np.searchsorted(at, found[:, 0], side="right") - 1
    begin = np.array([a for a, _ in parts], np.int64)
    text = texts[begin]
    shift = (begin - first[text] - at[:-1])[part]
    for t, a, e, p in zip(text[part].tolist(), (found[:, 0] + shift).tolist(), (found[:, 1] + shift).tolist(), found[:, 2].tolist(), strict=True):
        out[t].append((a, e, p))
    return out


def collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if own:
        gone = np.zeros(len(words) + 1, np.int64)
        for a, e, p in own:
            gone[a + p] += 1
            gone[e] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_LENGTH) -> DataFrame:
    """doc_id, runs (array of start, length and period, in words, by start and period) and text (without what runs repeat)."""
    if shortest < 5:
        raise ValueError("runs of fewer than five words aren't looked for")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in common.text_slices(batches, CHUNK_BYTES):
            words = [x.split() for x in common.raw_texts(b)]  # bytes are split at ASCII white space
            found = runs_of_texts(words, shortest)
            kept = pa.array([collapsed(w, own) for w, own in zip(words, found, strict=True)], pa.binary())
            flat = [(a, e - a, p) for own in found for a, e, p in sorted(own, key=lambda r: (r[0], r[2]))]
            fields = [pa.array(x, pa.int64()) for x in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 3
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(run)))
            yield common.batch(doc_id=b.column("doc_id"), runs=lists, text=kept.cast(pa.string()))

    return rows.mapInArrow(work, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the ends of a tenth of the texts (by crc32 of doc_id, h) become periodic: with
    g = floor(h / 10), words from a = g mod n on are repeats of the 1 + floor((n - a) / (3 + g mod 8)) words there.
    Texts of null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    plain = rows.filter("h is null or h % 10 != 0").select("doc_id", "text")
    words = rows.filter("h % 10 = 0").select("doc_id", "text", F.expr("h div 10").alias("g"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(common.WORD), 0).alias("w"))
    words = words.withColumn("n", F.size("w").cast("bigint"))
    cut = words.filter("n > 0").withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.expr("cast((n - a - 1) div p + 1 as int)")
    repeats = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.expr("cast(n - a as int)"))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a").cast("int")), repeats)
    return plain.unionByName(cut.select("doc_id", text.alias("text"))).unionByName(words.filter("n = 0").select("doc_id", "text"))


def op11_lpf_runs(spark, sf_dir: str) -> DataFrame:
    found = find(with_repeats(common.documents(spark, sf_dir)))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
