"""Best-fit packing of documents into sequences by minimum bin slack.

Pieces. A document's ids (and an end id) are one piece; only a document of more than `capacity` ids is cut, into pieces
of `capacity`, of which the first may be shorter. Pieces are encoded and written once, in parts.

Plan. Bins differ only by the lengths they hold, so the plan needs no more than the number of pieces of each length, at
most `capacity` numbers however many pieces there are. For one bin a bit set holds all sums that the lengths so far can
form (each with as many pieces as are left; shifts by doubling multiples); the highest bit within the capacity
is the fullest feasible combination, and walking back, longest first, gives its lengths. It is removed as often as its
lengths last: what is feasible only shrinks, so the same combination stays the fullest until then and each bin is the one
that bin-by-bin work would fill. Every step uses up a multiple of some length, so there are at most
sum(capacity / length) of them, some 16,000 for 2,048.

Places. Pieces of one length are interchangeable. Each is numbered among those of its length (within its part, plus those
in the parts before), and its number gives its bin and its place there.

Defined results. A null text is empty: its end id alone. Null ids stay null; rows that repeat an id are documents of
their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
#: Bits of a piece's number among those of its length.
NUMBER_BITS = 48


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    if n <= capacity:
        return [n]
    first = n % capacity or capacity
    return [first, *[capacity] * ((n - first) // capacity)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (32-bit, little-endian) of every piece; part and no: its number among the
    pieces of its length in its part."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        enc, part, seen = tokens.encoder(vocabulary, True), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in common.text_slices(batches, tokens.CHUNK):
            found = [np.append(x, np.uint32(end_id)).astype("<u4") for x in enc.ids(b.column("text").to_pylist())]
            sizes = [cut(len(x), capacity) for x in found]
            lengths = [n for own in sizes for n in own]
            numbers = []
            for n in lengths:
                numbers.append(seen[n])
                seen[n] += 1
            counts = [len(own) for own in sizes]
            upto = np.cumsum([0, *lengths])
            firsts = np.cumsum(counts) - counts
            flat = np.concatenate(found)
            raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * upto).astype("<i4").tobytes()), pa.py_buffer(flat)])
            yield common.batch(
                doc_id=b.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                piece=(np.arange(len(lengths)) - np.repeat(firsts, counts)).astype("i4"),
                start=upto[:-1] - np.repeat(upto[firsts], counts), length=np.array(lengths, "i8"), ids=raw,
                part=np.full(len(lengths), part, "i4"), no=np.array(numbers, "i8"),
            )

    return rows.mapInArrow(encode, "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, no bigint")


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces in each bin), ...] longest first), bin after bin the fullest combination of what is left."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a bin")
    lengths, mask = sorted(left), (1 << capacity + 1) - 1
    sums, out = [1], []  # sums[i]: bit s is set where some pieces of the i shortest lengths have sum s
    while lengths:
        for n in lengths[len(sums) - 1 :]:
            bits, most, k = sums[-1], min(left[n], capacity // n), 1
            while most:
                k = min(k, most)
                bits |= bits << k * n & mask
                most, k = most - k, 2 * k
            sums.append(bits)
        rest, own = sums[-1].bit_length() - 1, []
        for i in range(len(lengths) - 1, -1, -1):
            n = lengths[i]
            k = min(left[n], rest // n)
            while not sums[i] >> rest - k * n & 1:
                k -= 1
            if k:
                own.append((n, k))
                rest -= k * n
        bins = min(left[n] // k for n, k in own)
        out.append((bins, own))
        changed = []
        for n, k in own:
            before = min(left[n], capacity // n)
            left[n] -= bins * k
            if min(left[n], capacity // n) < before:
                changed.append(n)
        # Sums stay as they are below the shortest length that has fewer pieces than a bin could take.
        keep = lengths.index(min(changed))
        lengths = lengths[:keep] + [n for n in lengths[keep:] if left[n]]
        del sums[keep + 1 :]
    return out


class Places:
    """Where the pieces of each length go, by their number: sorted runs of numbers, each for the bins of a combination."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, bins = [], 0
        for times, own in plan:
            offset = 0
            for n, k in own:
                rows.append(((n << NUMBER_BITS) + used.get(n, 0), k, bins, offset))
                used[n] = used.get(n, 0) + times * k
                offset += n * k
            bins += times
        self.bins = bins
        self.key, self.each, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset."""
        key = (length << NUMBER_BITS) + number
        i = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[i]
        return self.first[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def packed(table: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids")) -> DataFrame:
    """The columns keep of pieces() (a written table), with sequence_id and offset."""
    by_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = common.written(by_part, "pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places(combinations(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = table.join(before, ["part", "length"]).select(*keep, F.col("length").alias("own_length"), (F.col("before") + F.col("no")).alias("number"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema)

    def place(batches):
        for b in batches:
            seq, offset = places.of(*(b.column(x).to_numpy() for x in ("own_length", "number")))
            yield common.batch(**{x: b.column(x) for x in keep}, sequence_id=seq, offset=offset)

    return rows.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence, from packed() with ids; a group is at most `capacity` ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.reduce("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    grouped = packed_pieces.groupBy("sequence_id").agg(own.alias("pieces"), F.sum("length").alias("length"))
    return grouped.select("sequence_id", "length", ids.alias("ids"))


def op13_min_slack_packing(spark, sf_dir: str) -> DataFrame:
    table = common.written(pieces(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), "pack-pieces")
    digest = table.withColumn("ids_crc32", F.crc32("ids"))
    return packed(digest, keep=("doc_id", "piece", "start", "length", "ids_crc32"))
