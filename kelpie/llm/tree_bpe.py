"""Encoding of long texts as a tree, and decoding.

A text of up to LEAF characters is encoded in one go. A longer one is halved until its parts are that small; the parts
are rows of their own, so one text's parts are encoded by many tasks. Then the parts are joined pairwise, level by
level: the text around a join is encoded anew in a window that grows until, on both sides, a run of AGREE tokens is the
same in the window and in the part. BPE's result is the only token sequence each of whose neighbouring pairs is itself
a BPE result; each pair of the joined sequence is a pair of the left part, of the window or of the right part, so the
joined sequence is the one of the whole text. A window that has grown over both parts is the result as it stands.

Defined results. A null text is empty: no tokens, and an empty decoded text. A null doc_id and rows that repeat one are
rows of their own. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LEAF = 16_384
WINDOW = 32  # tokens on either side at first
AGREE = 4

#: Characters at either end of a part whose tokens' places are kept.
EDGE = 1024


@dataclass
class Part:
    """ids of text[low:high], with the first and last character of each of the first and last tokens (in the text)."""

    ids: np.ndarray
    head: list[tuple[int, int]]
    tail: list[tuple[int, int]]
    low: int
    high: int


def _placed(tok, text: str, at: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    e = tok.encode(text, add_special_tokens=False)
    return np.asarray(e.ids, "<u4"), [(a + at, z + at) for a, z in e.offsets]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def edges(tok, text: str, ids: np.ndarray, edge: int = EDGE) -> tuple[list, list]:
    """Places of the first and last tokens of text, whose ids are given: from encoding its ends alone, as far as that
    gives the same ids, less AGREE tokens at the cut."""
    if len(text) <= 2 * edge:
        _, places = _placed(tok, text, 0)
        return places, places
    first, head = _placed(tok, text[:edge], 0)
    last, tail = _placed(tok, text[-edge:], len(text) - edge)
    n, m = (max(0, _common(x, y) - AGREE) for x, y in ((first, ids), (last[::-1], ids[::-1])))
    return head[:n], tail[len(tail) - m :]


def _shared(ids, places, window, w_places, last: bool) -> tuple[int, int] | None:
    """Where AGREE tokens in a row are the same: index in ids and in window; the first or the last such run."""
    at = {(int(i), *p): k for k, (i, p) in enumerate(zip(ids, places, strict=True))}
    starts = range(len(window) - AGREE + 1)
    for j in reversed(starts) if last else starts:
        k = at.get((int(window[j]), *w_places[j]))
        if k is not None and k + AGREE <= len(ids) and places[k : k + AGREE] == w_places[j : j + AGREE] and (ids[k : k + AGREE] == window[j : j + AGREE]).all():
            return k, j
    return None


def join_parts(tok, text: str, left: Part, right: Part, width: int = WINDOW) -> Part:
    """The part of both parts' text."""
    n, m = len(left.ids), len(right.ids)
    while True:
        a, z = min(width, len(left.tail)), min(width, len(right.head))
        all_left, all_right = a == n, z == m
        if width > max(a, z) and not (all_left and all_right):
            break  # the window would need tokens whose places aren't kept
        begin = left.low if all_left else left.tail[-a][0]
        end = right.high if all_right else right.head[z - 1][1]
        window, places = _placed(tok, text[begin:end], begin)
        if all_left and all_right:
            return Part(window, places, places, left.low, right.high)
        on_left = (n - a, 0) if all_left else _shared(left.ids[n - a :], left.tail[len(left.tail) - a :], window, places, False) if a else None
        on_right = (m, len(window)) if all_right else _shared(right.ids[:z], right.head[:z], window, places, True) if z else None
        if on_left and on_right and on_left[1] <= on_right[1]:
            i, j, k, x = (0 if all_left else n - a + on_left[0]), on_left[1], on_right[0], on_right[1]
            ids = np.concatenate([left.ids[:i], window[j:x], right.ids[k:]])
            # Places up to the first, and from the last, token whose place isn't known.
            head = left.head[:i] + (places[j:x] + right.head[k:] if len(left.head) >= i else [])
            tail = (left.tail[: len(left.tail) - (n - i)] + places[j:x] if len(right.tail) >= m - k else []) + (right.tail[len(right.tail) - (m - k) :] if len(right.tail) > m - k else right.tail)
            return Part(ids, head, tail, left.low, right.high)
        width *= 2
    ids, places = _placed(tok, text[left.low : right.high], left.low)
    return Part(ids, places, places, left.low, right.high)


def cuts(n: int, leaf: int = LEAF) -> int:
    """Into how many equal parts, a power of two, a text of n characters is halved."""
    k = 1
    while n > k * leaf:
        k *= 2
    return k


def join_tree(tok, texts: list[str], parts: list[tuple[np.ndarray, list, list]]) -> np.ndarray:
    """parts: (ids, head, tail) of consecutive pieces of one text, places counted from each piece's own start."""
    text = "".join(texts)
    bounds = np.cumsum([0, *map(len, texts)]).tolist()
    moved = lambda places, s: [(a + s, z + s) for a, z in places]
    level = [Part(i, moved(h, s), moved(t, s), s, e) for (i, h, t), s, e in zip(parts, bounds, bounds[1:], strict=False)]
    while len(level) > 1:
        pairs = [join_parts(tok, text, x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) // 2 * 2 :]
    return level[0].ids


_spellings: dict[int, list[str]] = {}


def _results(doc_ids: pa.Array, tok, ids: list[np.ndarray]) -> pa.RecordBatch:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spelled = _spellings.setdefault(0, list(map(str, range(tok.get_vocab_size()))))
    arrays = [x.tolist() for x in ids]
    decoded = tok.decode_batch(arrays, skip_special_tokens=False)
    return common.batch(
        doc_id=doc_ids, n_tokens=np.array([len(x) for x in arrays], np.int64),
        ids_sha256=[hashlib.sha256(" ".join(map(spelled.__getitem__, x)).encode()).hexdigest() for x in arrays],
        decoded_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in decoded],
    )


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches):
        enc = tokens.encoder(vocabulary, False)
        for b in common.text_slices(batches, tokens.CHUNK):
            yield _results(b.column("doc_id"), enc.tok, enc.ids(b.column("text").to_pylist()))

    short = rows.filter(F.length("text") <= leaf).mapInArrow(whole, RESULT)

    n = F.length("text")
    long = rows.filter(n > leaf).withColumn("row_no", F.monotonically_increasing_id()).withColumn("n", n.cast("bigint"))
    doublings = F.ceil(F.log2(F.col("n") / leaf)).cast("int")
    long = long.withColumn("k", doublings).withColumn("parts", F.expr("shiftleft(1, k)"))
    long = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin, end = F.expr("i * n div parts").cast("int"), F.expr("(i + 1) * n div parts").cast("int")
    leaves = long.select("doc_id", "row_no", "i", F.substring(F.col("text"), begin + 1, end - begin).alias("text"))

    def encode_leaves(batches):
        enc = tokens.encoder(vocabulary, False)
        for b in common.text_slices(batches, tokens.CHUNK):
            texts = b.column("text").to_pylist()
            ids = enc.ids(texts)
            ends = [edges(enc.tok, t, i) for t, i in zip(texts, ids, strict=True)]
            head, tail = ([np.asarray(e[k], "<i4").tobytes() for e in ends] for k in (0, 1))
            yield common.batch(**{x: b.column(x) for x in ("doc_id", "row_no", "i", "text")}, ids=[i.tobytes() for i in ids], head=head, tail=tail)

    def join_leaves(t):
        enc, t = tokens.encoder(vocabulary, False), t.sort_by("i")
        places = lambda raw: list(map(tuple, np.frombuffer(raw, "<i4").reshape(-1, 2).tolist()))
        got = (t.column(x).to_pylist() for x in ("ids", "head", "tail"))
        read = [(np.frombuffer(i, "<u4"), places(h), places(e)) for i, h, e in zip(*got, strict=True)]
        own = _results(t.column("doc_id").slice(0, 1).combine_chunks(), enc.tok, [join_tree(enc.tok, t.column("text").to_pylist(), read)])
        return pa.Table.from_batches([own])

    encoded = leaves.repartition("row_no", "i").mapInArrow(
        encode_leaves, "doc_id bigint, row_no bigint, i int, text string, ids binary, head binary, tail binary"
    )
    joined = encoded.groupBy("row_no").applyInArrow(join_leaves, RESULT)
    return short.unionByName(joined)


def op7_tree_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
