"""Encoding with the tokenizers library inside tasks, with a memo of words.

Most words of a corpus come up again and again, and merging is most of the work. No token of the two vocabularies
reaches across a single space or line end between other characters, or from a letter or digit into punctuation, so a
text of common characters is cut there, each new piece is encoded once by the library (many in one call, with a
separator between them), and a text's ids are the ids of its pieces. Pieces are found, hashed to 64 bits, looked up,
compared byte by byte and put together in numpy. Any other text (rarer characters, longer runs of white space, a possible
special token, a piece that has another one's hash) goes to the library whole.
Either way the ids are those of the library on the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from . import spans

#: ASCII punctuation that always begins a new piece after an ASCII letter or digit (not the apostrophe).
BREAKS = np.zeros(256, bool)
BREAKS[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
ALNUM = np.zeros(256, bool)
ALNUM[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True


def unsafe(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts may not be cut: those with anything but single spaces, single line ends, printable ASCII and the
    Latin letters and signs up to U+024F (whose classes all Unicode versions share, and which have no other normal
    form), with white space at an end, or with what may be a special token. buf: UTF-8 of all texts; none is empty."""
    gap = (buf == 32) | (buf == 10)
    then = np.append(buf[1:], np.uint8(0))
    bad = ((buf < 32) & (buf != 10)) | (buf == 127) | (buf >= 0xCA)
    bad |= (buf == 0xC2) & ((then <= 0xA0) | (then == 0xAD))
    bad |= (buf == 0xC4) & (then == 0xB0)
    bad |= (buf == 60) & (then == 124)
    bad[:-1] |= gap[1:] & gap[:-1]  # over a text's end too: one of them has white space there
    bad[bounds[:-1]] |= gap[bounds[:-1]]
    bad[bounds[1:] - 1] |= gap[bounds[1:] - 1]
    return np.logical_or.reduceat(bad, bounds[:-1])


MEMO_WORDS = 1_200_000
CHUNK = 1 << 19


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Memo:
    """Word -> ids, by the word's hash and, as hashes can collide, its bytes (as 8-byte blocks). Sorted runs, each more than
    half as long again as the next, over one pool of ids and one of blocks."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, ...]] = []  # hashes; place and number of ids; place of the blocks; bytes
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.blocks, self.held = np.zeros(1 << 16, np.uint64), 0

    def find(self, keys: np.ndarray, first: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool (-1: unknown, -2: another word has the hash) and number of ids of each key. The word of key i
        has sizes[i] bytes, its blocks begin at values[first[i]]."""
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for have, places, counts, where, length in self.runs:
            i = np.minimum(np.searchsorted(have, keys[left]), len(have) - 1)
            hit = have[i] == keys[left]
            own, i = left[hit], i[hit]
            right = same(values, first[own], sizes[own], self.blocks, where[i], length[i])
            at[own], n[own] = np.where(right, places[i], -2), counts[i]
            left = left[~hit]
        return at, n

    def _put(self, name: str, used: str, x: np.ndarray) -> int:
        pool, at = getattr(self, name), getattr(self, used)
        while at + len(x) > len(pool):
            pool = np.append(pool, np.zeros(len(pool), pool.dtype))
        pool[at : at + len(x)] = x
        setattr(self, name, pool)
        setattr(self, used, at + len(x))
        return at

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        """keys sorted and unknown so far; values: the blocks of their words, one after another."""
        if sum(len(r[0]) for r in self.runs) + len(keys) > MEMO_WORDS:
            self.runs, self.used, self.held = [], 0, 0
        n = (sizes + 7) >> 3
        places = self._put("pool", "used", ids) + np.cumsum(counts) - counts
        where = self._put("blocks", "held", values) + np.cumsum(n) - n
        run = (keys, *(x.astype(np.int32) for x in (places, counts, where, sizes)))
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            old = self.runs.pop()
            order = np.argsort(np.concatenate([old[0], run[0]]), kind="stable")
            run = tuple(np.concatenate([a, b])[order] for a, b in zip(old, run, strict=True))
        self.runs.append(run)


def same(a: np.ndarray, a_first: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which words have the same bytes, from their blocks."""
    if not len(a_first):
        return np.zeros(0, bool)
    n = np.where(a_size == b_size, (a_size + 7) >> 3, 1)
    start = np.cumsum(n) - n
    i = np.arange(n.sum())
    equal = a[np.repeat(a_first - start, n) + i] == b[np.repeat(b_first - start, n) + i]
    return np.logical_and.reduceat(equal, start) & (a_size == b_size)


class Encoder:
    """ids(texts) -> an array of 32-bit ids for each text. spaced: a byte-level vocabulary, whose tokens have the space
    before a word; else one that lower-cases and drops white space."""

    def __init__(self, path: str, spaced: bool):
        self.tok, self.spaced, self.memo = load(path), spaced, Memo()
        self.between = "\n" if spaced else " あ "
        ids = self.tok.encode(self.between, add_special_tokens=False).ids
        self.mark = np.asarray(ids, "<u4")

    def _learn(self, keys: np.ndarray, found: list[bytes]) -> None:
        """keys and words to the memo."""
        for i in range(0, len(found), 5000):
            part = [w.decode() for w in found[i : i + 5000]]
            # A line end stands before each piece as it is, so a piece that begins with one is sent without it.
            text = self.between.join(["", *(w[1:] if w[0] == "\n" else w for w in part), ""])
            ids = np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            k = len(self.mark)
            marks = np.flatnonzero(ids == self.mark[0]) if k == 1 else np.flatnonzero((np.lib.stride_tricks.sliding_window_view(ids, k) == self.mark).all(axis=1))
            if len(marks) != len(part) + 1:
                raise ValueError("a piece has the separator's ids")
            lead = np.array([w[0] == "\n" for w in part])
            own = np.ones(len(ids), bool)
            for j in range(k):
                own[marks + j] = False
            own[marks[:-1][lead]] = True  # there the separator is the piece's own line end
            flat, at = spans.joined(found[i : i + 5000])
            self.memo.add(keys[i : i + 5000], ids[own], np.diff(marks) - k + lead, spans.blocks(flat, at[:-1], at[1:])[0], np.diff(at))

    def _cut_and_join(self, raw: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(raw)
        buf, bounds = spans.joined(raw)
        odd = unsafe(buf, bounds)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.asarray(self.tok.encode(raw[i].decode(), add_special_tokens=False).ids, "<u4")
        if odd.any():
            raw = [x for x, o in zip(raw, odd.tolist(), strict=True) if not o]
            if not raw:
                return out
            buf, bounds = spans.joined(raw)
        if not self.spaced:
            buf = spans.lower(buf)
        gap = (buf == 32) | (buf == 10)
        mark = gap.copy()
        mark[1:] |= BREAKS[buf[1:]] & ALNUM[buf[:-1]]
        mark[bounds[:-1]] = True
        begins = np.flatnonzero(mark)
        ends = np.append(begins[1:], len(buf))
        first = np.searchsorted(begins, bounds)
        if not self.spaced:
            begins = begins + gap[begins]
        values, at_block = spans.blocks(buf, begins, ends)
        length = ends - begins
        keys, index, inverse = np.unique(spans.block_hashes(values, at_block, length), return_index=True, return_inverse=True)
        at, n = self.memo.find(keys, at_block[index], length[index], values)
        while len(new := np.flatnonzero(at == -1)):  # again where the memo was emptied meanwhile
            whole = buf.tobytes()
            self._learn(keys[new], [whole[a:z] for a, z in zip(begins[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
            at, n = self.memo.find(keys, at_block[index], length[index], values)
        # A word whose hash another one has: its texts go to the library.
        wrong = (at[inverse] < 0) | ~same(values, at_block, length, values, at_block[index[inverse]], length[index[inverse]])
        at, n = np.maximum(at, 0), np.where(at < 0, 0, n)
        sizes = n[inverse]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.memo.pool[np.repeat(at[inverse] - upto[:-1], sizes) + np.arange(upto[-1])]
        plain = np.flatnonzero(~odd).tolist()
        for i, got in zip(plain, np.split(ids, upto[first[1:-1]]), strict=True):
            out[i] = got
        for k in np.unique(np.searchsorted(first, np.flatnonzero(wrong), side="right") - 1).tolist():
            out[plain[k]] = np.asarray(self.tok.encode(raw[k].decode(), add_special_tokens=False).ids, "<u4")
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        raw = [texts[i].encode() for i in filled]
        for a, z in spans.chunks(list(map(len, raw)), CHUNK):
            for i, got in zip(filled[a:z], self._cut_and_join(raw[a:z]), strict=True):
                out[i] = got
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process and vocabulary."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
