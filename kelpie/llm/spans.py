"""Words of many texts at once: byte spans and their 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: An odd base, its inverse modulo 2^64, and the multipliers of a well-known 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, b in (("up", BASE), ("down", INVERSE)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums of byte times power; with hashes() any span's hash in constant time."""
    up, _ = _table(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span: equal bytes, equal hash."""
    _, down = _table(len(sums))
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each (not empty) span as 8-byte numbers, the last one padded with zeros; where each span's begin."""
    n = (ends - begins + 7) >> 3
    first = np.cumsum(n) - n
    at = np.repeat(begins - 8 * first, n) + 8 * np.arange(n.sum())
    every = np.ndarray((len(buf) + 1,), "<u8", buf.tobytes() + bytes(8), strides=(1,))
    return every[at] & _MASKS[np.minimum(np.repeat(ends, n) - at, 8)], first


def block_hashes(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each span from its blocks(): each block is mixed with its place, so it isn't a polynomial."""
    n = np.diff(np.append(first, len(values)))
    place = np.arange(len(values)) - np.repeat(first, n)
    total = np.add.reduceat(mix(values ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)), first) if len(first) else np.zeros(0, np.uint64)
    return mix(total + sizes.astype(np.uint64))


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return block_hashes(*blocks(buf, begins, ends), ends - begins)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, those of longer UTF-8 characters included, stay."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs without ASCII white space; starts: where texts begin, so no word crosses."""
    ink = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = starts[(starts > 0) & (starts < len(buf))]
    first[inner] |= ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] |= ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each begins (and the last ends)."""
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def chunks(sizes: list[int], most: int):
    """(first, last) of runs of texts of about `most` bytes."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)
