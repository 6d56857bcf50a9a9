"""Vectorised words: a batch of texts as one byte buffer with word offsets, and hashes of byte ranges.

Everything here works on whole numpy arrays, so a batch costs a few dozen array passes
instead of a Python step for each word.
"""

from __future__ import annotations

import numpy as np

#: The bytes that part words: space, and tab to carriage return.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _K2
    h ^= h >> np.uint64(29)
    h *= _K1
    h ^= h >> np.uint64(32)
    return h


class Words:
    """Words of texts.  buf: the words with one space after each; start, end: of each word in it;
    first: number of words before each text, with the total at the end."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1, out=at[1:])
        word = ~_IS_SPACE[data]
        step = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            step = np.concatenate([[0], step])
        start, end = step[0::2], step[1::2]  # the buffer ends in a space, so each word has an end
        self.first = np.searchsorted(start, at).astype(np.int64)
        keep = word
        keep[end] = True
        self.raw = data[keep]
        size = end - start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.raw[self.end] = 0x20
        self.buf = np.concatenate([self.raw, np.zeros(8, np.uint8)])

    def __len__(self) -> int:
        return len(self.start)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by one space."""
        return self.raw[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""

    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer that has eight spare bytes at its end."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; buf has eight spare bytes."""
    view, size = lanes(buf), end - start
    h = mix(size.astype(np.uint64) + _K1)
    live, at, left = None, start, size
    while True:
        lane = view[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ lane)
        else:
            h[live] = mix(h[live] ^ lane)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def same_ranges(buf: np.ndarray, s1, e1, s2, e2) -> np.ndarray:
    """Whether the byte ranges of each pair are equal, byte for byte."""
    view = lanes(buf)
    out = (e1 - s1) == (e2 - s2)
    live = np.flatnonzero(out)
    a, b, left = s1[live], s2[live], (e1 - s1)[live]
    while len(live):
        m = _MASK[np.minimum(left, 8)]
        good = (view[a] & m) == (view[b] & m)
        out[live[~good]] = False
        go = good & (left > 8)
        live, a, b, left = live[go], a[go] + 8, b[go] + 8, left[go] - 8
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte range of buf (eight spare bytes), as its public specification has it."""
    if len(start) > 1 << 15:  # keep the temporaries in the processor's cache
        return np.concatenate([xxh64_ranges(buf, start[i : i + (1 << 15)], end[i : i + (1 << 15)], seed) for i in range(0, len(start), 1 << 15)])
    with np.errstate(over="ignore"):
        view, size, seed = lanes(buf), end - start, np.uint64(seed)
        h = np.full(len(start), seed + _P5, np.uint64)
        at = start.copy()
        big = np.flatnonzero(size >= 32)
        if len(big):
            acc = [np.full(len(big), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            live = np.arange(len(big))
            p = at[big]
            while len(live):
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], view[p[live] + 8 * k])
                p[live] += 32
                live = live[end[big][live] - p[live] >= 32]
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for k in range(4):
                x = (x ^ _round(np.uint64(0), acc[k])) * _P1 + _P4
            h[big], at[big] = x, p
        h += size.astype(np.uint64)
        for _ in range(3):
            i = np.flatnonzero(end - at >= 8)
            if not len(i):
                break
            h[i] = _rot(h[i] ^ _round(np.uint64(0), view[at[i]]), 27) * _P1 + _P4
            at[i] += 8
        i = np.flatnonzero(end - at >= 4)
        h[i] = _rot(h[i] ^ (view[at[i]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[i] += 4
        for _ in range(3):
            i = np.flatnonzero(end > at)
            h[i] = _rot(h[i] ^ buf[at[i]].astype(np.uint64) * _P5, 11) * _P1
            at[i] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
