"""64-bit hashes of the words of many texts at once.

A word is a run of bytes that are not ASCII white space. Its hash is a
polynomial over the bytes, read off prefix sums, then mixed; no word becomes a
Python object. Long texts are cut at white space, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes words; with ``lower``, A-Z count as a-z. Make one per task: it
    holds tables of powers for texts of PIECE bytes."""

    def __init__(self, lower: bool, alphanumeric: bool = False):
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        if alphanumeric:    # words end at any ASCII character that is no letter or digit
            self.space[[i for i in range(128) if not chr(i).isalnum()]] = True
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.size = 0
        self.stems: tuple[int, ...] = ()

    def _powers(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = max(PIECE + 1024, size)
        self.power = np.empty(self.size, np.uint64)
        self.inverse = np.empty(self.size, np.uint64)
        for out, base in ((self.power, _BASE), (self.inverse, pow(_BASE, -1, 1 << 64))):
            out[0], done = 1, 1
            while done < self.size:
                step = min(done, self.size - done)
                out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._powers(len(data) + 1)
        raw = np.frombuffer(data, np.uint8)
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        total = np.concatenate((np.zeros(1, np.uint64),
                                np.cumsum(self.value[raw] * self.power[:len(raw)], dtype=np.uint64)))
        h = (total[ends] - total[starts]) * self.inverse[starts]
        h = mix(h + (ends - starts).astype(np.uint64))
        if self.stems:      # one row of hashes per stem length; a word no longer than that counts itself
            h = np.stack([h] + [np.where(ends - starts > k, mix(
                (total[np.minimum(starts + k, ends)] - total[starts]) * self.inverse[starts]
                + np.uint64((k + 1) << 40)), h) for k in self.stems], axis=1)
        return h, starts, ends

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (byte offsets) of each word of a text."""
        if len(data) <= PIECE:
            return self._piece(data)
        parts, start = [], 0
        while start < len(data):
            end = start + PIECE
            while end < len(data) and not self.space[data[end]]:
                end += 1
            h, s, e = self._piece(data[start:end])
            parts.append((h, s + start, e + start))
            start = end
        return tuple(np.concatenate(x) for x in zip(*parts))

    def many(self, texts: list[bytes]):
        """Per text: its :meth:`words`. Short texts are hashed together."""
        batch, size = [], 0
        for data in texts:
            if batch and size + len(data) >= PIECE:
                yield from self._together(batch)
                batch, size = [], 0
            batch.append(data)
            size += len(data) + 1
        if batch:
            yield from self._together(batch)

    def _together(self, batch: list[bytes]):
        if len(batch) == 1:
            yield self.words(batch[0])
            return
        h, s, e = self._piece(b" ".join(batch))
        at = np.concatenate(([0], np.cumsum([len(d) + 1 for d in batch])))
        cut = np.searchsorted(s, at)
        for k in range(len(batch)):
            a, b = cut[k], cut[k + 1]
            yield h[a:b], s[a:b] - at[k], e[a:b] - at[k]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of fewer words, the one whole run."""
    n = min(n, len(h))
    if n == 0:
        return h
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x94D049BB133111EB) + h[k:k + m])
    return out
