"""Content-defined sampling of fixed-length windows over symbol sequences, vectorised.

A window is ``width`` consecutive symbols. Of the ``gram``-symbol hashes inside it the smallest (leftmost of
equals) is its anchor: equal windows have the same anchor at the same place, wherever they stand. Neighbouring
windows mostly share their anchor, so a text is described by few (anchor, run of window starts) pairs.
"""

from __future__ import annotations

import numpy as np

from quillmask.llm.common import mix64

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n + 1:
        made = []
        for b in (_BASES[which], _inverse(_BASES[which])):
            p = np.full(n + 1, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if n <= 1 << 21:
            _POWERS[which] = have
    return have


class PrefixHash:
    """Hashes of any stretch of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray, which: int):
        p, self.inverse = powers(which, len(values))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * p[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n]


def byte_tables() -> np.ndarray:
    """Two tables of 256 fixed pseudo-random values."""
    return mix64(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)


_TABLES = byte_tables()
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


class Sequences:
    """Several texts as one run of symbols; ``offsets[i]:offsets[i+1]`` are the symbols of text i."""

    def __init__(self, one: np.ndarray, two: np.ndarray, offsets: np.ndarray, lead: np.ndarray | None = None):
        self.offsets, self.lead = offsets, lead
        self.n = len(one)
        self.first, self.second = PrefixHash(one, 0), PrefixHash(two, 1)

    @classmethod
    def of_bytes(cls, texts: list[bytes]) -> Sequences:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        ahead = np.concatenate((data, np.zeros(3, dtype=np.uint8))).astype(np.uint64)
        lead = sum(ahead[k : k + len(data)] << np.uint64(8 * (3 - k)) for k in range(4)) if len(data) else None
        return cls(_TABLES[0][data], _TABLES[1][data], offsets, lead)

    @classmethod
    def of_words(cls, texts: list[bytes]) -> Sequences:
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        inside = np.concatenate(([False], _IN_WORD[data], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        letters = PrefixHash(_TABLES[0][data], 0)
        one = mix64(letters.of(starts, ends) + (ends - starts).astype(np.uint64))
        return cls(one, mix64(one + np.uint64(0xA0761D6478BD642F)), np.searchsorted(starts, bounds).astype(np.int64))

    def anchors(self, width: int, gram: int) -> tuple[np.ndarray, ...]:
        """(text, first window start within it, windows, anchor's distance from it, anchor's name, span hash) of each run of windows with one anchor.

        The name is the hash of the anchor's gram. Of bytes, its upper half is the first four bytes instead, such that signed longs order like texts."""
        none = np.zeros(0, dtype=np.int64)
        if self.n < width:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        grams = mix64(self.first.grams(gram))
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(order, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del order
        lengths = np.diff(self.offsets)
        valid = np.zeros(len(at) + 1, dtype=np.int8)
        good = lengths >= width
        np.add.at(valid, self.offsets[:-1][good], 1)
        np.add.at(valid, self.offsets[1:][good] - width + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        new[self.offsets[:-1][good]] = True
        lo = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | new[1:]
        count = np.flatnonzero(stop) - lo + 1
        text = np.searchsorted(self.offsets, lo, side="right") - 1
        spot = at[lo]
        span = mix64(self.second.of(lo, lo + count - 1 + width) + (count.astype(np.uint64) << np.uint64(32)) + (spot - lo).astype(np.uint64))
        name = grams[spot]
        if self.lead is not None:
            name = ((self.lead[spot] ^ np.uint64(1 << 31)) << np.uint64(32)) | (name >> np.uint64(32))
        return text, lo - self.offsets[text], count, spot - lo, name, span

    def blocks(self, start: np.ndarray, count: np.ndarray, ahead: np.ndarray, node: np.ndarray, width: int, size: int) -> tuple[np.ndarray, ...]:
        """Runs (absolute starts) cut into blocks of ``size`` neighbouring windows, aligned to the anchor.

        (run, start, windows, node, leaf): the node names the symbols that all windows of the whole block would
        share, the leaf all symbols that the block's windows in this run cover.
        """
        run = np.repeat(np.arange(len(start)), count)
        s = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        left = (start + ahead)[run] - s
        block = left // size
        new = np.ones(len(s), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(s)))
        lo, run, block, left = s[first], run[first], block[first], left[first]
        core = (start + ahead)[run] - block * size
        name = mix64(self.second.of(core, core - size + 1 + width) + node.view(np.uint64)[run] + block.astype(np.uint64))
        leaf = mix64(self.second.of(lo, lo + n - 1 + width) + (n.astype(np.uint64) << np.uint64(32)) + left.astype(np.uint64))
        return run, lo, n, name, leaf
