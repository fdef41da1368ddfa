"""Ratios of matching blocks of many pairs of texts at once: difflib's ratio, worked on arrays."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Longer texts go to difflib itself, which sets frequent letters aside from 200 on.
_LONGEST = 199
#: Pairs worked together, so that their arrays stay in cache.
_PAIRS = 8_192
_BIT = {c: (1 << 2 * i, 2 << 2 * i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {c: (1 << 52 + i, 0) for i, c in enumerate("0123456789 ")}


class Texts:
    """Distinct texts under numbers, with their letters, lengths and the bits of their letters."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[str] = []

    def add(self, text: str) -> int:
        n = self.at.get(text)
        if n is None:
            n = self.at[text] = len(self.texts)
            self.texts.append(text)
        return n

    def close(self) -> Texts:
        """Lay out the arrays, once all texts are in."""
        n = len(self.texts)
        self.length = np.fromiter(map(len, self.texts), np.int32, n)
        self.short = np.array([x <= _LONGEST and t.isascii() for t, x in zip(self.texts, self.length.tolist(), strict=True)], bool)
        raw = "".join(t for t, s in zip(self.texts, self.short.tolist(), strict=True) if s).encode()
        self.letters = np.frombuffer(raw + b"\0", np.uint8)
        own = np.where(self.short, self.length, 0)
        self.start = np.cumsum(own) - own
        bits = np.zeros(n, np.uint64)
        for i, t in enumerate(self.texts):
            b = 0
            for c in t:
                one, two = _BIT.get(c, (0, 0))
                b |= two if b & one else one
            bits[i] = b
        self.bits, self.rest = bits, self.length - np.bitwise_count(bits).astype(np.int32)
        return self

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No less than ``ratios``: the letters that both have, whatever their order."""
        both = self.length[a] + self.length[b]
        same = np.bitwise_count(self.bits[a] & self.bits[b]) + np.minimum(self.rest[a], self.rest[b])
        return 2.0 * same / np.maximum(both, 1)

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``SequenceMatcher(None, a, b).ratio()`` of each pair of numbers, worked once for each distinct pair; 1 for equal texts."""
        if not len(a):
            return np.empty(0)
        pairs, back = np.unique(a.astype(np.int64) * len(self.texts) + b, return_inverse=True)
        a, b = np.divmod(pairs, len(self.texts))
        out = (a == b).astype(float)
        other = np.flatnonzero(a != b)
        plain = self.short[a[other]] & self.short[b[other]]
        for i in other[~plain]:
            out[i] = SequenceMatcher(None, self.texts[a[i]], self.texts[b[i]]).ratio()
        other = other[plain]
        a, b = a[other], b[other]
        out[other] = 2.0 * self._matches(a, b) / (self.length[a] + self.length[b])
        return out[back]

    def _matches(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters in matching blocks: the longest block, the first of equals, then the same left and right of it."""
        total = np.zeros(len(a), np.int64)
        who, a0, b0, na, nb = np.arange(len(a)), self.start[a], self.start[b], self.length[a], self.length[b]
        while True:
            some = (na > 0) & (nb > 0)
            longer = np.maximum(na, nb)[some].astype(np.uint8)
            order = np.flatnonzero(some)[np.argsort(longer, kind="stable")]
            if not len(order):
                return total
            who, a0, b0, na, nb, longer = who[order], a0[order], b0[order], na[order], nb[order], np.sort(longer, kind="stable")
            size, i, j, at = *[np.empty(len(who), np.int32) for _ in range(3)], 0
            while at < len(who):  # pairs of like lengths: the longer text's at most a third more than the least of them
                end = min(at + _PAIRS, int(np.searchsorted(longer, min(int(longer[at]) * 4 // 3, 255), "right")))
                k, at = slice(at, end), end
                size[k], i[k], j[k] = self._longest(a0[k], b0[k], na[k], nb[k])
            total += np.bincount(who, size, len(total)).astype(np.int64)
            hit = size > 0
            who, a0, b0, na, nb, size, i, j = [x[hit] for x in (who, a0, b0, na, nb, size, i, j)]
            who, na, nb = np.concatenate([who, who]), np.concatenate([i, na - i - size]), np.concatenate([j, nb - j - size])
            a0, b0 = np.concatenate([a0, a0 + i + size]), np.concatenate([b0, b0 + j + size])

    def _longest(self, a0: np.ndarray, b0: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each two pieces of text the longest equal block: its size and where it begins in both."""
        last, high = len(self.letters) - 1, int(nb.max())
        y = np.stack([np.where(j < nb, self.letters[np.minimum(b0 + j, last)], 2) for j in range(high)])
        # A cell holds 256 times the block that ends there; with it goes how early it ends in b.
        early = (255 - np.arange(high)).astype(np.uint16)[:, None]
        run, new = np.zeros((2, high + 1, len(na)), np.uint16)
        cell, equal = np.empty((high, len(na)), np.uint16), np.empty((high, len(na)), bool)
        best, beat, end = np.full(len(na), 255, np.uint16), np.full(len(na), 255, np.uint16), np.zeros(len(na), np.int32)
        for i in range(int(na.max())):
            np.equal(np.where(i < na, self.letters[np.minimum(a0 + i, last)], 1), y, out=equal)
            np.add(run[:-1], 256, out=cell)
            np.multiply(cell, equal, out=new[1:])
            np.bitwise_or(new[1:], early, out=cell)
            top = cell.max(0)
            better = top > beat
            np.copyto(best, top, where=better)
            end[better] = i
            np.bitwise_or(best, 255, out=beat)
            run, new = new, run
        size = (best >> 8).astype(np.int32)
        return size, end - size + 1, (255 - (best & 255)).astype(np.int32) - size + 1
