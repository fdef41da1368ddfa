"""Evaluation passages in a corpus: SimHash windows, Hamming blocks, a shingle index and exact shingle similarity."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import worker_memory

_WORD = re.compile(r"[^\W_]+")
#: Bits of a fingerprint, and the blocks it is cut into: any two fingerprints within BLOCKS - 1 bits agree in a block.
BITS, BLOCKS = 64, 4
#: Item windows that one pass over the corpus carries to the executors (32 bytes each, 16 MB).
ITEM_WINDOWS = 500_000
#: Words of a long text that are fingerprinted at a time.
CHUNK_WORDS = 1 << 16


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters or digits, composed and case-folded."""
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold()) if text else []


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (the constants are those of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), dtype=np.uint64, count=len(ws))


def _window_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of each ``width`` consecutive rows."""
    c = np.cumsum(x, axis=0, dtype=np.int32)
    out = c[width - 1 :].copy()
    out[1:] -= c[:-width]
    return out


def simhash_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of each window of ``width`` consecutive word hashes (none if there are fewer)."""
    if len(h) < width:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    ones = _window_sums(bits, width)
    return np.packbits(ones * 2 > width, axis=1, bitorder="little").view(np.uint64).ravel()


def exact_windows(h: np.ndarray, width: int) -> np.ndarray:
    """An order-sensitive 64-bit hash of each window."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mix(out ^ h[i : i + n], i + 1)
    return out


class ItemIndex:
    """The windows of a block of items, found by Hamming distance through a table per 16-bit block."""

    def __init__(self, rows: list[tuple[int, int, str]], width: int, radius: int, shingle: int = 5, similarity: float = 0.8) -> None:
        assert radius < BLOCKS, "the blocks guarantee radius BLOCKS - 1"
        self.width, self.radius, self.size, self.similarity = width, radius, min(shingle, width), similarity
        item, sim, exact, start, rows_ = [], [], [], [], []
        self.words: dict[int, list[str]] = {}
        for item_id, shift, text in rows:
            ws = words(text)
            self.words[item_id] = ws
            h = word_hashes(ws)
            s = simhash_windows(h, width)
            rows_.append(np.lib.stride_tricks.sliding_window_view(h, width) if len(h) >= width else np.empty((0, width), np.uint64))
            item.append(np.full(len(s), item_id, dtype=np.int64))
            sim.append(s)
            exact.append(exact_windows(h, width))
            start.append(np.arange(len(s)))
        self.item, self.sim = np.concatenate(item), np.concatenate(sim)
        self.exact, self.start, self.hashes = np.concatenate(exact), np.concatenate(start), np.concatenate(rows_)
        self.weight = word_weights(self.words)
        known = word_hashes(list(self.weight))
        order = np.argsort(known)
        self.word, self.word_weight = known[order], np.array(list(self.weight.values()))[order]
        self.blocks = []
        for b in range(BLOCKS):
            v = ((self.sim >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(v, kind="stable")
            first = np.searchsorted(v[order], np.arange(1 << 16), side="left")
            count = np.bincount(v, minlength=1 << 16)
            self.blocks.append((order, first, count))

    def verified(self, h: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of windows (of the words ``h``, and of the items) have weighted shingles similar enough."""
        keep = np.zeros(len(left), dtype=bool)
        for at in range(0, len(left), 20_000):
            a, b = h[left[at : at + 20_000, None] + np.arange(self.width)], self.hashes[right[at : at + 20_000]]
            keep[at : at + 20_000] = window_similarities(a, b, self._weights(a), self._weights(b), self.size) >= self.similarity * (1 - 1e-9)
        return keep

    def _weights(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, self.word_weight[at], 1.0)

    def near(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint position, window position) within the radius."""
        left, right = [], []
        for b, (order, first, count) in enumerate(self.blocks):
            v = ((fingerprints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = count[v]
            hit = np.flatnonzero(n)
            for part in np.array_split(hit, max(1, int(n[hit].sum()) // 2_000_000)):
                k = n[part]
                q = np.repeat(part, k)
                at = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
                w = order[np.repeat(first[v[part]], k) + at]
                x = fingerprints[q] ^ self.sim[w]
                ok = np.bitwise_count(x) <= self.radius
                for earlier in range(b):
                    ok &= ((x >> np.uint64(16 * earlier)) & np.uint64(0xFFFF)) != 0
                left.append(q[ok])
                right.append(w[ok])
        return np.concatenate(left) if left else np.empty(0, np.int64), np.concatenate(right) if right else np.empty(0, np.int64)


class ShingleIndex:
    """The windows of a block of items by their shingles: no pair of windows that reaches the similarity is lost."""

    def __init__(self, rows: list[tuple[int, int, str]], width: int, shingle: int, similarity: float) -> None:
        assert similarity > 0, "windows that share no shingle are never met"
        self.width, self.similarity, self.size = width, similarity, min(shingle, width)
        self.per = width - self.size + 1  # shingles of a window
        self.words: dict[int, list[str]] = {item_id: words(text) for item_id, _, text in rows}
        self.weight = word_weights(self.words)
        known = word_hashes(list(self.weight))
        order = np.argsort(known)
        self.word, self.word_weight = known[order], np.array(list(self.weight.values()))[order]
        item, start, whole, hashes, mass = [], [], [], [], []
        for item_id, ws in self.words.items():
            h = word_hashes(ws)
            s = exact_windows(h, self.size)
            hashes.append(s)
            mass.append(_sums(self._weights(h), self.size))
            item.append(np.full(len(s), item_id, dtype=np.int64))
            start.append(np.arange(len(s)))
            whole.append(np.arange(len(s)) <= len(ws) - width)
        # A window has the number of its first shingle; the last shingles of an item begin no window.
        self.item, self.start, self.whole = np.concatenate(item), np.concatenate(start), np.concatenate(whole)
        m = np.concatenate(mass)
        self.mass = _sums(np.concatenate([m, np.zeros(self.per - 1)]), self.per)
        self.shingle, code = np.unique(np.concatenate(hashes), return_inverse=True)
        self.order = np.argsort(code, kind="stable")
        self.count = np.bincount(code, minlength=len(self.shingle))
        self.first = np.cumsum(self.count) - self.count

    def _weights(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, self.word_weight[at], 1.0)

    def near(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window position, item window) that may reach the similarity, equal windows of ``h`` once.

        The shingles of a window that are in any item, then those in the item window, bound what the
        two share from above, and the heavier window bounds their union from below.
        """
        none = np.empty(0, np.int64)
        s = exact_windows(h, self.size)
        code = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        hit = self.shingle[code] == s
        if len(h) < self.width or not hit.any():
            return none, none
        mass = _sums(self._weights(h), self.size)
        total = _sums(mass, self.per)
        at = np.flatnonzero(_sums(mass * hit, self.per) >= self.similarity * total * (1 - 1e-9))
        at = at[np.unique(exact_windows(h, self.width)[at], return_index=True)[1]]
        if not len(at):
            return none, none
        work = np.cumsum(_sums(self.count[code] * hit, self.per)[at] * self.per)
        left, right = [], []
        for part in np.split(at, np.flatnonzero(np.diff(work // 2_000_000)) + 1):
            p = part[:, None] + np.arange(self.per)
            q = np.repeat(part, self.per)[hit[p].ravel()]
            p = p.ravel()[hit[p].ravel()]
            k = self.count[code[p]]
            q, p = np.repeat(q, k), np.repeat(p, k)
            g = self.order[np.repeat(self.first[code[p[np.cumsum(k) - k]]], k) + np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)]
            w = g[:, None] - np.arange(self.per)
            ok = (w >= 0) & self.whole[w] & (self.item[w] == self.item[g][:, None])
            n = ok.sum(axis=1)
            pair, back = np.unique(np.repeat(q, n) * len(self.item) + w[ok], return_inverse=True)
            shared = np.bincount(back, weights=np.repeat(mass[p], n), minlength=len(pair))
            q, w = pair // len(self.item), pair % len(self.item)
            ok = shared >= self.similarity * np.maximum(total[q], self.mass[w]) * (1 - 1e-9)
            left.append(q[ok])
            right.append(w[ok])
        return np.concatenate(left), np.concatenate(right)


def window_similarities(a: np.ndarray, b: np.ndarray, mass_a: np.ndarray, mass_b: np.ndarray, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of pairs of windows, given as rows of word hashes with the words' weights.

    A window's shingles are the runs of ``size`` of its words; one that occurs twice counts twice.
    """
    def shingles(h: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = h.shape[1] - size + 1
        s, m = np.zeros((len(h), n), dtype=np.uint64), np.zeros((len(h), n))
        for i in range(size):
            s = _mix(s ^ h[:, i : i + n], i + 1)
            m += mass[:, i : i + n]
        return s, m

    (s, m), (t, k) = shingles(a, mass_a), shingles(b, mass_b)
    # The o-th occurrence of a shingle meets the o-th occurrence in the other window.
    place = lambda x: np.tril(x[:, :, None] == x[:, None, :], -1).sum(axis=2)
    same = (s[:, :, None] == t[:, None, :]) & (place(s)[:, :, None] == place(t)[:, None, :])
    shared = (m * same.any(axis=2)).sum(axis=1)
    return shared / np.maximum(m.sum(axis=1) + k.sum(axis=1) - shared, 1e-12)


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of each ``width`` consecutive numbers, each added up by itself."""
    return np.lib.stride_tricks.sliding_window_view(x, width).sum(axis=1) if len(x) >= width else x[:0]


def word_weights(items: dict[int, list[str]]) -> dict[str, float]:
    """The weight of each word of the items, larger the fewer items have it."""
    weight: dict[str, float] = {}
    for ws in items.values():
        for w in set(ws):
            weight[w] = weight.get(w, 0.0) + 1.0
    return {w: 1.0 + float(np.log(len(items) / n)) for w, n in weight.items()}


def shingle_similarity(a: list[str], b: list[str], size: int, weight: dict[str, float] | None = None) -> float:
    """Weighted Jaccard similarity of the word shingles of two passages; a word's weight is 1 if not given."""
    def bag(ws: list[str]) -> dict[tuple[str, ...], float]:
        out: dict[tuple[str, ...], float] = {}
        for i in range(len(ws) - size + 1):
            s = tuple(ws[i : i + size])
            out[s] = out.get(s, 0.0) + sum((weight or {}).get(w, 1.0) for w in s)
        return out

    x, y = bag(a), bag(b)
    total = sum(max(x.get(s, 0.0), y.get(s, 0.0)) for s in x.keys() | y.keys())
    return sum(min(x[s], y[s]) for s in x.keys() & y.keys()) / total if total else 0.0


def _index(name: str, rows: list[tuple[int, int, str]], width: int, radius: int, shingle: int, similarity: float, exact: bool) -> ItemIndex | ShingleIndex:
    last = worker_memory("leaks")  # the index of the block it had last; a worker takes many tasks of one block
    if name not in last:
        last.clear()
        last[name] = ItemIndex(rows, width, radius, shingle, similarity) if exact else ShingleIndex(rows, width, shingle, similarity)
    return last[name]


def _scan(block: Broadcast, name: str, width: int, radius: int, shingle: int, similarity: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block.value, width, radius, shingle, similarity, exact)
        weight = index.weight
        known: dict[str, int] = {}
        import xxhash

        for batch in batches:
            docs, items, sims = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                ws = words(text)
                if len(ws) < width:
                    continue
                if len(known) > 500_000:
                    known.clear()
                h = np.empty(len(ws), dtype=np.uint64)
                for i, w in enumerate(ws):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = xxhash.xxh3_64_intdigest(w)
                    h[i] = x
                best: dict[int, float] = {}
                for at in range(0, len(ws) - width + 1, CHUNK_WORDS):
                    piece = h[at : at + CHUNK_WORDS + width - 1]
                    left, right = index.near(simhash_windows(piece, width) if exact else piece)
                    if exact and len(left):
                        ok = index.verified(piece, left, right)
                        left, right = left[ok], right[ok]
                        # What follows is exact: of similar windows those of the same words.
                        same = exact_windows(piece, width)[left] == index.exact[right]
                        left, right = left[same], right[same]
                    for q, w in zip(left.tolist(), right.tolist(), strict=True):
                        item = int(index.item[w])
                        if best.get(item, 0.0) >= 1.0:
                            continue
                        there = ws[at + q : at + q + width]
                        mine = index.words[item][index.start[w] : index.start[w] + width]
                        s = 1.0 if there == mine else shingle_similarity(there, mine, shingle, weight)
                        if s >= (1.0 if exact else similarity):
                            best[item] = max(s, best.get(item, 0.0))
                for item, s in best.items():
                    docs.append(doc)
                    items.append(item)
                    sims.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(sims, pa.float64())], names=["doc_id", "item_id", "similarity"])

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int = ITEM_WINDOWS) -> Iterator[list[tuple[int, int, str]]]:
    """The items in blocks of at most ``limit`` words (an item alone if it is longer), streamed to the driver one partition at a time."""
    block: list[tuple[int, int, str]] = []
    size = 0
    for r in items.select(F.col(item_id).cast("long"), text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        n = len(r[1]) // 4 + 1
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r[0], 0, r[1]))
        size += n
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 12, radius: int = 3, shingle: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """Documents that hold a passage of ``width`` words of an item: ``doc_id``, ``item_id``, ``similarity``.

    A window of ``width`` words of a document and one of an item count if the weighted Jaccard
    similarity of their ``shingle``-word shingles is at least ``similarity``, or their words are
    equal. Such windows share shingles, so candidates come from an index of the items' shingles,
    pruned by bounds of the similarity, and none is lost. With ``exact`` the words must be equal:
    every window gets a 64-bit SimHash, all pairs within ``radius`` bits are found through BLOCKS
    block tables (pigeonhole), those whose weighted shingles are similar enough are kept, and of
    these, windows of the same words count; equal windows pass both steps, so none is lost. A pair of document and item is one
    row, with its best similarity.

    The items are a stated query set: they go over the corpus in blocks of bounded size, each block
    a broadcast of at most ITEM_WINDOWS windows, so a larger item table means more passes and never
    a larger broadcast. The corpus is not shuffled. Null, empty and short texts (under ``width``
    words, documents or items) match nothing; long texts are taken in pieces that overlap by a
    window; documents repeated under one id give one row per item. Without items there are no rows.
    """
    schema = "doc_id long, item_id long, similarity double"
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        block = [r for r in block if len(words(r[2])) >= width]
        if block:
            sent = docs.sparkSession.sparkContext.broadcast(block)
            part = slim.mapInArrow(_scan(sent, uuid.uuid4().hex, width, radius, shingle, similarity, exact), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
