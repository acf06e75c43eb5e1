"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import text_rows

#: Items held by an executor at once; a larger benchmark is taken in blocks of this many.
BLOCK_ITEMS, RADIUS = 4000, 15
_BLOCKS, _BITS = 4, 16


def fingerprint(votes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of every row of summed +1/-1 votes."""
    return np.packbits(votes > 0, axis=-1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def ballots(h: np.ndarray) -> np.ndarray:
    """The +1/-1 votes of word hashes on 64 lanes."""
    return np.unpackbits(T.mix(h).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16) * 2 - 1


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller by sum of the larger multiplicities of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    same = int(np.minimum(n[i], m[j]).sum())
    return same / (len(a) + len(b) - same) if len(a) + len(b) else 0.0


class Items:
    """Benchmark items of one block: word hashes, fingerprints and the tables of their Hamming blocks."""

    def __init__(self, rows: list[tuple[int, str]], k: int, radius: int):
        self.k, self.radius = k, radius
        self.ids, self.words, self.shingles = [], [], []
        for i, t in rows:
            h = plain_words(t)
            if len(h):
                self.ids.append(i)
                self.words.append(h)
                self.shingles.append(T.shingles(h, k))
        self.sizes = np.array([len(h) for h in self.words], np.int64)
        self.prints = np.array([fingerprint(ballots(h).sum(0, dtype=np.int32)[None])[0] for h in self.words], np.uint64)
        pool = [(g, j) for j, s in enumerate(self.shingles) for g in np.unique(s).tolist()]
        pool.sort()
        self.pool = np.array([g for g, _ in pool], np.uint64)
        self.owner = np.array([j for _, j in pool], np.int64)
        # pigeonhole: within ``radius`` of an item, one of the blocks is within radius // _BLOCKS of the item's
        near = np.array([x for x in range(1 << _BITS) if x.bit_count() <= radius // _BLOCKS], np.int64)
        self.tables = []
        for b in range(_BLOCKS):
            part = ((self.prints >> np.uint64(_BITS * b)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            self.tables.append({int(n): np.flatnonzero(part == n) for n in set(part.tolist())})
        self.near = near

    def within(self, print_: int, size: int) -> np.ndarray:
        """Items of this word count whose fingerprint lies within the radius, found through the blocks."""
        found = []
        for b, table in enumerate(self.tables):
            own = (print_ >> (_BITS * b)) & ((1 << _BITS) - 1)
            if len(table) * 4 < len(self.near):  # fewer keys than neighbours: compare the keys
                found += [at for key, at in table.items() if (key ^ own).bit_count() <= self.radius // _BLOCKS]
            else:
                found += [table[x] for x in (self.near ^ own).tolist() if x in table]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        at = at[self.sizes[at] == size]
        return at[np.bitwise_count(self.prints[at] ^ np.uint64(print_)) <= self.radius]


def plain_words(text: str) -> np.ndarray:
    return T.words(T.encode(text))[0]


def matches(h: np.ndarray, items: Items, least: float) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, first word, words, Hamming distance) of the best window for every item a text holds."""
    n, k = len(h), items.k
    if not n or not len(items.pool):
        return []
    # a window that shares no shingle with an item has similarity 0, so only windows around shared ones are hashed
    lengths = np.unique(np.minimum(k, items.sizes))
    spots: dict[int, set[int]] = {}
    for size in lengths.tolist():
        if size > n:
            continue
        g = T.runs(h, size)
        lo = np.searchsorted(items.pool, g)
        lo[lo == len(items.pool)] = 0
        for p in np.flatnonzero(items.pool[lo] == g).tolist():
            for j in items.owner[lo[p] : np.searchsorted(items.pool, g[p], "right")].tolist():
                m = int(items.sizes[j])
                if min(k, m) == size and m <= n:
                    spots.setdefault(m, set()).update(range(max(0, p + size - m), min(p, n - m) + 1))
                elif min(k, m) == size and n >= size:
                    spots.setdefault(m, set()).add(0)
    best: dict[int, tuple[float, int, int, int]] = {}
    for m, starts in spots.items():
        at = np.array(sorted(starts), np.int64)
        lo, hi = at[0], min(n, at[-1] + m)
        sums = np.zeros((hi - lo + 1, 64), np.int32)
        np.cumsum(ballots(h[lo:hi]), axis=0, out=sums[1:])
        prints = fingerprint(sums[np.minimum(at + m, hi) - lo] - sums[at - lo])
        for s, f in zip(at.tolist(), prints.tolist(), strict=True):
            for j in items.within(f, m).tolist():
                d = weighted_similarity(T.shingles(h[s : s + m], k), items.shingles[j])
                if d >= least and d > best.get(j, (0.0,))[0]:
                    best[j] = (d, s, min(m, n), int(f ^ int(items.prints[j])).bit_count())
    return [(items.ids[j], *v) for j, v in sorted(best.items())]


def _blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of about BLOCK_ITEMS."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): the best window of a document for every item in it.

    Windows have as many words as the item (the whole text if it is shorter). A window is a candidate if its SimHash
    lies within ``radius`` bits of the item's, which the Hamming blocks find without loss, and a match if the weighted
    Jaccard similarity of their k-word shingles is at least ``least``; of equal windows the first. Items and texts
    without words match nothing. Null texts are empty, null item ids stay null. The benchmark is a stated query set:
    it is taken in blocks of BLOCK_ITEMS, each sent to the executors, and every document is read whole for each block.
    Repeated rows of documents and repeated items each count: two equal rows and two equal items give four rows. Extra columns
    are ignored; an empty table on either side gives an empty result.
    """
    out = None
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches, sent=sent):
            items = Items(sent.value, k, radius)
            for b in batches:
                found = [(i, *m) for i, t in text_rows(b) for m in matches(plain_words(t), items, least)]
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, x, strict=True)) for x in found], schema=_OUT)

        part = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, item_id long, similarity double, start_word long, n_words long, distance long")
        out = part if out is None else out.union(part)
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay and no text is shuffled.

    Null and empty texts hold none and stay; rows are judged one by one, repeated ones alike. Without items all stay.
    """
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches, sent=sent):
            items = Items(sent.value, k, radius)
            for b in batches:
                yield b.filter(pa.array([not matches(plain_words(t), items, least) for _, t in text_rows(b)], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
