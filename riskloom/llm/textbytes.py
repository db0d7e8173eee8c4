"""Vectorised work on UTF-8 text inside a task: words, their 64-bit hashes, and hashes of runs of words.

A batch of texts is one byte array plus the bounds of each text.  Words are hashed by random tables of byte codes and
positions, so a whole batch takes a few numpy passes; pieces of about a megabyte bound the memory of a
very long text.  Words have no length limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same layout for a list of byte strings."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


class _Weights:
    """A fixed pseudo-random number for each position; longer tables are made as they are needed."""

    def __init__(self, seed: int):
        self.seed, self.table = np.uint64(seed), np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            with np.errstate(over="ignore"):
                places = np.arange(1, n + n // 2 + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed
            self.table = mix64(mix64(places) + self.seed)
        return self.table


class WordHasher:
    """Splits text into words and hashes words and runs of words.

    ``separators`` are single bytes; ``fold_case`` lower-cases A-Z.  Make one object per task.

    A word's hash is the sum of its bytes' codes, each times the number of its position in the word, modulo 2**64,
    and a run's that of its words' hashes likewise: unlike powers of a base, the numbers of positions have no structure
    with which differences could cancel.  Hashers of different ``seed`` have independent codes and numbers; two of them
    together identify words by 128 bits.
    """

    def __init__(self, separators: bytes = SPACES, fold_case: bool = False, seed: int = 0):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        codes = np.arange(256, dtype=np.uint64)
        if fold_case:
            codes[65:91] += 32
        with np.errstate(over="ignore"):
            own = mix64(np.full(1, seed + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]
            self.code = mix64((codes + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + own)
        self.places, self.word_places = _Weights(int(own)), _Weights(int(own) ^ 0x5851F42D4C957F2D)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, n = 0, len(data)
        while lo < n:
            hi = min(lo + PIECE, n)
            limit = int(bounds[np.searchsorted(bounds, hi)])
            while hi < limit:
                gaps = np.flatnonzero(~self.inside[data[hi:min(hi + 65536, limit)]])
                if len(gaps):
                    hi += int(gaps[0])
                    break
                hi = min(hi + 65536, limit)
            yield lo, hi
            lo = hi

    def words(self, data: np.ndarray, bounds: np.ndarray):
        """``(hash, start, end, first)``: byte positions of each word; ``first[i]`` is the first word of text i."""
        hashes, starts, ends = [], [], []
        with np.errstate(over="ignore"):
            for lo, hi in self._cuts(data, bounds):
                part = data[lo:hi]
                inside = self.inside[part]
                edge = np.zeros(hi - lo + 1, bool)
                edge[bounds[np.searchsorted(bounds, lo):np.searchsorted(bounds, hi, side="right")] - lo] = True
                begin, end = inside.copy(), inside.copy()
                begin[1:] &= ~inside[:-1] | edge[1:-1]
                end[:-1] &= ~inside[1:] | edge[1:-1]
                start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
                at = np.arange(hi - lo, dtype=np.int32)
                at -= np.maximum.accumulate(np.where(begin, at, 0))  # position in the word
                run = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(self.code[part] * self.places.upto(int(at.max()) + 1)[at], out=run[1:])
                hashes.append(run[stop] - run[start] + (stop - start).astype(np.uint64))
                starts.append(start + lo)
                ends.append(stop + lo)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        start = np.concatenate(starts)
        return mix64(np.concatenate(hashes)), start, np.concatenate(ends), np.searchsorted(start, bounds)

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` consecutive words, over the whole array."""
        n = len(words) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        weights = self.word_places.upto(k)
        total = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                total += words[i:i + n] * weights[i]
        return mix64(total)

    def shingle_sets(self, data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
        """For each text its distinct ``k``-word shingles, sorted; a shorter text is one shingle, an empty one none."""
        words, _, _, first = self.words(data, bounds)
        grams = self.runs(words, k)
        sets = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= k:
                sets.append(np.unique(grams[lo:hi - k + 1]))
            else:
                sets.append(self.runs(words[lo:hi], hi - lo) if hi > lo else words[:0])
        return sets
