"""Substring dedup with difference-cover anchors.

A word is removed if a window of 20 words that covers it, also starts earlier: in a document with a smaller id or
earlier in the same one.  Hashing every window would shuffle one row per word.  Instead 8-word anchors are hashed
only where the position modulo 13 is in the difference cover {0, 1, 3, 9}: for any two positions there is a shift
below 13 that brings both onto the cover, so two equal 20-word windows always share an anchor at the same shift
(12 + 8 = 20).  Only windows around an anchor that occurs twice are then compared in full, by 96 bits of two independent hashes, and
the extension is complete: every such window of every occurrence is judged against its earliest occurrence.

Groups never grow with the number of copies.  A document whose whole text already stands under a smaller id is a
repeat throughout and sends nothing.  Each task first settles what it sees: of several equal windows in one
flush only the earliest is sent on, the others are known repeats and leave as runs.  A group therefore has at most
one row per flush (about ``FLUSH_WORDS`` words), and it is judged by a window over sorted rows, not in memory.

Defined cases.  A null text has no words; a text below 20 words loses none.  A null ``doc_id`` is smaller than any
other.  Rows with the same ``doc_id`` are ordered by start only: equal windows at equal starts do not remove each
other.  What is found for a row goes back by a hash of its id and text, so rows that share an id, or have none, do not
get each other's.  Extra columns pass through; those named like an output column give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.textbytes import SPACES, WordHasher, mix64, slices, utf8

WINDOW = 20
PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8
FLUSH_WORDS = 3_000_000


def _flushes(batches: Iterator[pa.RecordBatch], hasher: WordHasher):
    """Groups of texts of about ``FLUSH_WORDS`` words: lists of (batch slice, words, first)."""
    held, count = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, _, first = hasher.words(*utf8(part.column("text")))
            held.append((part, words, first))
            count += len(words)
            if count >= FLUSH_WORDS:
                yield held
                held, count = [], 0
    if held:
        yield held


def _equal_neighbours(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each sorted row equals the one before."""
    same = np.ones(max(len(sorted_columns[0]) - 1, 0), bool)
    for column in sorted_columns:
        same &= column[1:] == column[:-1]
    return np.concatenate((np.zeros(min(1, len(sorted_columns[0])), bool), same))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, cover = WordHasher(), np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    serial = np.uint64(zlib.crc32(np.random.default_rng().bytes(16))) << np.uint64(32)
    for held in _flushes(batches, hasher):
        hashes, marks, places = [], [], []
        for part, words, first in held:
            sizes = np.diff(first)
            new = np.repeat(~part.column("is_copy").to_numpy(zero_copy_only=False), sizes)
            at = np.arange(len(words)) - np.repeat(first[:-1], sizes)
            size = np.repeat(sizes, sizes)
            use = np.flatnonzero(cover[at % PERIOD] & (at + ANCHOR <= size) & (size >= WINDOW) & new)
            hashes.append(hasher.runs(words, ANCHOR)[use] if len(use) else words[:0])
            marks.append(np.repeat(part.column("mark").to_numpy(zero_copy_only=False), sizes)[use])
            places.append(at[use].astype(np.int32))
        key, mark, place = np.concatenate(hashes), np.concatenate(marks), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        again = _equal_neighbours(key)
        repeated = again.copy()
        repeated[:-1] |= again[1:]
        # known repeats need no partner: they get a key of their own, and all of them carry the mark
        spread = mix64(key + serial + np.arange(len(key), dtype=np.uint64))
        serial += np.uint64(len(key))
        out, marked = np.empty(len(key), np.int64), np.empty(len(key), np.int32)
        out[order] = np.where(again, spread, key).view(np.int64)
        marked[order] = np.where(repeated, ~place, place)
        # documents in order and what repeats from row to row at the end: it takes no space in the shuffle
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(marked), pa.array(mark)], names=["g", "place", "mark"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, other = WordHasher(), WordHasher(seed=1)
    serial = np.uint64(zlib.crc32(np.random.default_rng().bytes(16))) << np.uint64(32)
    for held in _flushes(batches, hasher):
        parts = []
        for part, words, first in held:
            grams = hasher.runs(words, WINDOW)
            second = other.runs(other.words(*utf8(part.column("text")))[0], WINDOW)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            marks = part.column("mark").to_numpy(zero_copy_only=False)
            for row, places in enumerate(part.column("places")):
                lo, n = int(first[row]), int(first[row + 1] - first[row])
                if n < WINDOW:
                    continue
                shared = np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64)
                shared = shared[shared + ANCHOR <= n]  # all, unless two rows have the same mark by chance
                # an anchor at q belongs to the windows that start at q - 12 ... q
                edges = np.zeros(n + 1, np.int32)
                np.add.at(edges, np.maximum(shared - (WINDOW - ANCHOR), 0), 1)
                np.add.at(edges, np.minimum(shared, n - WINDOW) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edges[:n - WINDOW + 1]) > 0)
                parts.append((grams[lo + starts], second[lo + starts].astype(np.uint32), starts.astype(np.int32),
                              np.full(len(starts), ids[row], np.int64), np.full(len(starts), marks[row], np.int64)))
        if not parts:
            continue
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort((columns[2], columns[3], columns[1], columns[0]))
        key, check, start, doc, mark = (c[order] for c in columns)
        again = _equal_neighbours(key, check)
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
        later = (doc != doc[head]) | (start != start[head])
        # in the order of the documents, as above
        new = np.sort(order[~later])
        yield _rows(columns[0][new], columns[1][new], columns[3][new], columns[2][new], columns[4][new],
                    np.zeros(len(new), np.int32))
        doc, start, mark = doc[later], start[later], mark[later]
        by_place = np.lexsort((start, mark, doc))
        doc, start, mark = doc[by_place], start[by_place], mark[by_place]
        goes_on = _equal_neighbours(doc, mark)
        goes_on[1:] &= start[1:] == start[:-1] + 1
        begins = np.flatnonzero(~goes_on)
        length = np.diff(np.append(begins, len(doc))).astype(np.int32)
        own = mix64(serial + np.arange(len(begins), dtype=np.uint64))
        serial += np.uint64(len(begins))
        yield _rows(own, np.zeros(len(begins), np.uint32), doc[begins], start[begins], mark[begins], length)


def _rows(key, check, doc, start, mark, length) -> pa.RecordBatch:
    """``at`` holds the start and the second hash, ``length`` is that of a known run."""
    at = (start.astype(np.int64) << 32) | check
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(at), pa.array(doc), pa.array(mark), pa.array(length)],
        names=["g", "at", "id", "mark", "length"])


def _cut_rows(form: str, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                _, begin, end, first = hasher.words(data, bounds)
                ids, runs = part.column("id").to_pylist(), part.column("runs").to_pylist()
                copied = part.column("is_copy").to_pylist()
                valid = part.column("text").is_valid().to_pylist()
                raw, kept, removed = data.tobytes(), [], []
                for row in range(part.num_rows):
                    lo, hi = int(first[row]), int(first[row + 1])
                    a, b = int(bounds[row]), int(bounds[row + 1])
                    edges = np.zeros(hi - lo + 1, np.int32)
                    if copied[row] and hi - lo >= WINDOW:
                        edges[0] = 1
                    for r in runs[row] or ():
                        if r["id"] == ids[row]:
                            start = r["at"] >> 32
                            edges[start] += 1
                            edges[min(start + max(r["length"], 1) - 1 + WINDOW, hi - lo)] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    removed.append(int(gone.sum()))
                    if form == "words":
                        words = raw[a:b].split()
                        kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]
                                              if removed[-1] else words))
                    elif not removed[-1]:
                        kept.append(raw[a:b] if valid[row] else None)
                    else:
                        kept.append(_without(raw, a, b, begin[lo:hi], gone))
                columns = {"text": pa.array(kept, pa.binary()).cast(pa.string()),
                           "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_arrays(
                    [columns.get(n, part.column(n) if n in part.schema.names else None)
                     for n in ("id", "text", "n_words", "n_removed", *extra)],
                    names=["id", "text", "n_words", "n_removed", *extra])
    return run


def _without(raw: bytes, a: int, b: int, begin: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the removed words, each with the white space up to the next word."""
    turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    at, out = a, []
    for lo, hi in zip(turn[::2].tolist(), turn[1::2].tolist()):
        out.append(raw[at:int(begin[lo])])
        at = int(begin[hi]) if hi < len(begin) else b
    out.append(raw[at:b])
    return b"".join(out)


def remove_repeats(docs: DataFrame, form: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated passages: the text column cut, plus ``n_words`` and ``n_removed``.

    ``form="text"`` keeps the white space between kept words, and leaves a text without repeats as it is;
    ``form="words"`` returns the kept words joined by one space (a null text gives an empty one).
    """
    key = F.coalesce(support.col(doc_id).cast("long"), F.lit(support.NO_ID))
    base = docs.select(key.alias("id"), support.col(text).alias("text"), support.packed(docs, text).alias("rest")) \
        .withColumn("mark", F.xxhash64("id", "text"))
    rest = base.schema["rest"].dataType.simpleString()

    digest = F.md5(F.col("text").cast("binary"))
    digests = base.filter("text is not null").select("id", "mark", digest.alias("digest"))
    groups = digests.groupBy("digest").agg(F.min("id").alias("lowest"), F.max("id").alias("highest"))
    copies = (digests.join(groups.filter("lowest < highest"), "digest").filter("id > lowest")
              .groupBy("mark").agg(F.collect_set("digest").alias("copied")))
    # all steps read this one join, so that one exchange of the texts serves them
    whole = base.join(copies, "mark", "left").select(
        *base.columns, F.when(F.col("copied").isNull() | F.col("text").isNull(), F.lit(False))
        .otherwise(F.array_contains("copied", digest)).alias("is_copy"))

    shared = whole.mapInArrow(_anchor_rows, "g long, place int, mark long") \
        .withColumn("n", F.count("*").over(Window.partitionBy("g"))).filter("n > 1 or place < 0")
    # sets: rows that agree in id and text find the same, and each gets it once
    places = shared.groupBy("mark").agg(F.collect_set(F.expr("if(place < 0, ~place, place)")).alias("places"))

    judged = whole.join(places, "mark").mapInArrow(_window_rows, "g long, at long, id long, mark long, length int")
    order = Window.partitionBy("g", F.expr("at & 4294967295")).orderBy("id", "at")
    repeats = judged.withColumn("rank", F.rank().over(order)).filter("rank > 1 or length > 0")
    runs = repeats.groupBy("mark").agg(F.collect_set(F.struct("at", "length", "id")).alias("runs"))

    cut = whole.join(runs, "mark", "left").mapInArrow(
        _cut_rows(form, ["rest"]), f"id long, text string, n_words long, n_removed long, rest {rest}")
    named = cut.withColumnRenamed("text", text) if text != "text" else cut
    return support.unpacked(named, "rest", text, "n_words", "n_removed")
