"""Document fingerprints: the bottom-k sketch of a text's shingle hashes.

The ``k`` smallest of the 64-bit hashes of all distinct five-word shingles, cut to their upper 32 bits.  Sketches
merge (the k smallest of both), and from two of them follow resemblance, containment and the number of distinct
shingles.  A sketch of fewer than ``k`` values is the whole set.

``edited_neighbours`` also fingerprints each text with its last third replaced by the head of the next document in
descending id.  Texts are dealt into ranges once; the ranges' bounds are quantiles of the ids, and of a hash of the text
where one id (or none) has many rows; the first document of each range also goes to the range before it, so every
document meets its successor inside a task.

Defined cases.  A text with fewer words than a shingle is one shingle; a null or wordless text has an empty sketch.
Two empty sketches resemble each other by 1, an empty and another by 0.  A null id is the smallest; rows with equal
ids are ordered by a hash of the text.  A single row is its own next one; an empty table gives no rows.  A text of
any length is sketched whole, in pieces.  Extra columns pass through ``fingerprint`` unless an output column has their
name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.textbytes import SPACES, WordHasher, joined, slices, utf8

K = 128
WORDS = 5


def bottom(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of a sorted set of 64-bit hashes."""
    return np.unique((shingles[:k] >> np.uint64(32)).astype(np.uint32))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0 ** 32)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that is in the second."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` and ``n_distinct`` (estimated number of distinct shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES)
        for batch in batches:
            for part in slices(batch, "text"):
                sketches = [bottom(s, k) for s in hasher.shingle_sets(*utf8(part.column("text")), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), part.column("text"), pa.array([to_text(s) for s in sketches], pa.string()),
                     pa.array([distinct_count(s, k) for s in sketches], pa.float64())],
                    names=["rest", "text", "fingerprint", "n_distinct"])

    source = docs.select(support.packed(docs, text).alias("rest"), support.col(text).alias("text"))
    kind = source.schema["rest"].dataType.simpleString()
    found = source.mapInArrow(run, f"rest {kind}, text string, fingerprint string, n_distinct double")
    named = found.withColumnRenamed("text", text) if text != "text" else found
    return support.unpacked(named, "rest", text, "fingerprint", "n_distinct")


def resemblances(pairs: DataFrame, left: str, right: str, name: str = "resemblance", k: int = K) -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns."""
    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else resemblance(from_text(x), from_text(y), k)
                          for x, y in zip(a, b)], dtype="float64")
    return pairs.withColumn(name, likeness(support.col(left), support.col(right)))


def merged(fingerprints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint per key: the k smallest distinct values, ranked before and after the shuffle."""
    values = fingerprints.select(*by, F.explode(_values("fingerprint")).alias("value")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("value"))
    lowest = values.withColumn("rank", rank).filter(F.col("rank") <= k)

    @F.pandas_udf("string")
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: to_text(np.asarray(v, np.int64).astype(np.uint32)))
    return lowest.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("values")) \
        .select(*by, pack("values").alias("fingerprint"))


def _values(column: str):
    @F.pandas_udf("array<long>")
    def unpack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: from_text(t or "").astype(np.int64))
    return unpack(column)


ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def edited_neighbours(docs: DataFrame, k: int = K, words: int = WORDS, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and its edited text, and the likeness to these and to the next one."""
    rows = docs.select(support.col(doc_id).cast("long").alias("doc_id"), support.col(text).alias("text"),
                       F.coalesce(support.col(doc_id).cast("long"), F.lit(support.NO_ID)).alias("key"),
                       F.xxhash64(support.col(text)).alias("hash"))
    cuts = Cuts(rows, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(cuts.ranges(key.to_numpy(np.int64), hashed.to_numpy(np.int64)))

    place = range_of("key", "hash")
    first = F.struct((-F.col("key").cast("decimal(20,0)")).alias("turned"), "hash", "key")
    heads = rows.select(place.alias("range"), first.alias("first")).groupBy("range").agg(F.min("first").alias("head"))
    heads = sorted((h["range"], (h["head"]["key"], h["head"]["hash"])) for h in heads.collect())  # a row per range
    before = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def also_to(key: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series([[before[row]] if row in before else [] for row in zip(key, hashed)], dtype=object)

    own = F.array(F.struct(place.alias("range"), F.lit(0).alias("copy")))
    more = F.transform(also_to("key", "hash"), lambda r: F.struct(r.alias("range"), F.lit(1).alias("copy")))
    dealt = rows.select("doc_id", "text", "key", "hash", F.explode(F.concat(own, more)).alias("to")).select(
        "doc_id", "text", "key", "hash", "to.range", "to.copy")
    order = ["range", "copy", F.col("key").desc(), "hash"]
    ordered = dealt.repartition("range").sortWithinPartitions(*order).select("doc_id", "text", "range", "copy")
    return ordered.mapInArrow(_neighbour_rows(k, words), ROW)


class Cuts:
    """Bounds of ranges of rows in descending ``key``, then ascending ``hash``; a higher range comes earlier.

    They are quantiles of the keys.  A key that takes up several quantiles is cut again at quantiles of the hash, as
    often as it was met.
    """

    def __init__(self, rows: DataFrame, ranges: int):
        shares = [i / ranges for i in range(1, ranges)]
        found = rows.agg(F.percentile_approx("key", shares, 10 * ranges)).first()[0]
        self.keys, times = np.unique(np.array(found or [], np.int64), return_counts=True)
        frequent = self.keys[times > 1].tolist()  # half as many as ranges at most
        cut = rows.filter(F.col("key").isin(frequent)).groupBy("key").agg(F.percentile_approx("hash", shares, 10 * ranges)) \
            .collect() if frequent else []
        self.inside = {}
        for key, hashes in cut:
            parts = int(times[np.searchsorted(self.keys, key)])
            self.inside[key] = np.unique([hashes[len(hashes) * i // parts] for i in range(1, parts)])
        own = [len(self.inside[k]) + 1 if k in self.inside else 0 for k in self.keys.tolist()]
        self.start = np.concatenate([[0], np.cumsum(np.array(own, np.int64) + 1)])

    def ranges(self, key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        out = self.start[at]
        for name, bounds in self.inside.items():
            mine = key == name
            out[mine] += 1 + len(bounds) - np.searchsorted(bounds, hashed[mine])
        return out.astype(np.int32)


def _neighbour_rows(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = WordHasher(SPACES), None
        for batch in batches:
            for part in slices(batch, "text"):
                pairs, texts = [], [t or "" for t in part.column("text").to_pylist()]
                sketches = [bottom(s, k) for s in hasher.shingle_sets(*utf8(part.column("text")), words)]
                meta = zip(part.column("doc_id").to_pylist(), part.column("range").to_pylist(),
                           part.column("copy").to_pylist())
                for (name, place, copy), content, sketch in zip(meta, texts, sketches):
                    if last is not None and last[1] == place and not last[2]:
                        pairs.append((last, content, sketch))
                    last = (name, place, copy, content, sketch)
                if pairs:
                    yield _compared(pairs, hasher, k, words)
    return run


def _compared(pairs: list, hasher: WordHasher, k: int, words: int) -> pa.RecordBatch:
    edited = []
    for (_, _, _, content, _), following, _ in pairs:
        third = len(content) // 3
        edited.append((content[:len(content) - third] + following[:third]).encode())
    sketches = [bottom(s, k) for s in hasher.shingle_sets(*joined(edited), words)]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([p[0][0] for p in pairs], pa.int64()),
        "n_chars": pa.array([len(p[0][3]) for p in pairs], pa.int64()),
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [to_text(p[0][4]) for p in pairs],
        "edited_fingerprint": [to_text(s) for s in sketches],
        "near_edited": [resemblance(p[0][4], s, k) for p, s in zip(pairs, sketches)],
        "near_next": [resemblance(p[0][4], p[2], k) for p in pairs]})
