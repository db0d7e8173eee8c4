"""MinHash near-dedup with SetSketch registers.

Each document's shingle set is summarised by registers that hold exponentially spaced, truncated minima: register i
is ``floor(1 - log_b x)`` of the smallest exponential value x that hash i gives to a shingle, kept in ``0..q+1``.
Registers of two parts merge by their maximum.  Equal registers become likelier with resemblance, so bands of
register values are the candidate search; a maximum-likelihood estimate from the joint order of the registers drops
pairs that are far too different; the rest is confirmed on the full shingle sets.

No group is ever expanded into its pairs.  Equal sets collapse to one representative first.  A bucket then gives
star pairs (member, smallest member).  Buckets that still hold several components then join the members outside their
largest component with those of other components, and keep only pairs that can reach the limit by two exact bounds
(shingles that nobody else has, and the bits in which two signatures differ).  So a large group of near copies costs
pairs in proportion to its members, and no link that the bands have found is lost.

Defined cases.  Words are lower-cased in A-Z only.  A text with fewer words than a shingle is one shingle; a null or
wordless text has an empty set and links with nothing.  Rows with the same ``doc_id`` are one document: a link of any
of its rows counts.  Rows without ``doc_id`` take no part: their component is null and they are kept.  Extra columns
are not read by the search and pass through ``drop_near_duplicates`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.textbytes import SPACES, WordHasher, mix64, slices, utf8
from riskloom.operators.links import connected_components

BASE, RATE, LEVELS = 1.01, 20.0, 4094
BANDS, ROWS = 42, 6
BUCKET_ROWS = 20_000  # members of a bucket that meet a stranger in one task
SIGNATURE = [f"s{k}" for k in range(8)]


class SetSketch:
    """Registers of a set of 64-bit hashes."""

    def __init__(self, registers: int):
        seeds = mix64(np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factor = (seeds >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.shift = seeds.astype(np.uint32)[:, None]

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        values = (hashes >> np.uint64(32)).astype(np.uint32)
        lowest = np.full(len(self.factor), np.uint32(0xFFFFFFFF))
        for at in range(0, len(values), 512):
            drawn = self.factor * values[None, at:at + 512]
            drawn += self.shift
            np.minimum(lowest, drawn.min(axis=1), out=lowest)
        exponential = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
        level = np.floor(1.0 - np.log(exponential) / math.log(BASE))
        return np.clip(level, 0, LEVELS + 1).astype(np.uint16)


def merge_registers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def likely_resemblance(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood resemblance of many pairs from their registers (rows) and set sizes.

    The counts of larger, smaller and equal registers are multinomial with probabilities that depend on the
    resemblance; the likelihood is evaluated on a grid of 200 values.
    """
    above, below = (left > right).sum(axis=1)[:, None], (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - above - below
    u = (n_left / np.maximum(n_left + n_right, 1))[:, None]
    v = 1.0 - u
    most = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    j = most * np.linspace(0.0, 1.0, 201)[None, :]

    def probability(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)

    more, less = probability(u - v * j), probability(v - u * j)
    tiny = 1e-12
    likelihood = (above * np.log(more + tiny) + below * np.log(less + tiny)
                  + equal * np.log(np.maximum(1.0 - more - less, tiny)))
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketch(docs: DataFrame, words: int = 4, registers: int = BANDS * ROWS, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``(id, n_shingles, set_a, set_b, registers)`` of each row; the two 64-bit sums identify the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketcher = WordHasher(SPACES, fold_case=True), SetSketch(registers)
        other = WordHasher(SPACES, fold_case=True, seed=1)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = hasher.shingle_sets(*utf8(part.column("text")), words)
                with np.errstate(over="ignore"):
                    first, second = ([int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in both]
                                     for both in (sets, other.shingle_sets(*utf8(part.column("text")), words)))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array([sketcher.registers(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                    names=["id", "n_shingles", "set_a", "set_b", "registers"])

    narrow = docs.select(support.col(doc_id).cast("long").alias("id"), support.col(text).alias("text"))
    return narrow.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, registers binary")


def _likely(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """Pairs whose estimated resemblance is not below ``floor``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16)
                               .reshape(part.num_rows, -1) for c in ("registers", "registers_v"))
                sizes = [part.column(c).to_numpy(zero_copy_only=False) for c in ("n_shingles", "n_shingles_v")]
                good = likely_resemblance(left, right, *sizes) >= floor
                yield part.select(["u", "v"]).filter(pa.array(good))

    one = sketches.select(F.col("id").alias("u"), "n_shingles", "registers")
    two = sketches.select(F.col("id").alias("v"), F.col("n_shingles").alias("n_shingles_v"),
                          F.col("registers").alias("registers_v"))
    return pairs.join(one, "u").join(two, "v").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` on their full shingle sets.

    Both of two independent hashes have to say so: shingles that are equal in one by chance are not in the other.
    """
    def similar(hasher: WordHasher, part: pa.RecordBatch) -> pa.RecordBatch:
        left = hasher.shingle_sets(*utf8(part.column("text")), words)
        right = hasher.shingle_sets(*utf8(part.column("text_v")), words)
        good = []
        for a, b in zip(left, right):
            shared = len(np.intersect1d(a, b, assume_unique=True))
            good.append(shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared))
        return part.filter(pa.array(good, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [WordHasher(SPACES, fold_case=True, seed=seed) for seed in (0, 1)]
        for batch in batches:
            for part in slices(batch, "text"):
                for hasher in hashers:
                    part = similar(hasher, part)
                yield part.select(["u", "v"])

    one = texts.select(F.col("id").alias("u"), "text")
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(one, "u").join(two, "v").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked id) and ``kept``.

    With 42 bands of 6 registers a pair at exactly 0.8 is missed with a probability of 3e-6.
    """
    scratch = support.Scratch(docs.sparkSession)
    try:
        return scratch.kept(_components(docs, scratch, words, percent, bands, rows, doc_id, text), "near-duplicates")
    finally:
        scratch.clear()


def _components(docs: DataFrame, scratch: support.Scratch, words: int, percent: int, bands: int, rows: int, doc_id: str,
                text: str) -> DataFrame:
    drawn = scratch.table(sketch(docs, words, bands * rows, doc_id, text), "sketches")
    usable = drawn.filter("id is not null and n_shingles > 0")
    keys = ["set_a", "set_b", "n_shingles"]
    classes = scratch.table(usable.groupBy(*keys).agg(F.min(F.struct("id", "registers")).alias("r"))
                            .select(*keys, F.col("r.id").alias("rep"), "r.registers"), "classes")
    members = scratch.table(usable.select("id", *keys).join(classes.select("rep", *keys), keys).select("id", "rep"),
                          "members")
    sketches = classes.select(F.col("rep").alias("id"), "n_shingles", "registers")

    width = 2 * rows
    banded = sketches.select("id", F.posexplode(F.array(*[
        F.xxhash64(F.substring("registers", 1 + width * i, width)) for i in range(bands)])).alias("band", "key"))
    leaders = banded.groupBy("band", "key").agg(F.min("id").alias("lead"), F.max("id").alias("last")) \
        .filter("lead < last").select("band", "key", "lead")
    buckets = scratch.table(banded.join(leaders, ["band", "key"]).select("band", "key", "id", "lead"), "buckets")
    # only documents that share a bucket move from here on
    wanted = scratch.table(buckets.select("id").distinct(), "bucket-ids")
    whole = docs.select(support.col(doc_id).cast("long").alias("id"), support.col(text).alias("text"))
    texts = scratch.table(support.parted_by_ids(whole, F.col("id"), wanted)[0].join(wanted, "id"), "texts")
    sketches = scratch.table(support.parted_by_ids(sketches, F.col("id"), wanted)[0].join(wanted, "id"), "bucket-sketches")

    floor = percent / 100 - 5 * math.sqrt(0.2 * percent / 100 / (bands * rows))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.table(_confirmed(_likely(pairs, sketches, floor), texts, words, percent), name)

    def still_open(groups: DataFrame) -> DataFrame:
        """Members, with their components, of the buckets that hold several components."""
        placed = buckets.join(groups, F.col("id") == F.col("node"), "left") \
            .select("band", "key", "id", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
            .filter("low < high").select("band", "key")
        return placed.join(mixed, ["band", "key"])

    star = scratch.table(buckets.filter("id > lead").select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct(),
                       "star-pairs")
    links = scratch.table(confirmed(star, "links").unionByName(_shared_ids(members)), "all-links")
    groups = scratch.table(connected_components(links), "groups")

    unsettled = still_open(groups)
    facts = scratch.table(_open_facts(texts.join(unsettled.select("id").distinct(), "id"), words), "open-documents")
    unsettled = scratch.table(unsettled.join(facts, "id"), "open-buckets")
    crossing = _possible(_met(unsettled), percent).join(star, ["u", "v"], "left_anti")
    groups = _joined(groups, confirmed(crossing, "last-links"))

    component = members.join(groups, F.col("rep") == F.col("node"), "left") \
        .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return drawn.select("id", "n_shingles").join(component, "id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))


def _open_facts(texts: DataFrame, words: int) -> DataFrame:
    """``(id, n, own, s0 ... s7)`` of documents: size of the set, how many of its shingles no other document here
    has, and 512 bits that hold the parity of the number of shingles that fall on each bit."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES, fold_case=True)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = hasher.shingle_sets(*utf8(part.column("text")), words)
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))],
                                                 names=["id", "shingle"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES, fold_case=True)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = hasher.shingle_sets(*utf8(part.column("text")), words)
                odd = np.array([np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1 for s in sets],
                               np.uint8)
                bits = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                     *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(8)]], names=["id", "n", *SIGNATURE])

    narrow = texts.select("id", "text")
    alone = narrow.mapInArrow(shingles, "id long, shingle long").groupBy("shingle") \
        .agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last") \
        .groupBy("id").agg(F.count("*").alias("own"))
    rows = narrow.mapInArrow(signed, "id long, n long, " + ", ".join(f"{s} long" for s in SIGNATURE)).groupBy("id").agg(
        F.count("*").alias("rows"), F.min("n").alias("n"), *[F.min(s).alias(s) for s in SIGNATURE])
    one = F.col("rows") == 1  # an id with several rows has several sets, to which no bound applies
    return rows.join(alone, "id", "left").select(
        "id", F.when(one, F.col("n")).otherwise(0).alias("n"),
        F.when(one, F.coalesce("own", F.lit(0))).otherwise(-(1 << 40)).alias("own"),
        *[F.when(one, F.col(s)).alias(s) for s in SIGNATURE])


def _met(members: DataFrame) -> DataFrame:
    """Members of a bucket outside its largest component with all its members of other components, each pair once.

    So a large component costs its size for every stranger in its bucket, never its square; large buckets are cut by
    a hash of the member.
    """
    bucket = ["band", "key"]
    sizes = members.groupBy(*bucket, "component").agg(F.count("*").alias("size")).groupBy(*bucket).agg(
        F.max(F.struct("size", "component"))["component"].alias("main"),
        F.ceil(F.sum("size") / BUCKET_ROWS).cast("int").alias("salts"))
    placed = members.join(sizes, bucket)
    strangers = placed.filter("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    facts = [c for c in members.columns if c not in bucket]
    other = placed.select(*bucket, F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"),
                          (F.col("component") != F.col("main")).alias("stranger_v"), *[F.col(c).alias(f"{c}_v") for c in facts])
    return strangers.join(other, [*bucket, "salt"]).filter("component <> component_v and (id > id_v or not stranger_v)")


def _possible(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can still be similar enough; no pair above the limit is lost.

    Two bounds on the number of shared shingles: those that neither document has alone, and what the bits leave
    room for, since every bit in which they differ is a shingle that only one of them has.
    """
    differ = " + ".join(f"bit_count({s} ^ {s}_v)" for s in SIGNATURE)
    shared = f"least(n - own, n_v - own_v, coalesce((n + n_v - ({differ})) div 2, {1 << 40}))"
    return met.filter(f"100 * {shared} >= {percent} * (n + n_v - {shared})") \
        .select(F.greatest("id", "id_v").alias("u"), F.least("id", "id_v").alias("v")).distinct()


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if links.isEmpty():
        return groups
    whole = groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)
    return connected_components(whole)


def _shared_ids(members: DataFrame) -> DataFrame:
    """Links between the representatives of all rows that share a ``doc_id``."""
    lowest = members.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).filter("v < top")
    return members.join(lowest.select("id", "v"), "id").filter("rep > v") \
        .select(F.col("rep").alias("u"), "v").distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked to a smaller ``doc_id``; columns unchanged."""
    gone = near_duplicates(docs, words, percent, doc_id=doc_id, text=text).filter("not kept") \
        .select(F.col("doc_id").alias("gone_id")).distinct()
    own = support.col(doc_id).cast("long")
    doubtful, safe = support.parted_by_ids(docs, own, gone)
    return safe.unionByName(doubtful.join(gone, own == F.col("gone_id"), "left_anti"))
