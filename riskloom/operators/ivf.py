"""Inverted-file index of vectors: cells around centroids, a persisted table of members, probes, exact re-ranking.

``build`` fits the centroids on a bounded sample (``SAMPLE_ROWS``; at most ``MOST_CELLS`` of them), but places every
vector.  The table has a row per vector with its cell, its block within the cell and its residual in bytes; large cells
have several blocks.  It is written once and read by every search, also from micro-batches.

Both kinds of search compare exactly only the vectors that bounds of their similarities leave among a query's best.  That
filter loses nothing; what a search can lose is decided by the probes alone:

* ``probes=n`` takes the ``n`` cells whose centroids are nearest, and what it finds is approximate.  Each query goes once to every
  group of blocks with a cell to probe, however many of its cells that are; residual codes bound the similarities from both sides;
* ``probes=None`` is exact.  Packed blocks of queries meet packed blocks of vectors in a Cartesian product, so nothing is copied
  to disk for what it meets.  A query passes over the cells that can hold nothing better than its k-th similarity so far, by
  the centroid and the radius of the cell (Cauchy-Schwarz); products in single precision bound the similarities in the others.

``counts`` of a search are the pairs scanned by their codes and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.similar import PART_BYTES, ROUNDING, _blocks, _matrix, _merged
from riskloom.session import materialise, new_folder, remove_folder

SAMPLE_ROWS = 20_000  # rows that the centroids are fitted on
MOST_CELLS = 4_096
BLOCK_ROWS = 4_096    # vectors of a block
GROUP_ROWS = 16_384   # vectors of a group of blocks, which meet queries in one task
QUERY_ROWS = 16_384   # queries that a group meets at once, about
PAIRS = 1 << 17       # pairs of a row and a cell that are held at once
MOST_PAIRS = 1 << 19  # pairs of a query and a vector that are held at once
ORDER_ROWS = 256      # queries by which the exact search orders the index; they change no result
SLACK = 1e-6          # more than rounding of single precision vectors can make up


def _flat(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix of their own precision."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _plain(ids) -> pd.Series:
    """Ids of any type as objects: pandas' own strings come in several pieces, which Arrow batches cannot hold."""
    return pd.Series(list(ids), dtype=object)


@dataclass(frozen=True)
class Index:
    """A persisted index; ``centroids`` has a row per cell and is small by construction."""
    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    blocks: np.ndarray
    radii: np.ndarray

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/members")


def build(vectors: DataFrame, path: str, key: str = "case_id", payload: str = "vector", cells: int | None = None,
          seed: int = 17) -> Index:
    """Writes the index of ``vectors`` below ``path``; vectors must be of one length, without nulls."""
    spark = vectors.sparkSession
    total = vectors.count()
    wanted = min(cells or max(1, round(total ** 0.5)), MOST_CELLS, max(total, 1))
    sample = vectors.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SAMPLE_ROWS)
    if wanted > 1:
        features = sample.select(array_to_vector(F.col(payload).cast("array<double>")).alias("features"))
        centroids = np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(features).clusterCenters())
    else:
        mean = sample.select(F.posexplode(payload).alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("value")).collect()
        centroids = np.array([[r["value"] for r in sorted(mean, key=lambda r: r["pos"])] or [0.0]])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centroids ** 2).sum(axis=1) / 2
        step = max(1, PAIRS // len(centroids))
        for batch in batches:
            if batch.empty:
                continue
            exact = _matrix(batch[payload])
            cell = np.concatenate([(exact[at:at + step] @ centroids.T - half).argmax(axis=1) for at in range(0, len(exact), step)])
            rest = exact - centroids[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.sqrt(((rest - codes * scale[:, None]) ** 2).sum(axis=1))
            yield pd.DataFrame({key: _plain(batch[key]), payload: batch[payload], "cell": cell.astype(np.int32),
                                "code": [c.tobytes() for c in codes], "scale": scale, "error": error,
                                "reach": np.sqrt((rest ** 2).sum(axis=1))})

    schema = T.StructType([vectors.schema[key], vectors.schema[payload], T.StructField("cell", T.IntegerType()),
                           T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()),
                           T.StructField("error", T.DoubleType()), T.StructField("reach", T.DoubleType())])
    rows = materialise(vectors.select(key, payload).mapInPandas(placed, schema), "index-cells")
    cell_rows = rows.groupBy("cell").agg(F.count("*").alias("size"), F.max("reach").alias("radius")) \
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
    table = cell_rows.collect()  # a row per cell
    members = rows.join(F.broadcast(cell_rows.select("cell", "blocks")), "cell").withColumn(  # at most MOST_CELLS rows
        "block", F.pmod(F.xxhash64(key), "blocks").cast("int")).drop("blocks", "reach")
    members.repartition("cell", "block").sortWithinPartitions("cell", "block").write.mode("overwrite").parquet(f"{path}/members")
    size, blocks, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in table:
        size[r["cell"]], blocks[r["cell"]], radius[r["cell"]] = r["size"], r["blocks"], r["radius"]
    spark.createDataFrame([(i, c.tolist(), int(size[i]), int(blocks[i]), float(radius[i])) for i, c in enumerate(centroids)],
                          "cell int, centroid array<double>, size long, blocks int, radius double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    index = Index(path, centroids, size, blocks, radius)
    # the same vectors packed, neighbouring cells together, for the exact search
    near = index.members(spark).select("cell", "block", key, payload).join(F.broadcast(_unit_rows(spark, index)), ["cell", "block"]) \
        .repartition("group").sortWithinPartitions("group", "place").withColumnsRenamed({key: "case_id", payload: "vector"})
    _blocks(near, ["case_id", "vector", "cell"], GROUP_ROWS, "cell").write.mode("overwrite").parquet(f"{path}/packed")
    return index


def load(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` wrote; only its table of cells is read here."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(path, *[np.array([r[c] for r in rows]) for c in ("centroid", "size", "blocks", "radius")])


def _units(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, block and group of all blocks, neighbouring cells together: a group has ``GROUP_ROWS`` vectors, about.

    The order is that of the centroids along the line on which they differ most.
    """
    live = np.flatnonzero(index.sizes > 0)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    centred = np.nan_to_num(index.centroids[live] - index.centroids[live].mean(axis=0))
    live = live[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
    cell = np.repeat(live, index.blocks[live])
    block = np.concatenate([np.arange(b) for b in index.blocks[live]])
    size = index.sizes[cell] / index.blocks[cell]
    _, group = np.unique((np.cumsum(size) - size) // GROUP_ROWS, return_inverse=True)
    return cell, block, group


def _unit_rows(spark: SparkSession, index: Index) -> DataFrame:
    """A row per block of a cell, with its group and its place there."""
    cell, block, group = _units(index)
    place = np.arange(len(group)) - np.searchsorted(group, group)
    return spark.createDataFrame([tuple(map(int, r)) for r in zip(cell, block, group, place)], "cell int, block int, group int, place int")


def _probed(queries: DataFrame, index: Index, first: int, limits: bool) -> DataFrame:
    """``queries`` once for each group with a cell to probe: the ``first`` cells, or all others that can beat ``limit``.

    ``cells`` has a bit for each block of the group.
    """
    live = index.sizes > 0
    cell, _, group = _units(index)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(starts[1:], len(group))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, PAIRS // max(1, len(cell), len(live)))
        for batch in batches:
            for at in range(0, len(batch) if len(cell) else 0, step):
                part = batch.iloc[at:at + step]
                exact = _matrix(part["vector"])
                near = np.where(live, exact @ index.centroids.T, -np.inf)
                take = np.zeros(near.shape, bool)
                np.put_along_axis(take, np.argsort(-near, axis=1, kind="stable")[:, :first], True, axis=1)
                if limits:
                    length = np.sqrt((exact ** 2).sum(axis=1))[:, None]
                    take = ~take & (near + length * index.radii + SLACK >= part["limit"].to_numpy()[:, None])
                take = (take & live)[:, cell]
                rows, bits, groups = [], [], []
                for number in np.flatnonzero(np.logical_or.reduceat(take, starts, axis=1).any(axis=0)).tolist():
                    mine = take[:, starts[number]:ends[number]]
                    row = np.flatnonzero(mine.any(axis=1))
                    rows.append(row)
                    bits.extend(b.tobytes() for b in np.packbits(mine[row], axis=1))
                    groups.append(np.full(len(row), number, np.int32))
                if rows:
                    out = part.iloc[np.concatenate(rows)].reset_index(drop=True)
                    yield pd.DataFrame({"query_id": _plain(out["query_id"]), "vector": out["vector"],
                                        "limit": out["limit"] if limits else -np.inf, "cells": bits, "group": np.concatenate(groups)})

    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("limit", T.DoubleType()),
                           T.StructField("cells", T.BinaryType()), T.StructField("group", T.IntegerType())])
    return queries.mapInPandas(probe, schema)


def _scan(probes: DataFrame, index: Index, k: int, query_blocks: int) -> DataFrame:
    """The best ``k`` of every group for every query that probes it, and a row of counts (``case_id`` NULL)."""
    spark = probes.sparkSession
    centroids = index.centroids
    units = _unit_rows(spark, index)
    asked = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    members = index.members(spark).join(F.broadcast(units), ["cell", "block"]).drop("block").withColumn(  # a row per block
        "part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    case_type = members.schema["case_id"].dataType
    kinds = {"query_id": object, "case_id": object, "similarity": np.float64, "scanned": np.int64, "compared": np.int64}

    def top(row: np.ndarray, col: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best ``k`` of every row, ties by id."""
        order = np.lexsort((ids[col], -similarity, row))
        row, col, similarity = row[order], col[order], similarity[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], col[keep], similarity[keep]

    def best(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({n: pd.Series([], dtype=kind) for n, kind in kinds.items()})
        m = m.sort_values("place", kind="stable")
        exact, ids, error = _matrix(m["vector"]), m["case_id"].to_numpy(), m["error"].to_numpy()
        codes = np.frombuffer(b"".join(m["code"]), np.int8).reshape(len(m), -1).astype(np.float64) * m["scale"].to_numpy()[:, None]
        places, lows = np.unique(m["place"].to_numpy(), return_index=True)
        wanted = np.unpackbits(np.frombuffer(b"".join(q["cells"]), np.uint8).reshape(len(q), -1), axis=1).astype(bool)
        asked_for, limit = _matrix(q["vector"]), q["limit"].to_numpy()
        length = np.sqrt((asked_for ** 2).sum(axis=1))
        scanned, compared = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        found = []
        for number, low, high in zip(places, lows, np.append(lows[1:], len(m))):
            rows, n = np.flatnonzero(wanted[:, number]), min(k, high - low)
            centre = centroids[int(m["cell"].iloc[low])]
            step = max(1, (16 << 20) // (8 * (high - low)))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                near = asked_for[part] @ codes[low:high].T + (asked_for[part] @ centre)[:, None]
                margin = length[part][:, None] * error[None, low:high] + SLACK
                reached = limit[part]
                if not np.isfinite(reached).all():  # n similarities are at least this
                    reached = np.maximum(reached, -np.partition(margin - near, n - 1, axis=1)[:, n - 1])
                able = near + margin >= reached[:, None]
                row, col = np.nonzero(able)
                similarity = np.round(np.einsum("ij,ij->i", asked_for[part[row]], exact[low + col]), ROUNDING)
                scanned[part] += high - low
                compared[part] += able.sum(axis=1)
                found.append(top(part[row], low + col, similarity, ids))
        row, col, similarity = top(*map(np.concatenate, zip(*found)), ids) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        names, none = q["query_id"].to_numpy(object), np.full(len(q), None)
        return pd.DataFrame({
            "query_id": _plain(np.concatenate([names[row], names])), "case_id": _plain(np.concatenate([ids[col].astype(object), none])),
            "similarity": np.concatenate([similarity, np.zeros(len(q))]),
            "scanned": np.concatenate([np.zeros(len(row), np.int64), scanned]),
            "compared": np.concatenate([np.zeros(len(row), np.int64), compared])})

    schema = T.StructType([probes.schema["query_id"], T.StructField("case_id", case_type), T.StructField("similarity", T.DoubleType()),
                           T.StructField("scanned", T.LongType()), T.StructField("compared", T.LongType())])
    return asked.groupBy("group", "part").cogroup(members.groupBy("group", "part")).applyInPandas(best, schema)


def _first(row: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of every row in order, ties by id; only ids that tie are compared."""
    order = np.lexsort((-similarity, row))
    row, similarity, ids = row[order], similarity[order], ids[order]
    equal = (row[1:] == row[:-1]) & (similarity[1:] == similarity[:-1])
    tied = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))
    if len(tied):
        ids[tied] = ids[tied[np.lexsort((ids[tied], -similarity[tied], row[tied]))]]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], similarity[keep], ids[keep]


class _Asked:
    """A block of queries and the best that was found for each so far."""

    def __init__(self, names: pa.Array, vectors: np.ndarray, index: Index, k: int):
        self.names, self.index, self.k = names, index, k
        self.exact, self.single = vectors.astype(np.float64), vectors.astype(np.float32)
        self.length = np.sqrt((self.exact ** 2).sum(axis=1))
        n = len(vectors)
        self.scanned, self.compared = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.row, self.similarity, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        # the k-th similarity is no less than the least that a cell of k vectors can have
        full = index.sizes >= k
        self.limit = np.full(n, -np.inf)
        step = max(1, PAIRS // len(index.sizes))
        for at in range(0, n if full.any() else 0, step):
            least = self.exact[at:at + step] @ index.centroids[full].T - self.length[at:at + step, None] * index.radii[full]
            self.limit[at:at + step] = least.max(axis=1) - 2 * 10.0 ** -ROUNDING

    def meet(self, cell: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Takes up the best of a block of vectors, whose cells follow one another."""
        exact, single = vectors.astype(np.float64), vectors.astype(np.float32, copy=False)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        near = self.exact @ self.index.centroids[cell[starts]].T + self.length[:, None] * self.index.radii[cell[starts]] + SLACK
        found, held = [], 0
        for number, (low, high) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])):
            rows = np.flatnonzero(near[:, number] >= self.limit)
            step = max(1, MOST_PAIRS // (high - low))
            # more than single precision can be off
            noise = (vectors.shape[1] + 4) * 2.0 ** -23 * np.sqrt((exact[low:high] ** 2).sum(axis=1).max())
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                about, off = self.single[part] @ single[low:high].T, noise * self.length[part] + 2.0 ** -22 * np.abs(self.limit[part])
                able = about >= (self.limit[part] - np.where(np.isfinite(off), off, 0))[:, None].astype(np.float32)
                if high - low > self.k and np.count_nonzero(able) > 2 * self.k * len(part):
                    kth = np.partition(about, high - low - self.k, axis=1)[:, high - low - self.k].astype(np.float64)
                    off = noise * self.length[part] + 2.0 ** -22 * np.abs(kth)
                    self.limit[part] = np.maximum(self.limit[part], kth - off - 2 * 10.0 ** -ROUNDING)
                    able = about >= (self.limit[part] - off)[:, None].astype(np.float32)
                row, col = np.divmod(np.flatnonzero(able), high - low)
                self.scanned[part] += high - low
                self.compared[part] += np.bincount(row, minlength=len(part))
                similarity = np.round(np.einsum("ij,ij->i", self.exact[part[row]], exact[low + col]), ROUNDING)
                found.append(_first(part[row], similarity, ids[low + col], self.k))
                held += len(found[-1][0])
                if held > MOST_PAIRS:
                    self._take(found)
                    found, held = [], 0
        self._take(found)

    def _take(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not any(len(f[0]) for f in found):
            return
        if self.ids is not None:
            found = [(self.row, self.similarity, self.ids), *found]
        self.row, self.similarity, self.ids = _first(*map(np.concatenate, zip(*found)), self.k)
        count = np.bincount(self.row, minlength=len(self.limit))
        full = np.flatnonzero(count == self.k)
        last = np.cumsum(count)[full] - 1
        self.limit[full] = np.maximum(self.limit[full], self.similarity[last] - 2 * 10.0 ** -ROUNDING)

    def answer(self, kind: pa.DataType) -> pa.RecordBatch:
        ends = np.insert(np.cumsum(np.bincount(self.row, minlength=len(self.limit))), 0, 0).astype(np.int32)
        ids = pa.array([] if self.ids is None else self.ids, kind, from_pandas=True)
        return pa.RecordBatch.from_arrays(
            [self.names, pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(self.similarity, pa.float64())),
             pa.array(self.scanned), pa.array(self.compared)], names=["query_id", "case_ids", "similarities", "scanned", "compared"])


def _rows(packed: pa.BinaryScalar) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.ipc.open_stream(packed.as_buffer()).read_all().columns]


def _met(queries: DataFrame, index: Index, k: int) -> tuple[DataFrame, int]:
    """Every query's best ``k`` in each part of the index, a row each, and the number of parts.

    Blocks of queries meet blocks of vectors in a Cartesian product, whose outer loop are the queries: neither side is copied to
    disk for the blocks that it meets, and a task has one block of each side in Python.
    """
    spark = queries.sparkSession
    packed = spark.read.parquet(f"{index.path}/packed")
    stored = packed.agg(F.sum(F.length("rows"))).first()[0] or 0
    parts = max(1, min(-(-stored // PART_BYTES), packed.rdd.getNumPartitions()))
    # cells near to a few of the queries come first, as they tell best what the others have to beat; the order changes no result
    some = [r["vector"] for r in queries.select("vector").limit(ORDER_ROWS).collect()] if index.sizes.any() else []
    score = (np.array(some, np.float64) @ index.centroids.T).mean(axis=0) if some else np.zeros(len(index.sizes))
    marked = packed.select("marks").distinct().collect()  # a row per block of vectors
    order = spark.createDataFrame([(r["marks"], float(score[r["marks"]].max())) for r in marked], "marks array<int>, score double")
    known = packed.join(F.broadcast(order), "marks").select("score", F.col("rows").alias("c")).coalesce(parts) \
        .sortWithinPartitions(F.desc("score")).select("c")
    tasks = 4 * spark.sparkContext.defaultParallelism
    asked = queries if queries.rdd.getNumPartitions() * 4 >= tasks else queries.repartition(tasks)
    left = _blocks(asked, ["query_id", "vector"], QUERY_ROWS).select(F.monotonically_increasing_id().alias("block"), F.col("rows").alias("q"))
    pairs = left.crossJoin(known.hint("shuffle_replicate_nl"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held = kind = None
        for batch in batches:
            for number, q, c in zip(batch.column("block").to_pylist(), batch.column("q"), batch.column("c")):
                if number != block:
                    if held is not None:
                        yield held.answer(kind)
                    names, vectors = _rows(q)
                    block, held = number, _Asked(names, _flat(vectors), index, k)
                ids, vectors, cell = _rows(c)
                kind = ids.type
                held.meet(cell.to_numpy(), _flat(vectors), ids.to_pandas().to_numpy())
        if held is not None:
            yield held.answer(kind)

    case_type = spark.read.parquet(f"{index.path}/members").schema["case_id"].dataType
    schema = T.StructType([queries.schema["query_id"], T.StructField("case_ids", T.ArrayType(case_type)),
                           T.StructField("similarities", T.ArrayType(T.DoubleType())),
                           T.StructField("scanned", T.LongType()), T.StructField("compared", T.LongType())])
    return pairs.mapInArrow(meet, schema), parts


def best(queries: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """Exact hits, a row per query (ids must differ): ``case_ids`` and ``similarities``, best first, ``scanned``, ``compared``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, path = queries.sparkSession, new_folder(queries.sparkSession, "index-queries")
    queries.select("query_id", "vector").write.parquet(path)
    found, parts = _met(spark.read.parquet(path), index, k)
    found = materialise(found, "index-hits")
    remove_folder(spark, path)
    if parts == 1:
        return found
    hit = F.arrays_zip(F.transform("similarities", lambda s: -s).alias("order"), F.col("case_ids").alias("case_id"))
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(hit))), 1, k).alias("hits"),  # k of each part
                                          F.sum("scanned").alias("scanned"), F.sum("compared").alias("compared"))
    return lists.select("query_id", F.col("hits.case_id").alias("case_ids"), F.transform("hits.order", lambda s: -s).alias("similarities"),
                        "scanned", "compared")


def search(queries: DataFrame, index: Index, k: int = 5, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (``query_id``, ``case_id``, ``similarity``, ``rank``) and counts (``query_id``, ``scanned``, ``compared``).

    ``queries`` has ``query_id`` and ``vector``.  Ties at six decimals go by id, as in the exact search.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = materialise(queries.select("query_id", "vector"), "index-queries")
    if probes is None:
        found = materialise(_met(queries, index, k)[0], "index-hits")
        each = found.select("query_id", F.explode(F.arrays_zip(F.col("case_ids").alias("case_id"), F.col("similarities").alias("similarity"))).alias("hit"))
        return _merged(each.select("query_id", "hit.case_id", "hit.similarity"), k), \
            found.groupBy("query_id").agg(F.sum("scanned").alias("scanned"), F.sum("compared").alias("compared"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    scanned = materialise(_scan(_probed(queries, index, probes, False), index, k, blocks), "index-hits")
    hits = _merged(scanned.filter("case_id is not null").select("query_id", "case_id", "similarity"), k)
    counts = scanned.filter("case_id is null").groupBy("query_id").agg(F.sum("scanned").alias("scanned"), F.sum("compared").alias("compared"))
    return hits, counts


def tuned_probes(queries: DataFrame, index: Index, k: int = 5, recall: float = 0.9, sample: int = 64) -> int:
    """The fewest probes with which ``sample`` queries keep ``recall`` of their exact hits, their own row aside."""
    chosen = materialise(queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "index-sample")
    exact, _ = search(chosen, index, k)
    placed = exact.filter(F.col("similarity") < 1 - 10.0 ** -ROUNDING).join(
        index.members(queries.sparkSession).select("case_id", "cell"), "case_id").join(chosen, "query_id") \
        .select("vector", "cell").collect()  # at most sample x k rows
    if not placed:
        return 1
    near = np.where(index.sizes > 0, np.array([r["vector"] for r in placed], np.float64) @ index.centroids.T, -np.inf)
    cell = np.array([r["cell"] for r in placed])
    rank = (near > near[np.arange(len(cell)), cell][:, None]).sum(axis=1)
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1
