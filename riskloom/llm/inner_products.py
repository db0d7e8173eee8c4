"""Exact top-k by inner product: vectors in descending length, rotated partial sums, Cauchy-Schwarz bounds.

All rows give one matrix of second moments, whose eigenvectors (the right singular vectors of the table) turn the
vectors so that the first components hold most of the length.  Vectors are range-sorted by descending length and packed
into blocks.  Blocks are dealt round robin to stripes, and every group of queries meets every stripe in one task, which
reads the stripe's blocks in order:

* a block whose longest vector cannot reach a query's k-th score is not looked at by that query, and once this holds
  for all queries of the group the rest of the stripe is passed over;
* within a block the sum over the first rotated components plus the product of the lengths of what is left
  (Cauchy-Schwarz) bounds a score; queries, vectors and at last pairs that cannot reach the k-th score drop out;
* pairs that are left get their score from the integers themselves, so rounding in the rotation never decides.

A task holds one group of queries (``QUERY_ROWS``) and one block; nothing is shipped whole.  Only the best of each
stripe leave a task.  Pairs exist inside numpy blocks only; when the data prunes nothing, the cost is that of the
products.

Defined cases.  A component x becomes floor(scale * x) in doubles.  Vectors that are null, hold a null or a component
that is not finite, and rows without id take no part.  Missing components of shorter vectors count as 0.  Each row
with a query's id is a query of its own; of its candidates exactly its own row is left out, so a copy of it stays.
Ties go to the smaller id.  An empty table, or one without queries, gives no rows.  Scores are exact
integers at any size, held to the range of 64 bits.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import support

SCALE = 1024
BLOCK_ROWS = 512       # vectors of a packed block
QUERY_ROWS = 8192      # queries that a task holds
STRIPE_ROWS = 4096     # a stripe is not made smaller than this
STEPS = 4              # parts in which the rotated components are added up
SPARSE = 0.02          # share of living pairs below which they are scored one by one
LOWEST = -(1 << 63)
_KINDS = (np.int8, np.int16, np.int32, np.float64)

PACK = "block long, first double, size int, width int, kind int, ids binary, vectors binary"
HIT = "query long, query_id long, vec_id long, score long, own long"


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x), shorter vectors filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max()) if len(sizes) else 0
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _moments(scale: float, width: int):
    """Second moments of a task's vectors, a row per pair of components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            part = _matrix(batch.column("vector"), scale)
            longest = np.abs(part).max(initial=1.0)
            part = part / longest  # each batch weighs its largest component as 1: huge values cannot overflow
            total[:part.shape[1], :part.shape[1]] += part.T @ part
        rows, cols = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)),
                                          pa.array(total[rows, cols])], names=["i", "j", "v"])
    return run


def rotation(vectors: DataFrame, scale: float, width: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the right singular vectors, strongest first; ``width`` squared numbers."""
    sums = vectors.select("vector").mapInArrow(_moments(scale, width), "i int, j int, v double") \
        .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row per pair of components
    moments = np.zeros((width, width))
    for r in sums:
        moments[r["i"], r["j"]] = moments[r["j"], r["i"]] = r["v"]
    return np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


def _lengths(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.sqrt((_matrix(batch.column("vector"), scale) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], names=[*batch.schema.names, "length"])
    return run


def _packer(scale: float, rows: int):
    """Packs a sorted partition into blocks of ``rows`` vectors; integers are stored as narrow as they fit."""
    def packed(part: int, number: int, table: pa.Table) -> pa.RecordBatch:
        values = _matrix(table.column("vector"), scale)
        top = np.abs(values).max(initial=0.0)
        kind = next(i for i, k in enumerate(_KINDS) if i == 3 or top < np.iinfo(k).max)
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(part << 32) + number], pa.int64()), "first": [float(table.column("length")[0].as_py())],
            "size": pa.array([len(ids)], pa.int32()), "width": pa.array([values.shape[1]], pa.int32()),
            "kind": pa.array([kind], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
            "vectors": pa.array([values.astype(_KINDS[kind]).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= rows:
                yield packed(part, number, held.slice(0, rows))
                held, number = held.slice(rows), number + 1
        if held is not None and held.num_rows:
            yield packed(part, number, held)
    return run


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    stored = np.frombuffer(row["vectors"], _KINDS[row["kind"]]).astype(np.float64).reshape(row["size"], row["width"])
    if row["width"] == width:
        return ids, stored
    values = np.zeros((len(ids), width))
    values[:, :row["width"]] = stored
    return ids, values


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of matching rows; doubles while all sums are below 2**53, else Python's integers."""
    most = np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0) * max(left.shape[1], 1)
    if most < 2.0 ** 53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(left.tolist(), right.tolist())]
    return np.array([min(max(s, LOWEST), -LOWEST - 1) for s in sums], np.int64)


class QueryGroup:
    """The queries of one task with their best ``k`` scores so far."""

    def __init__(self, rows: list[dict], turn: np.ndarray, k: int):
        width = len(turn)
        parts = [_unpacked(r, width) for r in rows]
        self.turn, self.k = turn, k
        self.numbers = np.concatenate([r["block"] * (1 << 20) + np.arange(r["size"]) for r in rows])
        self.ids = np.concatenate([p[0] for p in parts])
        self.exact = np.concatenate([p[1] for p in parts])
        self.turned = self.exact @ turn
        self.edges = np.unique(np.linspace(0, width, STEPS + 1).astype(int))
        self.rest = [np.sqrt((self.turned[:, e:] ** 2).sum(axis=1)) for e in self.edges]
        self.scores = np.full((len(self.ids), k), LOWEST, np.int64)
        self.found = np.full((len(self.ids), k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros(len(self.ids), np.int64)
        self.compared = self.pairs = 0  # pairs scored exactly, and pairs there were

    def limits(self) -> np.ndarray:
        """The score that a vector must reach: the k-th so far."""
        return np.where(self.filled >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def done(self, longest: float) -> bool:
        """Whether no vector of that length or less can enter any list."""
        return bool((self.rest[0] * longest * (1 + 1e-9) + 1 < self.limits()).all())

    def meet(self, ids: np.ndarray, exact: np.ndarray) -> None:
        self.pairs += len(self.ids) * len(ids)
        limit = self.limits()
        length = np.sqrt((exact ** 2).sum(axis=1))
        rows = np.flatnonzero(self.rest[0] * length.max(initial=0.0) * (1 + 1e-9) + 1 >= limit)
        cols = np.arange(len(ids))
        if not len(rows):
            return
        if np.isneginf(limit[rows]).all():  # nothing to prune by yet
            self._offer(*self._dense(rows, exact), ids, rows)
            return
        turned = exact @ self.turn
        sums = np.zeros((len(rows), len(cols)))
        for lo, hi, left in zip(self.edges, self.edges[1:], self.rest[1:]):
            sums += self.turned[rows, lo:hi] @ turned[cols, lo:hi].T
            beyond = np.sqrt((turned[cols, hi:] ** 2).sum(axis=1))
            slack = 1 + 1e-9 * np.outer(self.rest[0][rows], length[cols])  # rounding of the rotation
            alive = sums + np.outer(left[rows], beyond) + slack >= limit[rows, None]
            if alive.mean() < SPARSE:
                break
            live_rows, live_cols = alive.any(axis=1), alive.any(axis=0)
            if not (live_rows.all() and live_cols.all()):
                rows, cols = rows[live_rows], cols[live_cols]
                sums, alive = sums[live_rows][:, live_cols], alive[live_rows][:, live_cols]
        at, place = np.nonzero(alive)
        at, place = rows[at], cols[place]
        self._offer(at, place, exact_scores(self.exact[at], exact[place]), ids, rows)

    def _dense(self, rows: np.ndarray, exact: np.ndarray):
        """All pairs of a block, of which only those are kept that may be among a query's best k."""
        left = self.exact[rows]
        if np.abs(left).max(initial=0.0) * np.abs(exact).max(initial=0.0) * max(exact.shape[1], 1) < 2.0 ** 53:
            scores = left @ exact.T
            k = min(self.k, scores.shape[1])
            low = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            at, place = np.nonzero(scores >= low[:, None])
            return rows[at], place, scores[at, place].astype(np.int64)
        at, place = np.repeat(np.arange(len(rows)), len(exact)), np.tile(np.arange(len(exact)), len(rows))
        return rows[at], place, exact_scores(left[at], exact[place])

    def _offer(self, at: np.ndarray, place: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(at)
        rows = np.unique(at)
        if not len(rows):
            return
        held = np.arange(self.k)[None, :] < self.filled[rows, None]
        old = np.repeat(rows, self.filled[rows])
        query = np.concatenate([old, at])
        score = np.concatenate([self.scores[rows][held], scores])
        name = np.concatenate([self.found[rows][held], ids[place]])
        order = np.lexsort((name, -score.astype(np.float64) if score.min(initial=0) == LOWEST else -score, query))
        query, score, name = query[order], score[order], name[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        query, rank = query[best], rank[best]
        self.scores[query, rank], self.found[query, rank] = score[best], name[best]
        self.filled[rows] = np.bincount(query, minlength=rows[-1] + 1)[rows]

    def result(self) -> pa.RecordBatch:
        held = np.arange(self.k)[None, :] < self.filled[:, None]
        query = np.repeat(np.arange(len(self.ids)), self.filled)
        own = exact_scores(self.exact, self.exact)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.numbers[query], self.ids[query], self.found[held], self.scores[held], own[query])],
            names=["query", "query_id", "vec_id", "score", "own"])


def _searched(turn: np.ndarray, k: int):
    """Reads packed rows ordered by group, side (queries first) and descending length; one group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, group, over = None, [], None, False
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (row["query_group"], row["stripe"]) != key:
                    if group is not None:
                        yield group.result()
                    key, waiting, group, over = (row["query_group"], row["stripe"]), [], None, False
                if not row["side"]:
                    waiting.append(row)
                    continue
                if group is None and waiting:
                    group, waiting = QueryGroup(waiting, turn, k), []
                if group is not None and not over:
                    over = group.done(row["first"])
                    if not over:
                        group.meet(*_unpacked(row, len(turn)))
        if group is not None:
            yield group.result()
    return run


def _packs(vectors: DataFrame, scale: float, rows: int, parts: int | None = None) -> DataFrame:
    """Blocks of vectors in descending length; ids and row numbers keep equal lengths from meeting in one range."""
    sized = vectors.withColumn("spread", F.monotonically_increasing_id()).mapInArrow(
        _lengths(scale), "vec_id long, vector array<double>, spread long, length double")
    order = [F.col("length").desc(), F.col("vec_id"), F.col("spread")]
    ranged = sized.repartitionByRange(parts, *order) if parts else sized.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).mapInArrow(_packer(scale, rows), PACK)


def top_inner_products(vectors: DataFrame, queries: Column | str, k: int = 10, scale: float = SCALE,
                       vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
                       query_rows: int = QUERY_ROWS, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best candidates of every query.

    ``queries`` is a condition on ``vec_id``; all other rows, and all queries but the row itself, are candidates.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    scratch = support.Scratch(spark)
    narrow = vectors.select(support.col(vec_id).cast("long").alias("vec_id"),
                            support.col(vector).cast("array<double>").alias("vector")) \
        .filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    asked = F.expr(queries) if isinstance(queries, str) else queries
    rows, wanted, width = narrow.agg(F.count("*"), F.count_if(asked), F.max(F.size("vector"))).first()
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    turn = rotation(narrow, scale, width)
    groups = -(-wanted // query_rows)
    spread = 4 * max(1, spark.sparkContext.defaultParallelism)
    stripes = max(1, min(-(-rows // stripe_rows), -(-spread // groups)))
    try:
        asking = scratch.table(_packs(narrow.filter(asked), scale, min(block_rows, query_rows), groups), "query-packs")
        group, before, numbered = 0, 0, []
        for block, size in asking.select("block", "size").orderBy("block").collect():  # a row per pack of queries
            if before and before + size > query_rows:
                group, before = group + 1, 0
            numbered.append((block, group, len(numbered)))
            before += size
        groups = group + 1
        placed = asking.join(F.broadcast(spark.createDataFrame(
            numbered, "block long, query_group int, pack long")), "block").drop("block").withColumnRenamed("pack", "block")
        every_stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
        every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        names = [c.split(" ")[0] for c in PACK.split(", ")]
        left = placed.select("query_group", every_stripe.alias("stripe"), F.lit(0).alias("side"), *names)
        dealt = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(stripes))
        right = _packs(narrow, scale, block_rows).select(
            every_group.alias("query_group"), dealt.cast("int").alias("stripe"), F.lit(1).alias("side"), *names)
        met = left.unionByName(right).repartition("query_group", "stripe").sortWithinPartitions(
            "query_group", "stripe", "side", F.col("first").desc(), "block")
        # one more than asked for: the query's own row is among them
        found = scratch.table(met.mapInArrow(_searched(turn, k + 1), HIT), "stripe-hits")
        result = scratch.kept(_ranked(found, k), "top-products")
    finally:
        scratch.clear()
    return result


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` over all stripes without the query's own row."""
    by = Window.partitionBy("query")
    best = found.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), "vec_id"))) \
        .filter(F.col("rank") <= k + 1)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    first = F.row_number().over(Window.partitionBy("query", itself).orderBy("rank"))
    others = best.withColumn("copy", first).filter(~(itself & (F.col("copy") == 1)))
    ranked = others.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
