"""Contiguous shards of near equal bytes from a global prefix sum.

Narrow rows (id, size, checksum) are range-sorted by id and written once.  The writing task adds up sizes within its
partition; one total per partition, a row each, is prefixed on the driver, so the start of every row in the whole
order is known without a global window.  The order is cut at ``total * k / shards``: a row belongs to the shard that
holds the middle of its bytes, so a shard misses the target by half a row at each end at most.

Defined cases.  Size is the UTF-8 length plus ``overhead``; a null text has length and checksum 0.  Rows are ordered
by id (null first), then by checksum; equal rows are interchangeable.  An empty table gives no rows.  Totals times
shards must stay below 2**62.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.session import materialise

SHARDS = 24
OVERHEAD = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the row's place in it and the bytes before the row."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        before = total + np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)),
             pa.array(rows + np.arange(len(sizes), dtype=np.int64)), pa.array(before.astype(np.int64))],
            names=[*batch.schema.names, "part", "place", "before"])
        rows, total = rows + len(sizes), total + int(sizes.sum())


def balanced_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 within its shard)."""
    content = F.coalesce(support.col(text), F.lit("")).cast("binary")
    narrow = docs.select(support.col(doc_id).cast("long").alias("doc_id"),
                         (F.length(content).cast("long") + overhead).alias("size"), F.crc32(content).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    placed = materialise(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _running, "doc_id long, size long, text_crc32 long, part int, place long, before long"), "shard-order")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    starts, rows, total = [], 0, 0
    for t in sorted(totals, key=lambda t: t["part"]):  # one row per partition
        starts.append((t["part"], rows, total))
        rows, total = rows + t["rows"], total + t["bytes"]
    prefix = docs.sparkSession.createDataFrame(starts, "part int, rows_before long, bytes_before long")
    whole = placed.join(F.broadcast(prefix), "part").select(  # a row per partition
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("place")).alias("position"),
        F.expr(f"cast(least((2 * (bytes_before + before) + size) * {shards} div {2 * max(total, 1)}, {shards - 1})"
               " as int)").alias("shard"))
    firsts = whole.groupBy("shard").agg(F.min("position").alias("first"))
    return whole.join(F.broadcast(firsts), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes each shard's documents, in slot order, to ``path/shard=k``, every row of ``docs`` once.

    Rows and places meet by id, checksum and their number among those that agree in both, so rows without id are
    written too and equal ones do not multiply.  Columns named ``shard`` or ``slot`` give way to those of the plan.
    """
    scratch = support.Scratch(docs.sparkSession)
    try:
        stored = scratch.table(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), "shard-rows")
        field = F.col("row").getField
        content = F.coalesce(field(text), F.lit("")).cast("binary")
        own = stored.select("_row", _name(field(doc_id).cast("long"), F.crc32(content)).alias("name"))
        given = plan.select(_name(F.col("doc_id"), F.col("text_crc32")).alias("name"), "shard", "slot")
        own = support.placed(own, "name", [F.col("_row")], scratch, "shard-names").select("name", "position", "_row")
        given = support.placed(given, "name", [F.col("shard"), F.col("slot")], scratch, "shard-places") \
            .select("name", "position", "shard", "slot")
        places = own.join(given, ["name", "position"]).select("_row", "shard", "slot")
        names = [n for n in docs.columns if n.lower() not in ("shard", "slot")]
        (stored.join(places, "_row").select(*[F.col("row").getField(n).alias(n) for n in names], "shard", "slot")
         .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
    finally:
        scratch.clear()


def _name(doc_id: Column, checksum: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), checksum)
