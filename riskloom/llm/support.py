"""Small table helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise, new_folder, remove_folder

NO_ID = -(1 << 63)
SIEVE_BITS = 27    # the largest set of bits that stands for a set of ids is 16 MB, however many ids there are
BITMAP_BITS = 15   # of a row of it: what Spark's bitmap functions hold


class Scratch:
    """Tables of the shared folder that an operator needs only while it runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: computed once, lineage cut, sizes known."""
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays after ``clear``: an operator's result, whose inputs may then go."""
        return materialise(df, name)

    def clear(self) -> None:
        for path in self.paths:
            remove_folder(self.spark, path)
        self.paths = []


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df`` whose names, in any case, are not among ``taken``: an operator's own columns win."""
    low = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in low]


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *taken: str) -> Column:
    """All other columns as one struct, so that working columns cannot clash with them."""
    names = others(df, *taken)
    return F.struct(*[col(n) for n in names]) if names else F.lit(None).cast("struct<none:int>")


def unpacked(df: DataFrame, holder: str, *own: str) -> DataFrame:
    """``own`` columns, then those that ``packed`` put into ``holder`` unless an own column has that name."""
    low = {name.lower() for name in own} | {"none"}
    field = df.schema[holder].dataType
    rest = [n for n in field.names if n.lower() not in low] if isinstance(field, T.StructType) else []
    return df.select(*own, *[F.col(holder).getField(n).alias(n) for n in rest])


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``key``: those with the smallest hashes.

    A count sets a hash limit that lets about twice as many rows through, so only those are sorted.
    """
    hashed = F.xxhash64(key, F.lit(97))
    total = df.count()
    if total > 2 * rows:
        limit = int((1 << 64) * min(1.0, 2.0 * rows / total)) - (1 << 63)
        df = df.filter(hashed < F.lit(limit))
    return df.orderBy(hashed).limit(rows)


def bounded_sample_of_each(df: DataFrame, group: str, key: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, the same number of each ``group`` (one at least): those with the smallest hashes of ``key``.

    Counts set a hash limit for each group, as in ``bounded_sample``; its smallest hash always passes.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*key, F.lit(97)))
    found = hashed.groupBy(group).agg(F.count("*"), F.min("_hash")).collect()  # a row per group
    share = max(1, rows // max(1, len(found)))
    most = 2 * share + 50
    limits = [(name, (1 << 63) - 1 if n <= most else max(least, (most << 64) // n - (1 << 63))) for name, n, least in found]
    schema = T.StructType([df.schema[group], T.StructField("_limit", T.LongType())])
    near = hashed.join(F.broadcast(df.sparkSession.createDataFrame(limits, schema)), group).filter("_hash <= _limit")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_hash"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= share).select(*df.columns)


def parted_by_ids(df: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be in the one column of ``ids``, and those whose key is not there for certain.

    Hashes of the ids are bits that go to every task, 16 to 31 for an id and ``2 ** SIEVE_BITS`` at most.  So wide rows
    of few ids meet these in a join without a shuffle of all others; more ids than bits only let more rows through.
    A null key is not there.
    """
    bits = min(SIEVE_BITS, max(BITMAP_BITS, (16 * ids.count()).bit_length()))
    low = (1 << BITMAP_BITS) - 1

    def place(column: Column) -> Column:
        return F.when(column.isNotNull(), F.xxhash64(column.cast("long"), F.lit(53)).bitwiseAND(F.lit((1 << bits) - 1)))

    at = ids.select(place(col(ids.columns[0])).alias("at"))
    maps = at.groupBy(F.shiftright("at", BITMAP_BITS).alias("_map")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(low))).alias("_bits"))
    rows = df.select(F.struct("*").alias("_row"), place(key).alias("_at"))
    met = rows.withColumn("_map", F.shiftright("_at", BITMAP_BITS)).join(F.broadcast(maps), "_map", "left")
    byte = f"conv(hex(substring(_bits, cast((_at & {low}) div 8 as int) + 1, 1)), 16, 10)"
    found = F.expr(f"coalesce(getbit(cast({byte} as int), cast(_at & 7 as int)) = 1, false)")
    return tuple(met.filter(part).select(*[F.col("_row").getField(n).alias(n) for n in df.columns])
                 for part in (found, ~found))


def _local_places(group: str):
    """Adds the partition and the row's place among the rows of its group in this partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = np.zeros(batch.num_rows, np.int64)
            for i, name in enumerate(batch.column(group).to_pylist()):
                if name != current:
                    current, seen = name, 0
                places[i] = seen
                seen += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(places), part, np.int32)), pa.array(places)],
                names=[*batch.schema.names, "_part", "_local"])
    return run


def placed(rows: DataFrame, group: str, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``position`` (from 0) in and size ``n`` of their ``group``, a column without nulls.

    A range sort and running totals of partitions, no window over rows: a group of any size is spread over tasks.  The
    rows' own numbers end the order, so rows that are equal otherwise do not meet in one range either.
    """
    order = [group, *order, F.col("_spread")]
    ranged = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order) \
        .sortWithinPartitions(*order).drop("_spread")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = scratch.table(ranged.mapInArrow(_local_places(group), f"{kinds}, _part int, _local long"), name)
    totals = local.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    by = Window.partitionBy(group)  # a row per partition that the group reaches
    before = totals.select(group, "_part", F.sum("_rows").over(by).alias("n"), (F.sum("_rows").over(
        by.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"))
    return local.join(before, [group, "_part"]).withColumn("position", F.col("_before") + F.col("_local")) \
        .drop("_part", "_local", "_before")
