"""Corrections to what the stream has answered: only what a batch recomputation changes.

The stream answers a row once, from what had arrived by then.  Rows that came after later ones of their account make
earlier answers incomplete.  The accounts concerned are found from the output itself; their history is computed again
as a batch and compared with the answers.  What differs leaves as a pair of rows, ``retract`` with the old values and
``insert`` with the new ones, in the day of the row, so readers of the output touch only the days that change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRACT, INSERT = "retract", "insert"


def disordered(output: DataFrame, key: str, ts: str = "event_time", batch: str = "batch_id") -> DataFrame:
    """Keys with a row that came in a later micro-batch than a newer row, and the earliest such time (``since``)."""
    spans = output.groupBy(key, batch).agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))  # a row per key and batch
    before = F.max("_high").over(Window.partitionBy(key).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_before", before).filter("_low < _before").groupBy(key).agg(F.min("_low").alias("since"))


def corrections(answered: DataFrame, truth: DataFrame, row_key: str, columns: Sequence[str], day: str) -> DataFrame:
    """``op``, ``day``, ``row_key`` and ``columns`` of rows that differ: old values retracted, new ones inserted.

    Rows that only one side has are retracted or inserted alone.  NULL equals NULL.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(row_key).alias("_key"), F.struct(F.col(day).alias("day"), *columns).alias(name))

    met = side(answered, "old").join(side(truth, "new"), "_key", "full")
    changed = met.filter(~F.col("old").eqNullSafe(F.col("new")))
    pair = F.array(F.struct(F.lit(RETRACT).alias("op"), F.col("old").alias("v")), F.struct(F.lit(INSERT).alias("op"), F.col("new").alias("v")))
    rows = changed.select("_key", F.inline(pair)).filter("v is not null")
    return rows.select("op", "v.day", F.col("_key").alias(row_key), *[F.col("v")[c].alias(c) for c in columns])


def repair(output: DataFrame, history: DataFrame, recompute: Callable[[DataFrame], DataFrame], key: str, row_key: str,
           columns: Sequence[str], ts: str = "event_time", batch: str = "batch_id") -> DataFrame:
    """Corrections for all keys whose rows came out of order.

    ``history`` has every row of the stream and ``recompute`` its batch result with ``row_key``, ``ts`` and ``columns``.
    """
    late = disordered(output, key, ts, batch).select(key)
    answered = output.join(late, key, "left_semi").withColumn("_day", F.to_date(ts))
    truth = recompute(history.join(late, key, "left_semi")).withColumn("_day", F.to_date(ts))
    return corrections(answered, truth, row_key, columns, "_day")


def corrected(output: DataFrame, changes: DataFrame, row_key: str, columns: Sequence[str]) -> DataFrame:
    """The output after its corrections."""
    kept = output.join(changes.filter(F.col("op") == RETRACT).select(row_key), row_key, "left_anti")
    return kept.select(row_key, *columns).unionByName(changes.filter(F.col("op") == INSERT).select(row_key, *columns))
