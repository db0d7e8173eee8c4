"""Batch writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv


def write_table(df: DataFrame, location: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    """Write a result table.

    Overwriting a partitioned path replaces only the partitions present in ``df``, so a
    day can be rerun without touching the others.  For JDBC pass ``url``, ``driver`` and
    ``batchsize`` in ``options``.
    """
    writer = df.write.format(fmt).mode(mode).options(**dict(options or {}))
    if fmt == "jdbc":
        writer.option("dbtable", location).save()
        return
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(location)


def write_features(df: DataFrame, location: str, fmt: str = "parquet",
                   options: Mapping[str, str] | None = None) -> None:
    """Append the offline feature projection."""
    write_table(df.select(*fv.FEATURE_COLUMNS), location, "append", fmt,
                options={"batchsize": "10000", **dict(options or {})})


def to_json_records(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``key`` and ``value`` columns for a message topic."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*(columns or df.columns))).alias("value"))
