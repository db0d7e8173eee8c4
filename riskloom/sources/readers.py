"""Batch readers for parquet and JDBC stores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import LOAD_CSV


def read_table(spark: SparkSession, location: str, fmt: str = "parquet",
               options: Mapping[str, str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``location`` is a path, or the table name for ``fmt="jdbc"``.

    For a large JDBC table pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``options``; without them a JDBC scan is a single task.
    """
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "jdbc":
        return reader.option("dbtable", location).load()
    return reader.load(location)


def on_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """One calendar day as a half-open range on the bare column, so it is pushed to the source."""
    kind = df.schema[ts].dataType
    start = F.lit(day).cast("date")
    return df.filter((F.col(ts) >= start.cast(kind)) & (F.col(ts) < F.date_add(start, 1).cast(kind)))


def last_days(df: DataFrame, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on; ``as_of`` is a parameter, never the clock."""
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast(kind))


def load_customers(df: DataFrame) -> DataFrame:
    return df.select("customer_id", "customer_name", "account_type", "risk_level")


def load_cases(df: DataFrame, features_schema: str | None = None, description_length: int | None = None) -> DataFrame:
    """Case library, newest first, with empty text for NULL.

    ``description_length`` cuts the description (``fixed_values.CASE_DESCRIPTION_LENGTH`` is
    the established cut); by default it stays whole.
    ``features_schema`` (DDL) types the JSON column; malformed JSON becomes NULL.
    """
    text = {c: F.coalesce(F.col(c), F.lit(""))
            for c in ("modus_operandi", "fraud_pattern", "resolution", "resolution_effect")}
    out = df.withColumns({
        **text,
        "involved_amount": F.coalesce(F.col("involved_amount").cast("double"), F.lit(0.0)),
    })
    if description_length is not None:
        out = out.withColumn("case_description", F.substring("case_description", 1, description_length))
    if features_schema:
        out = out.withColumn("key_features", F.from_json("key_features", features_schema))
    return out.orderBy(F.col("created_at").desc(), F.col("case_id"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less load file with ``#`` comment lines."""
    return spark.read.schema(LOAD_CSV).option("comment", "#").csv(path)
