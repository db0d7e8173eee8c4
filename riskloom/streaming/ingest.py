"""Reading, parsing, cleaning and de-duplicating the transaction stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import cleaning
from riskloom.schemas import TRANSACTION


def read_stream(spark: SparkSession, fmt: str, options: Mapping[str, str], path: str | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """A raw stream.  ``kafka`` starts at the latest offsets and its value is cast to text."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", "latest")
    reader = reader.options(**dict(options))
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.load(path) if path else reader.load()
    return raw.withColumn("value", F.col("value").cast("string")) if fmt == "kafka" else raw


def parse_json(raw: DataFrame, schema: T.StructType = TRANSACTION) -> tuple[DataFrame, DataFrame]:
    """Parsed records and the payloads that are empty or not of the schema.

    Unknown fields are ignored.  A payload is bad when it is not a JSON object or has none
    of the known fields.
    """
    parsed = raw.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    known = F.coalesce(*[F.col("record")[f.name].cast("string") for f in schema.fields])
    bad = F.col("record").isNull() | known.isNull()
    good = parsed.filter(~bad).select("record.*")
    return good, parsed.filter(bad).select("value")


def with_event_time(df: DataFrame, delay: str = "10 seconds", ts: str = "transaction_time", arrival: str | None = None) -> DataFrame:
    """Event time with a bounded out-of-orderness; where it is missing, that of arrival.

    ``arrival`` is the broker's time of the record; without one it is the time of processing, which a replay changes.
    """
    came = F.col(arrival).cast("timestamp") if arrival else F.current_timestamp()
    return df.withColumn("event_time", F.coalesce(F.col(ts).cast("timestamp"), came)).withWatermark("event_time", delay)


def ahead_of_arrival(df: DataFrame, arrival: str, limit: str = "1 hour", ts: str = "transaction_time") -> tuple[DataFrame, DataFrame]:
    """Rows whose time can be right, and rows (to be set apart) that claim to be later than their arrival by ``limit``."""
    ahead = F.coalesce(F.col(ts).cast("timestamp") > F.col(arrival).cast("timestamp") + F.expr(f"interval {limit}"), F.lit(False))
    return df.filter(~ahead), df.filter(ahead)


def dedup_stream(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """First arrival per transaction id for streams without account state.

    Ids are remembered for the delay given to ``with_event_time``, and rows later than that
    are dropped (``pipeline.dropped_rows`` counts them): choose the delay as the retention.
    The account state recognises repeated ids itself and drops nothing.
    """
    return df.dropDuplicatesWithinWatermark([key])


def clean_stream(df: DataFrame) -> DataFrame:
    return cleaning.clean(df)


def enrich_stream(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; the dimension is read again for every micro-batch."""
    return stream.join(dimension, key, "left")
