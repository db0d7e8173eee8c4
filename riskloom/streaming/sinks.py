"""Micro-batch sinks, each safe to repeat after a restart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.operators.latest import apply_cdc, latest_per_key
from riskloom.session import remove_folder
from riskloom.sources.writers import to_json_records


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Each micro-batch owns one folder: a repeated batch overwrites its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def analytic_rows(enriched: DataFrame) -> DataFrame:
    """Fourteen columns and the insert time; rows without a transaction are skipped."""
    deviation = F.coalesce("amount_deviation", F.lit(0.0))
    return (enriched.filter(F.col("transaction_id").isNotNull()).withColumn("amount_deviation", deviation)
            .select(*fv.ANALYTIC_COLUMNS, F.current_timestamp().alias("create_time")))


def store_rows(enriched: DataFrame, key: str = "account_id_hash", ts: str = "event_time") -> DataFrame:
    """Latest features per account of a micro-batch."""
    return latest_per_key(enriched.filter(F.col(key).isNotNull()).select(key, ts, *fv.STORE_FEATURES), [key], [ts])


def current_features(spark: SparkSession, path: str, now: str | None = None, ttl_seconds: int = 86400,
                     key: str = "account_id_hash", ts: str = "event_time") -> DataFrame:
    """Store content: the latest row per account, without those past their time to live."""
    rows = latest_per_key(spark.read.parquet(path).drop("batch_id"), [key], [ts])
    rows = rows.withColumn("expires_at", F.col(ts) + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return rows if now is None else rows.filter(F.col("expires_at") > F.lit(now).cast("timestamp"))


def upsert_store(rows: DataFrame, batch_id: int, path: str, key: str = "account_id_hash", ts: str = "event_time",
                 ttl_seconds: int = 86400, buckets: int = 64) -> None:
    """Store with one row per key: the buckets that the batch touches are rewritten without expired rows.

    A bucket's newest folder is its content.  The folder it was built from stays until a later batch begins,
    which Spark does only when this one is committed: a repeated batch finds its input again, and a
    reader in between a complete bucket.  Rows expire ``ttl_seconds`` before the newest event time of the batch.
    """
    spark = rows.sparkSession
    before = store_folders(spark, path, batch_id)
    for batch, bucket, folder in _bucket_folders(spark, path):
        if batch < batch_id and folder != before[bucket]:
            remove_folder(spark, folder)
    fresh = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    merged = fresh
    for bucket in before.keys() & set(touched):
        folder = before[bucket]
        merged = merged.unionByName(spark.read.parquet(folder).withColumn("bucket", F.lit(bucket)))
    newest = fresh.agg(F.max(ts)).first()[0]
    alive = latest_per_key(merged, [key], [ts]).filter(
        F.col(ts) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.lit(newest))
    alive.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")
    # a bucket without a living row gets an empty file, which stands before the older folder
    written = {bucket for batch, bucket, _ in _bucket_folders(spark, path) if batch == batch_id}
    for bucket in set(touched) - written:
        alive.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/bucket={bucket}")


def _bucket_folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """Batch, bucket and path of every folder of a store."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/bucket=*")) or []
    folders = [status.getPath().toString() for status in found]
    return [(*(int(part.split("=")[1]) for part in folder.split("/")[-2:]), folder) for folder in folders]


def store_folders(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket, of batches ``before`` the given one."""
    newest: dict[int, tuple[int, str]] = {}
    for batch, bucket, folder in _bucket_folders(spark, path):
        if before is None or batch < before:
            newest[bucket] = max(newest.get(bucket, (-1, "")), (batch, folder))
    return {bucket: folder for bucket, (_, folder) in newest.items()}


def stored_features(spark: SparkSession, path: str, now: str | None = None, ttl_seconds: int = 86400,
                    ts: str = "event_time") -> DataFrame:
    """Content of an upserted store: one row per key, without those past their time to live."""
    rows = spark.read.parquet(*store_folders(spark, path).values())
    rows = rows.withColumn("expires_at", F.col(ts) + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return rows if now is None else rows.filter(F.col("expires_at") > F.lit(now).cast("timestamp"))


def json_batch(df: DataFrame, key: str, path: str, batch_id: int, columns: Sequence[str] | None = None) -> None:
    """Topic records of a micro-batch.  With Kafka the same frame goes to ``format("kafka")``."""
    write_batch(to_json_records(df, key, columns), path, batch_id)


def cdc_batch(changes: DataFrame, batch_id: int, path: str, keys: Sequence[str], seq: str) -> None:
    """Last change per key of a micro-batch, deletes included, in the batch's own folder."""
    write_batch(latest_per_key(changes, keys, [seq]), path, batch_id)


def cdc_current(spark: SparkSession, path: str, keys: Sequence[str], seq: str, op: str = "op") -> DataFrame:
    """Row images in force after all batches written so far."""
    return apply_cdc(spark.read.parquet(path).drop("batch_id"), keys, seq, op)
