"""30-day account features from partial results of single days.

A day's run reads that day only and writes one row per account: count, exact sums of amounts and their squares,
extremes, conditional counts and sketches of distinct values.  All of them merge, so the features of 30 days come from
30 small tables in place of 30 days of transactions.  Sums are exact; distinct counts are estimates of HLL sketches
(``SKETCH_BITS``: exact to about 300 values, a standard error of 1.6 % beyond).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_BITS = 12
COUNTS = {
    "night_count": "count_if(hour({ts}) < 6)", "weekend_count": "count_if(dayofweek({ts}) in (1, 7))",
    "transfer_count": "count_if(transaction_type = 'TRANSFER')", "withdraw_count": "count_if(transaction_type = 'WITHDRAW')",
    "payment_count": "count_if(transaction_type = 'PAYMENT')"}
SKETCHES = {"channel": "channel_code", "merchant": "merchant_id"}


def daily_partials(df: DataFrame, key: str = "account_id_hash", ts: str = "transaction_time") -> DataFrame:
    """A row per account and day."""
    return df.groupBy(F.col(key).alias("customer_id_hash"), F.to_date(ts).alias("day")).agg(*[F.expr(e) for e in (
        "count(*) as n", "count(amount) as n_amount", "sum(amount) as total", "sum(cast(amount * amount as decimal(38,4))) as squares",
        "max(amount) as most", "min(amount) as least",
        *[f"{e.format(ts=ts)} as {name}" for name, e in COUNTS.items()],
        *[f"hll_sketch_agg(cast({column} as string), {SKETCH_BITS}) as {name}" for name, column in SKETCHES.items()])])


def write_days(partials: DataFrame, path: str) -> None:
    """Writes each day into its folder; a day that is run again replaces its own folder and no other."""
    partials.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)


def features_from_partials(spark: SparkSession, path: str, as_of: str, days: int = 30) -> DataFrame:
    """The features of ``account_features_30d`` for the ``days`` whole days before ``as_of``."""
    until = F.to_date(F.lit(as_of))
    stored = spark.read.parquet(path)
    recent = stored.filter((F.col("day") >= F.date_sub(until, days)) & (F.col("day") < until))
    merged = recent.groupBy("customer_id_hash").agg(*[F.expr(e) for e in (
        "sum(n) as total_count_30d", "sum(n_amount) as n_amount", "sum(total) as total_amount_30d", "sum(squares) as squares",
        "max(most) as max_amount_30d", "min(least) as min_amount_30d", *[f"sum({c}) as {c}_30d" for c in COUNTS],
        *[f"hll_sketch_estimate(hll_union_agg({name})) as {name}_diversity_30d" for name in SKETCHES])])
    # the numerator of the variance is exact, so nothing cancels in floating point
    spread = ("cast(n_amount * squares - cast(total_amount_30d as decimal(25,2)) * cast(total_amount_30d as decimal(25,2)) as double)"
              " / (cast(n_amount as double) * (n_amount - 1))")
    return merged.selectExpr(
        "customer_id_hash", "total_amount_30d", "total_amount_30d / n_amount as avg_amount_30d", "max_amount_30d", "min_amount_30d",
        f"if(n_amount > 1, sqrt({spread}), null) as std_amount_30d", "total_count_30d", f"total_count_30d / {days} as avg_daily_count_30d",
        "night_count_30d", "weekend_count_30d", "channel_diversity_30d", "merchant_diversity_30d", "transfer_count_30d",
        "withdraw_count_30d", "payment_count_30d")
