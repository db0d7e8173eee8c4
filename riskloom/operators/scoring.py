"""Customer risk: statistics, profile join and the five-part score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import banded, mapped, ratio

PARTS = ("score_txn_freq", "score_large_txn", "score_target_dispersion", "score_volatility", "score_history")


def customer_stats(txn: DataFrame) -> DataFrame:
    """Count, amounts and distinct targets per customer."""
    return txn.groupBy("customer_id").agg(
        F.count("*").alias("txn_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.min("amount").alias("min_amount"),
        F.stddev("amount").alias("stddev_amount"),
        F.count_distinct("target_account").alias("unique_targets"),
    )


def enrich_profile(stats: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join to four profile columns.

    No broadcast hint: the planner broadcasts the profile only while its measured size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides on
    ``customer_id``, by which the statistics are partitioned already.
    """
    profile = customers.select("customer_id", "customer_name", "account_type", "risk_level")
    return stats.join(profile, "customer_id", "left")


def score_customers(features: DataFrame, clamp: bool = False) -> DataFrame:
    """The five parts, their sum (at most 155 unless clamped) and the level it implies."""
    parts = features.withColumns({
        "score_txn_freq": banded(F.col("txn_count"), fv.SCORE_FREQUENCY, 0.0),
        "score_large_txn": banded(F.col("avg_amount"), fv.SCORE_SIZE, 0.0),
        "score_target_dispersion": banded(F.col("unique_targets"), fv.SCORE_DISPERSION, 0.0),
        "score_volatility": banded(ratio(F.col("stddev_amount"), F.col("avg_amount")), fv.SCORE_VOLATILITY, 0.0),
        "score_history": mapped(F.col("risk_level"), fv.SCORE_HISTORY, 0.0),
    })
    total = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    if clamp:
        total = F.least(total, F.lit(100.0))
    scored = parts.withColumn("risk_score", total)
    return scored.withColumn("risk_level", banded(F.col("risk_score"), fv.CUSTOMER_LEVELS, "LOW", inclusive=True))


def batch_risk_scores(txn: DataFrame, customers: DataFrame, batch_date: str,
                      keep_parts: bool = False) -> DataFrame:
    scored = score_customers(enrich_profile(customer_stats(txn), customers))
    scored = scored.withColumn("batch_date", F.lit(batch_date))
    return scored if keep_parts else scored.drop(*PARTS)
