"""Suspicious-activity detection: large, split and cross-border payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv

REPORT = ("transaction_id", "customer_id", "trans_time", "amount", "target_account",
          "is_cross_border", "country", "suspicious_type", "suspicious_level", "reason")


def _tagged(df: DataFrame, kind: str, level: Column, *reason) -> DataFrame:
    return df.select(*REPORT[:7], F.lit(kind).alias("suspicious_type"),
                     level.alias("suspicious_level"), F.concat(*reason).alias("reason"))


def detect_large(txn: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return _tagged(txn.filter(amount >= fv.LARGE_AMOUNT), "LARGE_AMOUNT",
                   F.when(amount >= fv.LARGE_AMOUNT_HIGH, "HIGH").otherwise("MEDIUM"),
                   F.lit(fv.REASON_LARGE), amount.cast("string"))


def daily_split_candidates(txn: DataFrame) -> DataFrame:
    """Customer days with at least two payments, all below the limit, adding up to it."""
    return (txn.groupBy("customer_id", F.to_date("trans_time").alias("trans_date")).agg(
        F.sum("amount").alias("daily_total"), F.count("*").alias("txn_count"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))
        .filter((F.col("daily_total") >= fv.LARGE_AMOUNT) & (F.col("txn_count") >= 2)
                & (F.col("max_amount") < fv.LARGE_AMOUNT)))


def detect_split(txn: DataFrame) -> DataFrame:
    """Every payment of a split day.

    Aggregate-then-join instead of a window: the aggregate combines on the map side and
    the join can be split by the adaptive skew handling, so one customer holding most of a
    day never lands in a single task.  A split day has no payment at or above the limit,
    hence the filter on the joined side; payments without an amount are returned with it.
    """
    days = daily_split_candidates(txn).select("customer_id", "trans_date", "daily_total", "txn_count")
    small = txn.filter(F.col("amount").isNull() | (F.col("amount") < fv.LARGE_AMOUNT)).withColumn("trans_date", F.to_date("trans_time"))
    hits = small.join(days, ["customer_id", "trans_date"])
    return _tagged(hits, "SPLIT_TRANSACTION", F.lit("HIGH"),
                   F.lit(fv.REASON_SPLIT_TOTAL), F.col("daily_total").cast("string"),
                   F.lit(fv.REASON_SPLIT_COUNT), F.col("txn_count").cast("string"))


def detect_cross_border(txn: DataFrame) -> DataFrame:
    amount = F.col("amount")
    hits = txn.filter(F.col("is_cross_border") & (amount >= fv.CROSS_BORDER_AMOUNT))
    return _tagged(hits, "CROSS_BORDER",
                   F.when(amount >= fv.CROSS_BORDER_HIGH, "HIGH").otherwise("MEDIUM"),
                   F.lit(fv.REASON_CROSS_BORDER), amount.cast("string"), F.lit(" "), F.col("country"))


def suspicious_report(txn: DataFrame, report_date: str) -> DataFrame:
    """Union of the three detections without exact duplicates.

    A payment may appear once per type.  The large and cross-border branches read the
    same rows, so they are produced by one pass over the table (an array of zero to two
    findings per payment) and only the split branch scans it again.  What a branch adds to
    a payment follows from the payment, so duplicates are removed before it is added: fewer
    and narrower rows are shuffled.
    """
    amount = F.col("amount")

    def finding(test, kind, level, *reason):
        return F.when(test, F.struct(F.lit(kind).alias("suspicious_type"), level.alias("suspicious_level"),
                                     F.concat(*reason).alias("reason")))

    direct = F.array_compact(F.array(
        finding(amount >= fv.LARGE_AMOUNT, "LARGE_AMOUNT",
                F.when(amount >= fv.LARGE_AMOUNT_HIGH, "HIGH").otherwise("MEDIUM"),
                F.lit(fv.REASON_LARGE), amount.cast("string")),
        finding(F.col("is_cross_border") & (amount >= fv.CROSS_BORDER_AMOUNT), "CROSS_BORDER",
                F.when(amount >= fv.CROSS_BORDER_HIGH, "HIGH").otherwise("MEDIUM"),
                F.lit(fv.REASON_CROSS_BORDER), amount.cast("string"), F.lit(" "), F.col("country")),
    ))
    flagged = (amount >= fv.LARGE_AMOUNT) | (F.col("is_cross_border") & (amount >= fv.CROSS_BORDER_AMOUNT))
    one_pass = txn.select(*REPORT[:7]).filter(flagged).distinct().select(*REPORT[:7], F.inline(direct))
    return one_pass.unionByName(detect_split(txn).distinct()).withColumn("report_date", F.lit(report_date))


def compliance_summary(suspicious: DataFrame) -> DataFrame:
    return suspicious.groupBy("suspicious_type", "suspicious_level").agg(
        F.count("*").alias("count"), F.sum("amount").alias("total_amount"))
