"""Report data: compliance, customer risk and periodic indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import ratio
from riskloom.operators.latest import latest_per_key

GRAINS = {"daily": "day", "weekly": "week", "monthly": "month"}


def report_base(alerts: DataFrame, transactions: DataFrame, cases: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per alert with its transaction, the latest state of its case, and its customer.

    ``status`` is that of the alert's own case, else of the alert.  Alerts without a transaction, case or
    customer stay, with NULLs.  Keys are compared as text.
    """
    def text(name):
        return F.col(name).cast("string").alias(name)

    paid = transactions.select(text("transaction_id"), "amount", F.col("transaction_time").alias("trans_time"))
    last = latest_per_key(cases.select(text("alert_id"), "case_id", "case_status", "updated_at"), ["alert_id"], ["updated_at", "case_id"])
    who = customers.select(text("customer_id"), "customer_name", "account_type")
    rows = alerts.withColumns({c: F.col(c).cast("string") for c in ("alert_id", "transaction_id", "customer_id")})
    joined = rows.join(paid, "transaction_id", "left").join(last, "alert_id", "left").join(who, "customer_id", "left")
    return joined.select(
        F.to_date("created_at").alias("report_date"), "alert_id", "transaction_id", "trans_time", "customer_id", "customer_name",
        "account_type", "amount", "alert_type", "risk_level", "case_id",
        F.coalesce("case_status", "alert_status").alias("status"), F.coalesce("updated_at", "created_at").alias("last_update"))


def compliance_report(suspicious: DataFrame, case_state: DataFrame) -> DataFrame:
    """Suspicious payments with the handling status of their customer (NEW when none)."""
    status = case_state.select("customer_id", F.col("case_status").alias("status"))
    return suspicious.join(status, "customer_id", "left").select(
        "report_date", "transaction_id", "customer_id", "amount", "suspicious_type", "suspicious_level",
        F.coalesce("status", F.lit("NEW")).alias("status"))


def customer_risk_report(scores: DataFrame, cases: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Per scored customer: level, cases, anomalies and last case update.

    Both counts are aggregated before they are joined, so no customer's rows multiply.
    """
    per_case = cases.groupBy("customer_id").agg(F.count("*").alias("case_count"), F.max("created_at").alias("last_update"))
    per_txn = suspicious.groupBy("customer_id").agg(F.count("*").alias("anomaly_count"))
    return (scores.select("customer_id", "customer_name", "risk_level")
            .join(per_case, "customer_id", "left").join(per_txn, "customer_id", "left")
            .withColumns({"case_count": F.coalesce("case_count", F.lit(0)),
                          "anomaly_count": F.coalesce("anomaly_count", F.lit(0))}))


def kpi_report(suspicious: DataFrame, cases: DataFrame, grain: str) -> DataFrame:
    """Indicators per period with the change from the previous period and its trend.

    Rows are counted per period first; the window then sees one row per period.
    """
    unit = GRAINS[grain]

    def period(ts):
        return F.to_date(F.date_trunc(unit, ts)).alias("period")

    status = F.col("case_status")
    counted = suspicious.groupBy(period("trans_time")).agg(F.count("*").alias("new_alerts"))
    per_case = cases.groupBy(period("created_at")).agg(
        F.count_if(status.isin("ASSIGNED", "INVESTIGATING")).alias("cases_in_progress"),
        F.count_if(status.isin("CLOSED", "ARCHIVED")).alias("cases_closed"))
    long = counted.select("period", F.lit("new_alerts").alias("metric"), F.col("new_alerts").alias("value")).unionByName(
        per_case.unpivot("period", ["cases_in_progress", "cases_closed"], "metric", "value"))
    previous = F.lag("value").over(Window.partitionBy("metric").orderBy("period"))
    change = ratio(F.col("value") - F.col("previous"), F.col("previous"))
    return long.withColumn("previous", previous).select(
        "period", "metric", "value", change.alias("change"),
        F.when(F.col("value") > F.col("previous"), fv.TREND_UP).when(F.col("value") < F.col("previous"), fv.TREND_DOWN)
         .when(F.col("value") == F.col("previous"), fv.TREND_FLAT).alias("trend"))
