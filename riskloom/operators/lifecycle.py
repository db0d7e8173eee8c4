"""Alerts and investigation cases: creation, state from action logs, paging, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import mapped
from riskloom.operators.sweep import with_next_time


def _deadline(created: Column, level: Column) -> Column:
    hours = mapped(level, fv.ALERT_DEADLINE_HOURS, fv.ALERT_DEADLINE_DEFAULT_HOURS)
    return created + F.make_dt_interval(hours=hours)


def create_alerts(assessed: DataFrame, created_at: str = "transaction_time", customer: str = "account_id",
                  levels: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """One NEW alert per assessment of the given levels; the id follows from the transaction."""
    level = F.coalesce(F.col("risk_level"), F.lit("MEDIUM"))
    return assessed.filter(F.col("risk_level").isin(*levels)).select(
        F.concat(F.lit("ALT"), F.sha2("transaction_id", 256)).alias("alert_id"),
        "transaction_id", F.col(customer).alias("customer_id"), F.lit("FRAUD").alias("alert_type"),
        "risk_score", level.alias("risk_level"), F.col("decision").alias("agent_decision"),
        F.lit("NEW").alias("alert_status"), F.lit(0).alias("escalation_level"),
        F.col(created_at).alias("created_at"), _deadline(F.col(created_at), level).alias("processing_deadline"))


def _last(value: str, when: Column | None = None) -> Column:
    packed = F.struct("ts", "seq", value)
    return F.max(packed if when is None else F.when(when, packed))[value]


def fold_alerts(actions: DataFrame) -> DataFrame:
    """Current state of each alert from its actions; the last action wins."""
    action = F.col("action")
    handled = ~action.isin("CREATE", "ESCALATE")
    folded = actions.groupBy("entity_id").agg(
        _last("action").alias("last_action"),
        _last("assignee", handled).alias("assignee"),
        F.count_if(action == "ESCALATE").alias("escalation_level"),
        F.max("ts").alias("updated_at"))
    return folded.select(
        F.col("entity_id").alias("alert_id"),
        mapped(F.col("last_action"), fv.ALERT_STATES, "CLOSED").alias("alert_status"),
        "assignee", "escalation_level", "updated_at")


def sla_sweep(alerts: DataFrame, as_of: str) -> DataFrame:
    """Alerts unhandled past their deadline; HIGH ones go up one escalation level."""
    now = F.lit(as_of).cast(alerts.schema["processing_deadline"].dataType)
    overdue = alerts.filter(F.col("alert_status").isin("NEW", "PENDING", "PROCESSING")
                            & (F.col("processing_deadline") < now))
    high = F.col("risk_level") == "HIGH"
    return overdue.withColumns({
        "escalation_level": F.when(high, F.col("escalation_level") + 1).otherwise(F.col("escalation_level")),
        "alert_status": F.when(high, "PENDING").otherwise(F.col("alert_status")),
    })


def page(df: DataFrame, order: list[Column], number: int, size: int, status: str = "ALL",
         column: str = "alert_status", overflow: str = "first") -> DataFrame:
    """One page of a fully ordered list, as a bounded top-n rather than a global sort.

    ``overflow`` says what an out-of-range page returns: the first page or nothing.  The rows
    are counted first, so a page beyond the end costs no more than the first one.
    """
    rows = df if status == "ALL" else df.filter(F.col(column) == status)
    if number and rows.count() <= number * size:
        if overflow == "empty":
            return rows.limit(0)
        number = 0
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, order: list[str], size: int, after: tuple | None = None, status: str = "ALL",
               column: str = "alert_status") -> DataFrame:
    """The page that follows the row with the keys ``after`` (the first one without): every page costs the same.

    ``order`` are ascending columns without NULLs that identify a row together; each task keeps ``size`` rows.
    """
    rows = df if status == "ALL" else df.filter(F.col(column) == status)
    if after is not None:
        last = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        rows = rows.filter(F.struct(*order) > last)
    return rows.orderBy(*order).limit(size)


def page_summary(df: DataFrame, number: int, size: int, status: str = "ALL", column: str = "alert_status",
                 mode: str = "literal") -> DataFrame:
    """``total``, ``page`` and ``size`` beside a page.

    The established total counts rows whose status equals the asked one, which is none for
    ``ALL``; ``intent`` counts all rows then.
    """
    asked = F.lit(True) if status == "ALL" and mode == "intent" else F.col(column) == status
    return df.agg(F.count_if(asked).alias("total")).select("total", F.lit(number).alias("page"), F.lit(size).alias("size"))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def create_cases(alerts: DataFrame) -> DataFrame:
    """A NEW case per alert with its priority."""
    return alerts.select(
        F.concat(F.lit("CASE"), F.upper(F.sha2("alert_id", 256))).alias("case_id"),
        "alert_id", "transaction_id", "customer_id", F.col("alert_type").alias("case_type"), "risk_level",
        F.lit("NEW").alias("case_status"), priority(F.col("risk_level")).alias("priority"), "created_at")


def priority(level: Column) -> Column:
    return mapped(level, fv.CASE_PRIORITY, fv.CASE_PRIORITY_DEFAULT)


def case_stats(cases: DataFrame) -> DataFrame:
    status = F.col("case_status")
    return cases.select(
        F.count("*").alias("total_cases"), F.count_if(status == "NEW").alias("new_cases"),
        F.count_if(status.isin("ASSIGNED", "INVESTIGATING")).alias("in_progress"),
        F.count_if(status.isin("CLOSED", "ARCHIVED")).alias("closed_cases"))


def fold_cases(actions: DataFrame) -> DataFrame:
    """Current state of each case with its last assignment and closing times."""
    action = F.col("action")
    folded = actions.groupBy("entity_id").agg(
        _last("action").alias("last_action"),
        _last("assignee", action == "ASSIGN").alias("assignee"),
        F.min("ts").alias("created_at"),
        F.max(F.when(action == "ASSIGN", F.col("ts"))).alias("assigned_at"),
        F.max(F.when(action == "CLOSE", F.col("ts"))).alias("closed_at"),
        F.max("ts").alias("updated_at"))
    return folded.select(F.col("entity_id").alias("case_id"),
                         mapped(F.col("last_action"), fv.CASE_STATES, "NEW").alias("case_status"),
                         "assignee", "created_at", "assigned_at", "closed_at", "updated_at")


def case_durations(actions: DataFrame, as_of: str) -> DataFrame:
    """Seconds each case spent in each state, the current one counted up to ``as_of``."""
    timed = with_next_time(actions, "entity_id", "ts", ["ts", "seq"])
    until = F.coalesce(F.col("next_ts"), F.lit(as_of).cast(actions.schema["ts"].dataType))
    seconds = F.timestamp_diff("MICROSECOND", F.col("ts"), until)
    return (timed.groupBy(F.col("entity_id").alias("case_id"),
                          mapped(F.col("action"), fv.CASE_STATES, "NEW").alias("case_status"))
            .agg(F.count("*").alias("entered"), (F.sum(seconds) / 1e6).alias("seconds")))
