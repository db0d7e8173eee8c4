"""Operational indicators over the decision log and the conditions that raise an alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 200  # size of a quantile sketch


def latency_windows(audit: DataFrame, length: str, slide: str | None = None, ts: str = "created_at") -> DataFrame:
    """P50 / P95 / P99 of the processing time per window.

    Exact: times are whole milliseconds, so a window holds one counter per distinct value
    rather than its rows.
    """
    quantiles = [F.percentile("processing_time_ms", F.lit(q)).alias(f"p{int(q * 100)}_ms") for q in (0.5, 0.95, 0.99)]
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (audit.groupBy(window.alias("w")).agg(F.count("*").alias("n"), *quantiles)
            .select(F.col("w.start").alias("window_start"), "n", "p50_ms", "p95_ms", "p99_ms"))


def decision_rates(audit: DataFrame, length: str, slide: str, seconds: int, ts: str = "created_at") -> DataFrame:
    """Decisions per second by outcome in sliding windows."""
    return (audit.groupBy(F.window(ts, length, slide).alias("w"), "decision").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "decision", "n", (F.col("n") / seconds).alias("per_second")))


def rule_rates(hits: DataFrame, length: str, seconds: int, ts: str = "created_at") -> DataFrame:
    """Hits per second by rule in tumbling windows."""
    return (hits.groupBy(F.window(ts, length).alias("w"), "rule_id").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "rule_id", "n", (F.col("n") / seconds).alias("per_second")))


def alert_conditions(audit: DataFrame, step: str, sustained: int, latency_ms: float = 500.0,
                     block_share: float = 0.3, empty_share: float = 0.5, ts: str = "created_at") -> DataFrame:
    """Steps at which a condition has held for ``sustained`` consecutive steps.

    A step that holds votes for itself and the following ones; a condition fires where all
    votes are present, so no ordered window over the whole time line is needed.  Steps
    without any decision come from a calendar.
    """
    every = F.expr(f"interval {step}")
    steps = audit.groupBy(F.window(ts, step)["start"].alias("step")).agg(
        F.count("*").alias("n"),
        F.percentile("processing_time_ms", F.lit(0.99)).alias("p99"),
        (F.count_if(F.col("decision") == "BLOCK") / F.count("*")).alias("blocked"),
        (F.count_if("search_empty") / F.count("*")).alias("empty"))
    span = steps.agg(F.min("step").alias("first"), F.max("step").alias("last"))
    calendar = span.select(F.explode(F.sequence("first", "last", every)).alias("step"), "last")
    full = calendar.join(steps, "step", "left")

    def raised(name: str, test: Column) -> Column:
        return F.when(test, F.lit(name))

    names = F.array_compact(F.array(
        raised("high_latency", F.col("p99") > latency_ms),
        raised("high_block_share", F.col("blocked") > block_share),
        raised("no_rule_execution", F.col("n").isNull()),
        raised("empty_search_share", F.col("empty") > empty_share)))
    votes = (full.select("step", "last", F.explode(names).alias("condition"))
             .select("condition", "last", F.explode(F.sequence(F.col("step"), F.col("step") + every * (sustained - 1), every)).alias("at")))
    return (votes.filter(F.col("at") <= F.col("last")).groupBy("condition", F.col("at").alias("step"))
            .agg(F.count("*").alias("votes")).filter(F.col("votes") == sustained).select("condition", "step"))


# --- sketches, for streams and long ranges -------------------------------------------------------

def latency_sketches(audit: DataFrame, step: str, ts: str = "created_at", by: tuple[str, ...] = ()) -> DataFrame:
    """A mergeable sketch of processing times per step (and ``by``): ``window_start``, ``n``, ``sketch``.

    Works on a stream with a watermark as on a table.
    """
    return (audit.groupBy(F.window(ts, step).alias("w"), *by).agg(
        F.count("processing_time_ms").alias("n"), F.kll_sketch_agg_double(F.col("processing_time_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), *by, "n", "sketch"))


def latency_from_sketches(sketches: DataFrame, length: str, by: tuple[str, ...] = ()) -> DataFrame:
    """P50 / P95 / P99 of longer windows, merged from the sketches of their steps.

    A quantile is a time of the window whose rank is within 1.7 % (99 % confidence, ``SKETCH_K`` = 200) of the asked
    one; windows of up to ``SKETCH_K`` times are exact.
    """
    merged = sketches.groupBy(F.window("window_start", length).alias("w"), *by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{int(q * 100)}_ms") for q in (0.5, 0.95, 0.99)]
    return merged.filter("n > 0").select(F.col("w.start").alias("window_start"), *by, "n", *quantiles)
