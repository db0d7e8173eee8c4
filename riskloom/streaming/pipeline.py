"""The streaming job: one query, one state, four outputs and the alerts."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import features, lifecycle, rules
from riskloom.plans import assess as flow
from riskloom.session import STATE_STORE, cleared
from riskloom.streaming import sinks

Batch = Callable[[DataFrame, int], None]
ASSESSED = ("transaction_id", "risk_score", "risk_level", "decision", "confidence", "kb_score", "similar_cases")
ALERTED = ("account_id", "event_time")  # what alerts have besides


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start(stream: DataFrame, each: Batch, checkpoint: str, trigger: dict | None = None,
          partitions: int | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``each`` on every micro-batch; offsets and state live in ``checkpoint``.

    With ``mode="update"`` a micro-batch of an aggregation holds the groups that it changed, open windows included.
    ``partitions`` is the number of state partitions, fixed for the life of the checkpoint;
    the session's shuffle partitions are the default.
    """
    values = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if partitions:
        values["spark.sql.shuffle.partitions"] = str(partitions)
    with _settings(stream.sparkSession, values):
        writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def run_available(stream: DataFrame, each: Batch, checkpoint: str, at_once: bool = False, mode: str = "append",
                  settle: bool = True) -> StreamingQuery:
    """Process everything there is, then stop.  State partitions are the session's shuffle partitions.

    A stateful operator that works by time of processing always has another micro-batch to run: such a
    stream takes everything ``at_once``, in one micro-batch.  Without ``settle`` there is no micro-batch that
    only moves the watermark; its timers run in the next one, as they do where data goes on.
    """
    with _settings(stream.sparkSession, {} if settle else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        query = start(stream, each, checkpoint, {"once": True} if at_once else {"availableNow": True}, mode=mode)
        query.awaitTermination()
    return query


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators refused because they were older than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
               for op in json.loads(p.json)["stateOperators"])


def nest(enriched: DataFrame, transaction_columns: list[str]) -> DataFrame:
    """Enriched record: the transaction as a struct beside its features."""
    features = [c for c in enriched.columns if c not in transaction_columns]
    return enriched.select(F.struct(*transaction_columns).alias("transaction"), *features)


def fan_out(enriched: DataFrame, batch_id: int, root: str, transaction_columns: list[str],
            assess: Callable[[DataFrame], DataFrame]) -> None:
    """All outputs of one micro-batch, computed from the same cached rows.

    Of the assessment only what the outputs have is cached and shuffled; tables that it wrote on the way are deleted.
    """
    rows = enriched.persist()
    try:
        with cleared(enriched.sparkSession):
            _write_outputs(rows, batch_id, root, transaction_columns, assess)
    finally:
        rows.unpersist()


def _write_outputs(rows: DataFrame, batch_id: int, root: str, transaction_columns: list[str],
                   assess: Callable[[DataFrame], DataFrame]) -> None:
    sinks.json_batch(rows, "account_id_hash", f"{root}/clean", batch_id, transaction_columns)
    sinks.write_batch(sinks.store_rows(rows), f"{root}/features", batch_id)
    sinks.write_batch(sinks.analytic_rows(rows), f"{root}/analytic", batch_id)
    assessed = assess(rows).select("account_id_hash", *ASSESSED, *ALERTED).persist()
    try:
        sinks.json_batch(assessed, "account_id_hash", f"{root}/assessed", batch_id, ASSESSED)
        alerts = lifecycle.create_alerts(assessed, created_at="event_time")
        sinks.json_batch(alerts, "transaction_id", f"{root}/alerts", batch_id)
    finally:
        assessed.unpersist()


def fan_out_batch(root: str, transaction_columns: list[str], sanctions: Callable[[SparkSession], DataFrame] | None = None,
                  rule_table: Callable[[SparkSession], DataFrame] | None = None,
                  profile_changes: Callable[[SparkSession], DataFrame] | None = None,
                  similar: Callable[[DataFrame], DataFrame] | None = None,
                  offline: Callable[[SparkSession], DataFrame] | None = None, **options) -> Batch:
    """``foreachBatch`` function; lists, rules and profile changes are loaded again for every micro-batch.

    ``profile_changes`` (account and time) sets the flag of a recently changed profile.  ``similar`` is the case search
    of a micro-batch (``case_search.search_library`` over a persisted index).  ``offline`` loads the offline features,
    one row per ``account_id_hash``; their columns join the rows unless the stream has columns of these names.
    """
    def assess(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        # a micro-batch that only moves the watermark has no rows to search cases for
        searched = similar is not None and not rows.isEmpty()
        if profile_changes:
            rows = features.realtime_features(rows, rolling=False, history=False, diversity=False,
                                              profile_changes=profile_changes(spark))
        if offline:
            stored = offline(spark)
            own = {c.lower() for c in rows.columns}
            rows = rows.join(stored.select("account_id_hash", *[c for c in stored.columns if c.lower() not in own]),
                             "account_id_hash", "left")
        listing = sanctions(spark) if sanctions else None
        active = rules.load_rules(rule_table(spark)) if rule_table else rules.RULES
        found = similar(rows) if searched else None
        return flow.assess(rows, sanctions=listing, similar=found, rule_set=active, **options)

    return partial(fan_out, root=root, transaction_columns=transaction_columns, assess=assess)
