"""Registered queries that replay the event table as a stream (trigger: available now)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import case_search, features, ivf, kpi
from riskloom.operators.latest import latest_per_key
from riskloom.plans import bindings as b
from riskloom.plans.catalogue import money, query
from riskloom.session import materialise, new_folder, remove_folder
from riskloom.streaming import account_state, alert_state, ingest, pipeline, profile_state, repair, sinks

PROFILE_BUCKETS = 1024  # groups of customers whose profiles are one state
ALERT_BUCKETS = 1024    # groups of alerts that share a state
FEATURES = ("count_1h", "count_24h", "device_count_30d", "city_count_30d", "counterparty_count_30d", "is_first_device")


def event_stream(spark, sf_dir) -> DataFrame:
    schema = b.table(spark, sf_dir, "events").schema
    return ingest.read_stream(spark, "parquet", {"pathGlobFilter": "events.parquet"}, sf_dir, schema)


def cleaned_stream(spark, sf_dir) -> DataFrame:
    """Events as they come in: cleaned and timed."""
    text = F.lit(None).cast("string")
    rows = b.events_view(event_stream(spark, sf_dir)).withColumns(
        {"account_id_hash": text, "counterparty_account": text, "currency": text})
    return ingest.with_event_time(ingest.clean_stream(rows))


def featured_stream(spark, sf_dir) -> DataFrame:
    """De-duplicated events with their account features."""
    return account_state.stream_features(cleaned_stream(spark, sf_dir))


def _collected(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run the stream into a table of the shared folder and read that table."""
    root = new_folder(spark, name)
    pipeline.run_available(stream, lambda rows, batch_id: sinks.write_batch(rows, f"{root}/out", batch_id), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch_id")


def _fanned_out(spark, sf_dir, **options) -> str:
    root = new_folder(spark, "stream-fanout")
    stream = featured_stream(spark, sf_dir)
    columns = ["transaction_id", "account_id", "transaction_type", "channel_code", "amount", "ip_risk_level"]
    each = pipeline.fan_out_batch(root, columns, sanctions=lambda s: b.sanctions(b.events(s, sf_dir)), stand_in=True,
                                  profile_changes=lambda s: b.profile_changes(b.events(s, sf_dir)), **options)
    pipeline.run_available(stream, each, f"{root}/checkpoint")
    return root


@query
def stream_ingest(spark, sf_dir):
    """Events as JSON payloads, every 97th broken: bad payloads never reach the output."""
    e = F.col("event_id")
    payload = (F.when(e % 97 == 0, F.lit("{broken")).when(e % 97 == 1, F.lit(""))
               .otherwise(F.to_json(F.struct(e.cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("account_id"),
                                             (F.col("value") * 2000).cast("decimal(18,2)").alias("amount"), F.lit(1).alias("unknown_field")))))
    good, _ = ingest.parse_json(event_stream(spark, sf_dir).select(payload.alias("value")))
    out = _collected(spark, good.select("transaction_id", "account_id", "amount"), "stream-ingest")
    return out.withColumns(money("amount"))


@query
def stream_quarantine(spark, sf_dir):
    e = F.col("event_id")
    payload = F.when(e % 97 == 0, F.concat(F.lit("{broken "), e)).otherwise(F.to_json(F.struct(e.cast("string").alias("transaction_id"))))
    _, bad = ingest.parse_json(event_stream(spark, sf_dir).select(payload.alias("value")))
    return _collected(spark, bad, "stream-quarantine")


@query
def stream_dedup(spark, sf_dir):
    """Every event twice in the stream, once in the output."""
    rows = event_stream(spark, sf_dir).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"), "event_id", "ts")
    timed = ingest.with_event_time(rows, ts="ts")
    return _collected(spark, ingest.dedup_stream(timed, "event_id").select("event_id"), "stream-dedup")


LATE, AHEAD = "event_id % 50 = 7", "event_id % 997 = 5"
ALL_FEATURES = (*FEATURES, "amount_1h", "amount_24h", "amount_deviation")


def late_events(spark, sf_dir) -> DataFrame:
    """Events with the number of the micro-batch in which they arrive, five days each.

    Every fiftieth comes 30 hours late; the clock of every 997th is 48 hours ahead.
    """
    arrived = f"cast(floor((unix_seconds(cast(transaction_time as timestamp)) + if({LATE}, 108000, 0)) / 432000) as int)"
    return b.events(spark, sf_dir).withColumn("arrival", F.expr(arrived)).withColumn(
        "transaction_time", F.expr(f"transaction_time + if({AHEAD}, interval 48 hours, interval 0 hours)"))


def _late_replay(spark, sf_dir, policy: str, restart: bool = False):
    """The late events, one file per micro-batch, late ones twice; and what the stream makes of them.

    With ``restart`` the query ends after every micro-batch, and the last commit of every run but the last is lost, so
    the next run repeats that micro-batch from its offsets.
    """
    root = new_folder(spark, "stream-late")
    events = late_events(spark, sf_dir)
    rows = events.unionByName(events.filter(LATE))
    arrivals = [r[0] for r in events.select("arrival").distinct().orderBy("arrival").collect()]  # a few
    options = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}

    def run():
        source = ingest.read_stream(spark, "parquet", options, f"{root}/in", events.drop("arrival").schema)
        out = account_state.stream_features(ingest.with_event_time(source), late_policy=policy)
        return pipeline.run_available(out, lambda batch, i: sinks.write_batch(batch, f"{root}/out", i), f"{root}/checkpoint")

    for place, number in enumerate(arrivals):
        rows.filter(F.col("arrival") == number).drop("arrival").coalesce(1).write.parquet(f"{root}/in/part={number:06d}")
        if restart:
            done = run()
            if place + 1 < len(arrivals):
                remove_folder(spark, f"{root}/checkpoint/commits/{place}")
    if not restart:
        done = run()
    return spark.read.parquet(f"{root}/out"), done


def _feature_rows(df: DataFrame, *keep: str) -> DataFrame:
    plain = df.select("transaction_id", *keep, *FEATURES, "amount_1h", "amount_24h", F.round("amount_deviation", 6).alias("amount_deviation"))
    return plain.withColumns(money("amount_1h", "amount_24h"))


@query
def stream_late(spark, sf_dir):
    """Rows that arrive 30 hours late, and twice, and rows two days ahead: answered once, with everything that had arrived."""
    out, _ = _late_replay(spark, sf_dir, "process")
    return _feature_rows(out.withColumn("late", F.expr(LATE)), "late")


@query
def stream_restart(spark, sf_dir):
    """The same answers from a query that ends after every micro-batch and has to repeat the one before."""
    out, _ = _late_replay(spark, sf_dir, "process", restart=True)
    return _feature_rows(out.withColumn("late", F.expr(LATE)), "late")


@query
def stream_repair(spark, sf_dir):
    """The same output after its corrections: what a batch over all events gives."""
    out, _ = _late_replay(spark, sf_dir, "process")
    out = materialise(out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")), "stream-answers")

    def recompute(rows: DataFrame) -> DataFrame:
        timed = features.realtime_features(rows).withColumn("event_time", F.col("transaction_time"))
        return timed.select("transaction_id", "event_time", *[F.col(c).cast(out.schema[c].dataType).alias(c) for c in ALL_FEATURES])

    changes = materialise(repair.repair(out, late_events(spark, sf_dir), recompute, "account_id", "transaction_id", ALL_FEATURES),
                          "stream-corrections")
    return _feature_rows(repair.corrected(out, changes, "transaction_id", ALL_FEATURES))


@query
def stream_late_rejects(spark, sf_dir):
    """The counted alternative: with ``drop``, rows answered and rows refused add up to the input."""
    out, done = _late_replay(spark, sf_dir, "drop")
    return out.agg(F.count("*").alias("answered")).withColumn("refused", F.lit(pipeline.dropped_rows(done)).cast("long")) \
        .withColumn("total", F.col("answered") + F.col("refused"))


@query
def stream_enrich(spark, sf_dir):
    """Live events joined to the static customer profile."""
    stream = event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("customer_id"))
    profile = b.customers(spark, sf_dir).select("customer_id", "account_type", "risk_level")
    return _collected(spark, ingest.enrich_stream(stream, profile, "customer_id"), "stream-enrich")


@query
def stream_profile_asof(spark, sf_dir):
    """Events, some 30 hours late, some with a clock ahead, with the customer profile in force at their time.

    Of profile changes, too, only what has arrived can be seen.
    """
    root = new_folder(spark, "stream-profile")
    day = "cast(floor(unix_seconds(cast({} as timestamp)) / 432000) as int)"
    changes = b.profile_log(spark, sf_dir).withColumn("arrival", F.expr(day.format("last_update")))
    events = late_events(spark, sf_dir).selectExpr("transaction_id", "cast(account_id as long) as customer_id", "transaction_time", "arrival")
    sides = {"events": events, "changes": changes}
    # what has no time comes first
    stored = {name: materialise(rows.fillna(0, "arrival"), f"stream-profile-{name}") for name, rows in sides.items()}

    def run():
        live, log = (ingest.read_stream(spark, "parquet", {"recursiveFileLookup": "true"}, f"{root}/{name}", rows.drop("arrival").schema)
                     for name, rows in sides.items())
        seen = profile_state.with_profile_asof(live, log, "customer_id", "transaction_time", "last_update", "seq", ["risk_level"],
                                             op="op", buckets=PROFILE_BUCKETS)
        pipeline.run_available(seen, lambda rows, batch_id: sinks.write_batch(rows, f"{root}/out", batch_id), f"{root}/checkpoint")

    arrivals = stored["events"].select("arrival").union(stored["changes"].select("arrival")).distinct().orderBy("arrival")
    for number in [r[0] for r in arrivals.collect()]:  # a few
        for name, rows in stored.items():
            rows.filter(F.col("arrival") == number).drop("arrival").write.parquet(f"{root}/{name}/part={number:06d}")
        run()  # one micro-batch takes the files of an arrival, however many tasks wrote them
    out = spark.read.parquet(f"{root}/out")
    return out.select("transaction_id", "risk_level", F.col("profile_since").cast("timestamp_ntz").alias("profile_since"))


@query
def stream_features(spark, sf_dir):
    stream = featured_stream(spark, sf_dir).select(
        "transaction_id", *FEATURES, "amount_1h", "amount_24h", F.round("amount_deviation", 6).alias("amount_deviation"))
    return _collected(spark, stream, "stream-features").withColumns(money("amount_1h", "amount_24h"))


@query
def stream_sink_analytic(spark, sf_dir):
    out = spark.read.parquet(f"{_fanned_out(spark, sf_dir)}/analytic").drop("batch_id", "create_time")
    return out.withColumns(money("amount", "amount_1h", "amount_24h") | {"amount_deviation": F.round("amount_deviation", 6)})


@query
def stream_fanout(spark, sf_dir):
    """Rows that reached each of the outputs of one streaming query."""
    root = _fanned_out(spark, sf_dir)
    parts = [spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("output")) for name in ("clean", "features", "analytic", "assessed")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("output").agg(F.count("*").alias("n"))


@query
def stream_assess(spark, sf_dir):
    value = spark.read.parquet(f"{_fanned_out(spark, sf_dir)}/assessed").select("value")
    fields = "transaction_id string, risk_score double, risk_level string, decision string, confidence double"
    return value.select(F.from_json("value", fields).alias("r")).select("r.*")


@query
def stream_assess_cases(spark, sf_dir):
    """The streaming assessment with its case search: each micro-batch probes the persisted index."""
    path = new_folder(spark, "case-library")
    case_search.build_library(b.documents_as_cases(spark, sf_dir), path)
    index = ivf.load(spark, path)
    root = _fanned_out(spark, sf_dir, similar=lambda rows: case_search.search_library(
        rows.withColumns({"transaction_time": F.col("transaction_time"), "amount_deviation": F.round("amount_deviation", 4).cast("decimal(20,4)")}), index))
    fields = "transaction_id string, risk_score double, risk_level string, decision string, kb_score double, similar_cases array<string>"
    found = spark.read.parquet(f"{root}/assessed").select(F.from_json("value", fields).alias("r")).select("r.*")
    return found.withColumns({"kb_score": F.round("kb_score", 6), "similar_cases": F.array_join("similar_cases", ",")})


@query
def stream_store_upsert(spark, sf_dir):
    """Latest event per user in an upserted store fed by several micro-batches; users gone for 10 days expire."""
    root = new_folder(spark, "stream-store")
    (b.table(spark, sf_dir, "events").repartitionByRange(4, "ts").sortWithinPartitions("ts")
     .write.parquet(f"{root}/in"))
    schema = b.table(spark, sf_dir, "events").schema
    source = ingest.read_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, f"{root}/in", schema)
    rows = source.select("user_id", F.col("ts").cast("timestamp").alias("event_time"), "event_id")
    ttl = 10 * 86400
    pipeline.run_available(rows, lambda batch, i: sinks.upsert_store(
        latest_per_key(batch, ["user_id"], ["event_time", "event_id"]), i, f"{root}/store", "user_id", ttl_seconds=ttl, buckets=4),
        f"{root}/checkpoint")
    newest = spark.read.parquet(f"{root}/in").agg(F.max("ts").cast("string")).first()[0]
    return sinks.stored_features(spark, f"{root}/store", newest, ttl).select("user_id", "event_id")


@query
def stream_kpi(spark, sf_dir):
    """Hourly counts in append mode: a window leaves when the watermark has passed it."""
    timed = ingest.with_event_time(event_stream(spark, sf_dir), ts="ts")
    windows = timed.groupBy(F.window("event_time", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = _collected(spark, windows.select(F.col("w.start").alias("window_start"), "event_type", "n"), "stream-kpi")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_kpi_latency(spark, sf_dir):
    """Hourly latency quantiles merged from sketches of ten minutes; the windows that are still open are there too."""
    root = new_folder(spark, "stream-kpi-latency")
    timed = ingest.with_event_time(event_stream(spark, sf_dir), ts="ts")
    steps = kpi.latency_sketches(timed.withColumn("processing_time_ms", F.col("value").cast("int")), "10 minutes", "event_time")
    pipeline.run_available(steps, lambda rows, batch_id: sinks.write_batch(rows, f"{root}/out", batch_id), f"{root}/checkpoint", mode="update")
    newest = latest_per_key(spark.read.parquet(f"{root}/out"), ["window_start"], ["batch_id"])
    out = kpi.latency_from_sketches(newest, "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_cdc(spark, sf_dir):
    """The profile change log applied micro-batch by micro-batch."""
    root = new_folder(spark, "stream-cdc")
    changes = b.profile_log_view(event_stream(spark, sf_dir))
    pipeline.run_available(
        changes, lambda rows, batch_id: sinks.cdc_batch(rows, batch_id, f"{root}/log", ["customer_id"], "seq"), f"{root}/checkpoint")
    return sinks.cdc_current(spark, f"{root}/log", ["customer_id"], "seq")


@query
def stream_feature_store(spark, sf_dir):
    """Latest features per account as the fan-out left them in the store."""
    stored = sinks.current_features(spark, f"{_fanned_out(spark, sf_dir)}/features")
    return stored.select("account_id_hash", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "count_1h", "count_24h",
                         "device_count_30d", "city_count_30d", "counterparty_count_30d", "ip_risk_level",
                         F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query
def stream_store_served(spark, sf_dir):
    """Current features of every account, read from the state of the running job itself."""
    root = new_folder(spark, "stream-served")
    stream = cleaned_stream(spark, sf_dir)
    out = account_state.stream_features(stream, serve_seconds=86400)
    pipeline.run_available(out, lambda rows, batch_id: rows.write.format("noop").mode("overwrite").save(), f"{root}/checkpoint",
                           at_once=True)
    served = account_state.served_features(spark, f"{root}/checkpoint", stream.schema)
    return served.select("account_id_hash", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "count_1h", "count_24h",
                         "device_count_30d", "city_count_30d", "counterparty_count_30d", "ip_risk_level")


def _alert_life(spark, sf_dir) -> DataFrame:
    """The actions on alerts in six micro-batches."""
    root = new_folder(spark, "stream-alerts")
    part = F.expr("cast(floor(unix_seconds(cast(ts as timestamp)) / 432000) as int)")
    actions = b.alert_actions(spark, sf_dir)
    schema = actions.schema
    actions.withColumn("part", part).filter("part is not null").write.partitionBy("part").parquet(f"{root}/arriving")
    stored = spark.read.parquet(f"{root}/arriving")

    def run(last: bool):
        source = ingest.read_stream(spark, "parquet", {"recursiveFileLookup": "true"}, f"{root}/in", schema)
        out = alert_state.alert_life(ingest.with_event_time(source, ts="ts"), hours=24, buckets=ALERT_BUCKETS)
        pipeline.run_available(out, lambda rows, batch_id: sinks.write_batch(rows, f"{root}/out", batch_id), f"{root}/checkpoint", settle=last)

    parts = [r[0] for r in stored.select("part").distinct().orderBy("part").collect()]  # a few
    for number in parts or [0]:
        stored.filter(F.col("part") == number).select(*schema.names).write.parquet(f"{root}/in/part={number:06d}")
        run(number == (parts or [0])[-1])  # one micro-batch takes the files of an arrival, however many tasks wrote them
    return spark.read.parquet(f"{root}/out")


@query
def stream_alert_state(spark, sf_dir):
    """Alerts as the stateful processor leaves them: the batch fold of their actions."""
    out = alert_state.current_alerts(_alert_life(spark, sf_dir))
    return out.select(F.col("alert_id").cast("long").alias("alert_id"), "alert_status", "assignee", "escalation_level",
                      F.col("at").cast("timestamp_ntz").alias("updated_at"))


@query
def stream_escalations(spark, sf_dir):
    """Alerts whose deadline passed before anybody had handled them."""
    out = _alert_life(spark, sf_dir).filter(F.col("kind") == alert_state.ESCALATION)
    return out.select(F.col("alert_id").cast("long").alias("alert_id"), F.col("at").cast("timestamp_ntz").alias("deadline"))
