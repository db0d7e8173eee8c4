"""The account state under wrong and missing times, its size, what it serves, profiles in force, corrections."""

import datetime as dt
import random
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskloom.operators import rules
from riskloom.session import new_folder
from riskloom.streaming import account_state, ingest, payload, pipeline, profile_state, repair, sinks

START = dt.datetime(2024, 1, 1)
SCHEMA = ("transaction_id string, account_id string, transaction_time timestamp_ntz, amount decimal(18,2), device_id string, "
          "ip_city string, counterparty_hash string")


def row(name, hours, account="a", amount="10.00", device="d1", city="c1", other="p1"):
    return (name, account, None if hours is None else START + dt.timedelta(hours=hours), D(amount), device, city, other)


def replay(spark, batches, schema=SCHEMA, **options):
    folder = new_folder(spark, "clock")
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/part={i:04d}")
    source = ingest.read_stream(spark, "parquet", {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}, f"{folder}/in",
                                spark.createDataFrame([], schema).schema)
    out = account_state.stream_features(ingest.with_event_time(source), **options)
    pipeline.run_available(out, lambda df, i: sinks.write_batch(df, f"{folder}/out", i), f"{folder}/cp",
                           at_once=bool(options.get("serve_seconds")))
    return folder, spark.read.parquet(f"{folder}/out")


def test_one_wrong_clock_erases_nothing(spark):
    rows = [row("r0", 0), row("r1", 0.1), row("bad", 48), row("r2", 0.2), row("r3", 0.25)]
    _, out = replay(spark, [[r] for r in rows])
    counts = {r.transaction_id: (r.count_1h, r.count_24h) for r in out.collect()}
    # everything that has arrived from an hour before on, the row of the wrong clock included
    assert counts == {"r0": (1, 1), "r1": (2, 2), "bad": (1, 1), "r2": (4, 4), "r3": (5, 5)}


def test_missing_times_do_not_move_the_clock(spark):
    rows = [row("r0", 0), *[row(f"n{i}", None) for i in range(4)], row("r1", 0.1), row("r2", 0.2)]
    _, out = replay(spark, [[r] for r in rows])
    counts = {r.transaction_id: r.count_1h for r in out.collect()}
    assert counts["r1"] == 6 and counts["r2"] == 7  # the four of now are later than both


def test_late_rows_count_each_other(spark):
    rows = [row("r0", 100), row("r1", 101), row("r2", 102), row("l0", 70), row("l1", 70.5), row("l2", 47)]
    _, out = replay(spark, [[r] for r in rows])
    got = {r.transaction_id: (r.count_1h, r.count_24h, r.count_all if "count_all" in out.columns else None) for r in out.collect()}
    assert got["l0"][:2] == (4, 4) and got["l1"][:2] == (5, 5) and got["l2"][:2] == (6, 6)


def test_state_is_bounded_after_forty_days(spark):
    """One account with an event every half hour: slices of 97 hours, ids of 72 hours, sightings of 33 days."""
    rng = random.Random(3)
    rows = [row(f"t{i}", i / 2, device=f"d{i // 48}", city=f"c{rng.randrange(5)}", other=f"p{i}") for i in range(40 * 48)]
    folder, out = replay(spark, [rows[i:i + 480] for i in range(0, len(rows), 480)])

    def state(name):
        return spark.read.format("statestore").option("path", f"{folder}/cp").option("stateVarName", name).load()

    kept = 24 + account_state.REMEMBER + 1
    assert state("slices").count() <= kept + 2
    # hours are forgotten when a batch comes in: those of the last batch (240 hours) and REMEMBER before it
    assert state("ids").count() <= 240 + 2 * account_state.REMEMBER
    (profile,) = state("profile").select("value.*").collect()
    assert len([v for a, v in zip(profile["attributes"], profile["values"]) if a == 2]) <= (30 * 24 + account_state.REMEMBER + 2) * 2 + 480
    last = out.filter(F.col("transaction_id") == "t1919").first()
    assert (last.count_1h, last.count_24h, last.device_count_30d, last.counterparty_count_30d) == (3, 49, 31, 1441)


def test_columns_of_any_type_pass_through(spark):
    kind = SCHEMA + ", tags array<string>, place struct<lat:double,names:map<string,int>>, raw binary"
    rows = [(*row("x", 1), ["a", None, "'"], (1.5, {"k": 2}), b"\x00\xff"), (*row("y", 2), None, None, None)]
    folder, out = replay(spark, [rows], kind)
    got = {r.transaction_id: r for r in out.collect()}
    assert got["x"].tags == ["a", None, "'"] and got["x"].place.names == {"k": 2} and bytes(got["x"].raw) == b"\x00\xff"
    assert got["y"].tags is None and got["y"].place is None and got["y"].raw is None
    df = spark.createDataFrame(rows, kind)
    assert df.selectExpr(f"{payload.packed(df.schema)} as payload").selectExpr(*payload.unpacked(df.schema)).schema.names == df.schema.names


def test_rows_ahead_of_their_arrival_are_set_apart(spark):
    df = spark.createDataFrame([("a", START, START), ("b", START + dt.timedelta(hours=3), START), ("c", None, START)],
                               "transaction_id string, transaction_time timestamp_ntz, came timestamp")
    good, ahead = ingest.ahead_of_arrival(df, "came", "1 hour")
    assert {r[0] for r in good.collect()} == {"a", "c"} and [r[0] for r in ahead.collect()] == ["b"]
    timed = {r.transaction_id: r.event_time for r in ingest.with_event_time(df, arrival="came").collect()}
    assert timed["c"] == START


def test_served_features_expire(spark):
    rows = [row("x1", 0), row("x2", 1, device="d2"), row("y1", 5, account="b")]
    folder, _ = replay(spark, [rows], serve_seconds=2)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream_schema = ingest.with_event_time(spark.createDataFrame([], schema)).schema
    far, near = "2000-01-01", None
    held = {r.account_key: r for r in account_state.served_features(spark, f"{folder}/cp", stream_schema, far).collect()}
    assert {k: (r.transaction_id, r.count_1h, r.device_count_30d) for k, r in held.items()} == {"a": ("x2", 2, 2), "b": ("y1", 1, 1)}
    time.sleep(2.5)
    assert account_state.served_features(spark, f"{folder}/cp", stream_schema, near).count() == 0
    with pytest.raises(ValueError):
        replay(spark, [rows], serve_seconds=2, late_policy="drop")


def test_profile_in_force_and_versions_kept(spark):
    folder = new_folder(spark, "profile")
    hour = lambda h: START + dt.timedelta(hours=h)
    changes = [[(1, hour(i), i, "update", f"v{i}") for i in range(0, 100, 10)],
               [(1, hour(200), 30, "delete", None), (2, hour(1), 1, "update", "w"), (None, hour(1), 1, "update", "n")],
               [(1, hour(i), 100 + i, "update", f"v{i}") for i in range(300, 700, 10)]]
    events = [[("e1", 1, hour(15)), ("e2", 1, hour(40)), ("e3", 2, hour(2))],
              [("late", 1, hour(45)), ("gone", 1, hour(201)), ("two", 2, hour(3)), ("none", None, hour(3)), ("untimed", 1, None)],
              [("z", 1, hour(695)), ("before", 1, hour(-5))]]
    for i in range(3):
        spark.createDataFrame(changes[i], "cid long, at timestamp_ntz, seq long, op string, level string").coalesce(1).write.parquet(f"{folder}/c/p={i}")
        spark.createDataFrame(events[i], "eid string, cid long, at timestamp_ntz").coalesce(1).write.parquet(f"{folder}/e/p={i}")
    options = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}
    live = ingest.read_stream(spark, "parquet", options, f"{folder}/e", spark.createDataFrame([], "eid string, cid long, at timestamp_ntz").schema)
    log = ingest.read_stream(spark, "parquet", options, f"{folder}/c",
                             spark.createDataFrame([], "cid long, at timestamp_ntz, seq long, op string, level string").schema)
    out = profile_state.with_profile_asof(live, log, "cid", "at", "at", "seq", ["level"], op="op")
    pipeline.run_available(out, lambda df, i: sinks.write_batch(df, f"{folder}/out", i), f"{folder}/cp")
    got = {r.eid: r.level for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"e1": "v10", "e2": "v40", "e3": None, "late": "v40", "gone": None, "two": "w", "none": None, "untimed": None,
                   "z": "v690", "before": None}
    kept = spark.read.format("statestore").option("path", f"{folder}/cp").option("stateVarName", "versions").load()
    sizes = {r[0]: r[1] for r in kept.selectExpr("key.profile_key", "size(value.times)").collect()}
    assert sizes["1"] <= 12  # 72 hours of changes every 10 hours, and the one in force before
    with pytest.raises(ValueError):
        profile_state.with_profile_asof(live.withColumn("level", F.lit(1)), log, "cid", "at", "at", "seq", ["level"])


def test_corrections_hold_changes_only(spark):
    kind = "id string, acc string, event_time timestamp_ntz, batch_id int, v int"
    out = spark.createDataFrame([("a", "x", START, 0, 1), ("b", "x", START + dt.timedelta(days=1), 0, 2),
                                 ("c", "x", START + dt.timedelta(hours=2), 1, None), ("d", "y", START, 1, 7)], kind)
    assert [tuple(r) for r in repair.disordered(out, "acc").collect()] == [("x", START + dt.timedelta(hours=2))]
    truth = {"a": 1, "b": 3, "c": None, "d": 99}
    recompute = lambda df: df.withColumn("v", F.create_map(*[F.lit(x) for p in truth.items() for x in p])[F.col("id")])
    changes = repair.repair(out, out, recompute, "acc", "id", ["v"])
    assert sorted((r.op, str(r.day), r.id, r.v) for r in changes.collect()) == [
        ("insert", "2024-01-02", "b", 3), ("retract", "2024-01-02", "b", 2)]  # y was in order and is not computed again
    assert {r.id: r.v for r in repair.corrected(out, changes, "id", ["v"]).collect()} == {"a": 1, "b": 3, "c": None, "d": 7}


def test_rule_table_cannot_run_or_stop_anything(spark):
    table = rules.definitions(spark).limit(0)
    odd = [("R001", "IT'S", None, 10, "X' || version() || '", "it's", True, 1), ("R001", "n", None, None, "HIGH", "d", True, 1),
           ("R001", "n", None, 77, "HIGH", "d", True, 1), ("R002", "n", None, 5, "IT'S", "d", True, 1),
           ("R9", "n", None, 5, "LOW", "d", True, 1), (None, "n", None, 5, "LOW", "d", True, 1), ("R003", "n", None, 5, "LOW", "d", None, 1)]
    table = table.unionByName(spark.createDataFrame(odd, table.schema))
    loaded = rules.load_rules(table)
    assert [(r.rule_id, r.weight, r.level) for r in loaded] == [("R001", 77, "HIGH")]
    rejected = {(r.rule_id, r.reason) for r in rules.rejected_rules(table).collect()}
    assert rejected == {("R001", "unknown level"), ("R001", "no usable weight"), ("R002", "unknown level"), ("R9", "unknown rule"), (None, "unknown rule")}
    quoted = rules.Rule("Q'1", "it's \\ 'x'", "d'", 3, "LOW", 1, "amount > 1")
    hit = rules.evaluate_rules(spark.sql("select cast(5 as decimal(18,2)) as amount"), [quoted]).first().matched_rules[0]
    assert (hit.rule_id, hit.rule_name, hit.description) == ("Q'1", "it's \\ 'x'", "d'")
    assert rules.evaluate_rules(spark.sql("select 1 as amount"), []).first().matched_rules == []
