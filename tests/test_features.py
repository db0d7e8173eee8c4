"""Real-time features: brute force, hot keys, order independence, streaming parity."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, latest, links, lifecycle, sweep
from riskloom.session import new_folder
from riskloom.streaming import account_state, ingest, pipeline, sinks

START = dt.datetime(2024, 1, 1)
SCHEMA = ("transaction_id string, account_id string, transaction_time timestamp_ntz, amount decimal(18,2), "
          "transaction_type string, device_id string, ip_city string, counterparty_hash string")


def make(n=300, accounts=3, seed=5, days=70):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # whole half-hours make equal times and exact window ends frequent
        t = START + dt.timedelta(minutes=30 * rng.randrange(days * 48)) if i % 2 else START + dt.timedelta(minutes=30 * rng.randrange(100))
        rows.append((f"t{i:04d}", rng.choice([None] + [f"a{j}" for j in range(accounts)]), t,
                     rng.choice([None, D(rng.randrange(1, 10**7)) / 100]), rng.choice(["DEPOSIT", "TRANSFER"]),
                     rng.choice([None, "d1", "d2", "d3"]), rng.choice(["c1", "c2"]), f"p{rng.randrange(40)}"))
    return rows


def brute(rows, changes=()):
    out = {}
    for r in rows:
        key = r[1] or "unknown"
        mine = [x for x in rows if (x[1] or "unknown") == key and x[2] <= r[2]]

        def within(**span):
            return [x for x in mine if x[2] >= r[2] - dt.timedelta(**span)]

        month, total = within(days=30), sum((x[3] or D(0)) for x in mine)
        mean = float(total) / len(mine)
        deviation = abs(float(r[3]) - mean) / mean if r[3] is not None and len(mine) >= 2 and mean else 0.0
        changed = any(k == key and r[2] - dt.timedelta(hours=24) <= t < r[2] for k, t in changes)
        out[r[0]] = (len(within(hours=1)), sum((x[3] or D(0)) for x in within(hours=1)),
                     len(within(hours=24)), sum((x[3] or D(0)) for x in within(hours=24)),
                     sum((x[3] or D(0)) for x in within(hours=1) if x[4] == "DEPOSIT"),
                     *[len({x[c] for x in month if x[c] is not None}) for c in (5, 6, 7)],
                     r[5] is not None and len({x[5] for x in month if x[5]}) == 1, round(deviation, 6), changed)
    return out


COLUMNS = ("count_1h", "amount_1h", "count_24h", "amount_24h", "inflow_1h", "device_count_30d", "city_count_30d",
           "counterparty_count_30d", "is_first_device", "amount_deviation", "info_changed_recently")


@pytest.mark.parametrize("hot_rows", [10**6, 20, 1])
def test_realtime_features_equal_brute_force(spark, hot_rows):
    """Ordinary keys, some hot keys, and every key cut into minutes give the same numbers."""
    rows = make()
    changes = [("a1", START + dt.timedelta(hours=h)) for h in range(0, 800, 37)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = spark.createDataFrame(changes, "account_id string, transaction_time timestamp_ntz")
    out = features.realtime_features(df, profile_changes=changed, hot_rows=hot_rows)
    got = {r.transaction_id: tuple(round(r[c], 6) if c == "amount_deviation" else r[c] for c in COLUMNS) for r in out.collect()}
    assert got == brute(rows, changes)


def test_hot_plan_keeps_ordinary_plan_simple(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    out = features.realtime_features(df, diversity=False)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in final  # no hot key: nothing is carried over


def test_null_time_is_kept(spark):
    df = spark.createDataFrame([("x", "a", None, D("1.00"), "T", None, None, None)], SCHEMA)
    assert features.realtime_features(df).count() == 1


def test_first_device_intent(spark):
    rows = make(seed=9)
    got = {r.transaction_id for r in features.first_device(spark.createDataFrame(rows, SCHEMA), "intent").collect() if r.is_first_device}
    seen, want = set(), set()
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[1] and r[5] and (r[1], r[5]) not in seen:
            seen.add((r[1], r[5]))
            want.add(r[0])
    assert got == want


def test_next_time_over_buckets(spark):
    rows = make(seed=3)
    df = spark.createDataFrame(rows, SCHEMA).filter("account_id is not null")
    got = {r.transaction_id: r.next_ts for r in
           sweep.with_next_time(df, "account_id", "transaction_time", ["transaction_time", "transaction_id"]).collect()}
    for account in {r[1] for r in rows if r[1]}:
        mine = sorted((r for r in rows if r[1] == account), key=lambda r: (r[2], r[0]))
        for now, after in zip(mine, mine[1:] + [None]):
            assert got[now[0]] == (after[2] if after else None)


def test_latest_and_dedup(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, 5, None)], "k int, s int, v string")
    assert {tuple(r) for r in latest.latest_per_key(df, ["k"], ["s"]).collect()} == {(1, 3, "c"), (2, 5, None)}
    assert {tuple(r) for r in latest.dedup(df, ["k"], ["s"]).collect()} == {(1, 1, "a"), (2, 5, None)}


def test_cdc_delete_and_reinsert(spark):
    log = spark.createDataFrame([(1, 1, "c", "x"), (1, 2, "delete", None), (2, 1, "c", "y"), (2, 2, "delete", None), (2, 3, "c", "z")],
                                "id int, seq int, op string, v string")
    assert [tuple(r) for r in latest.apply_cdc(log, ["id"], "seq").collect()] == [(2, 3, "z")]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    pairs += [(400, 400 + i) for i in range(1, 90)]  # one hub
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    want = {n: find(n) for n in parent}
    got = links.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_burst_and_key_links(spark):
    base = START + dt.timedelta(hours=5)
    rows = [("c1", "ip1", "d1", base + dt.timedelta(seconds=i), D(1)) for i in range(5)]
    rows += [("c2", "ip1", "d1", base + dt.timedelta(seconds=i), D(2)) for i in range(5)]
    rows += [("c3", "ip1", "", base, D(3)), ("c4", None, "d2", base, D(4))]
    txn = spark.createDataFrame(rows, "customer_id string, ip_address string, device_id string, trans_time timestamp_ntz, amount decimal(18,2)")
    groups = {(r.relationship_type, r.customer_count, r.txn_count, r.risk_level) for r in links.relationship_groups(txn, "d").collect()}
    assert groups == {("SAME_IP", 3, 11, "MEDIUM"), ("SAME_DEVICE", 2, 10, "MEDIUM"), ("BURST_TXN", 2, 10, "HIGH")}


def test_page_overflow(spark):
    df = spark.range(25).selectExpr("id", "'NEW' as alert_status")
    order = [F.col("id")]
    ids = lambda page, overflow: [r.id for r in lifecycle.page(df, order, page, 10, "NEW", overflow=overflow).collect()]
    assert ids(2, "first") == [20, 21, 22, 23, 24] and ids(3, "first") == list(range(10)) and ids(3, "empty") == []


def streamed(spark, rows, per_batch, policy="process"):
    """Rows replayed in files of ``per_batch``, one file per micro-batch."""
    folder = new_folder(spark, "replay")
    parts = [rows[i:i + per_batch] for i in range(0, len(rows), per_batch)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={i:04d}")
    schema = spark.createDataFrame([], SCHEMA).schema
    source = ingest.read_stream(spark, "parquet", {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}, f"{folder}/in", schema)
    out = account_state.stream_features(ingest.with_event_time(source), late_policy=policy)
    run = lambda: pipeline.run_available(out, lambda df, i: sinks.write_batch(df, f"{folder}/out", i), f"{folder}/cp")
    run()
    return folder, run


def test_stream_equals_batch_over_micro_batches(spark):
    rows = sorted({r[2]: r for r in make(n=120, seed=8)}.values(), key=lambda r: r[2])  # unique times
    folder, _ = streamed(spark, rows, 40)
    got = {r.transaction_id: r for r in spark.read.parquet(f"{folder}/out").collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        assert (r.count_1h, r.amount_1h, r.count_24h, r.amount_24h) == w[:4], key
        assert (r.device_count_30d, r.city_count_30d, r.counterparty_count_30d, r.is_first_device) == w[5:9], key
        assert round(r.amount_deviation, 6) == w[9], key


def test_stream_restart_duplicates_and_late_rows(spark):
    day = lambda i: START + dt.timedelta(days=i)
    row = lambda i, t: (i, "a", t, D("10.00"), "TRANSFER", "d1", "c1", "p1")
    rows = [row("x1", day(1)), row("x1", day(1)), row("x2", day(2)), row("x3", day(3)), row("late", day(1) - dt.timedelta(hours=30))]
    folder, run = streamed(spark, rows, 2)
    ids = sorted(r.transaction_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert ids == ["late", "x1", "x2", "x3"]  # the duplicate is gone, the late row answered
    run()  # nothing new: a restart changes nothing
    assert spark.read.parquet(f"{folder}/out").count() == 4
    folder, _ = streamed(spark, rows, 2, policy="drop")
    assert sorted(r.transaction_id for r in spark.read.parquet(f"{folder}/out").collect()) == ["x1", "x2", "x3"]


def test_stream_redelivery_hours_later(spark):
    hour = lambda i: START + dt.timedelta(hours=i)
    row = lambda i, t: (i, "a", t, D("10.00"), "TRANSFER", "d1", "c1", "p1")
    rows = [row("x1", hour(1)), row("x2", hour(9)), row("x3", hour(30)), row("x1", hour(1)), row("x2", hour(9)), row(None, hour(31)), row(None, hour(31))]
    folder, _ = streamed(spark, rows, 1)
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(str(r.transaction_id) for r in out.collect()) == ["None", "None", "x1", "x2", "x3"]
    assert out.agg(F.max("count_24h")).first()[0] == 4  # x2 is a day old when the last rows come
