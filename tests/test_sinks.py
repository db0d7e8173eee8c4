"""The upserted store when a batch is repeated, against a dict."""

import datetime as dt
import os

from riskloom.session import materialise, new_folder
from riskloom.streaming import pipeline, sinks

START = dt.datetime(2024, 1, 1)


def put(spark, root, batch_id, rows):
    frame = spark.createDataFrame([(k, START + dt.timedelta(hours=h), v) for k, h, v in rows],
                                  "account_id_hash string, event_time timestamp, v long")
    sinks.upsert_store(frame, batch_id, root, ttl_seconds=86400, buckets=3)


def content(spark, root):
    return {r["account_id_hash"]: r["v"] for r in sinks.stored_features(spark, root).collect()}


def test_repeated_batch_keeps_the_store(spark, tmp_path):
    root = str(tmp_path / "store")
    first = [(f"k{i}", 0, i) for i in range(30)]
    put(spark, root, 0, first)
    put(spark, root, 1, [("k1", 1, 101), ("k2", 1, 102), ("n", 1, 7)])
    want = {f"k{i}": i for i in range(30)} | {"k1": 101, "k2": 102, "n": 7}
    assert content(spark, root) == want
    for _ in range(2):
        put(spark, root, 1, [("k1", 1, 101), ("k2", 1, 102), ("n", 1, 7)])
        assert content(spark, root) == want
    put(spark, root, 2, [("k3", 2, 203)])
    put(spark, root, 2, [("k3", 2, 203)])
    assert content(spark, root) == want | {"k3": 203}


def test_bucket_whose_rows_all_expire(spark, tmp_path):
    root = str(tmp_path / "store")
    put(spark, root, 0, [(f"k{i}", 0, i) for i in range(30)])
    late = [(f"k{i}", 0, i) for i in range(30)] + [("new", 48, 1)]
    for _ in range(2):
        put(spark, root, 1, late)
        assert content(spark, root) == {"new": 1}
    # merges with the empty buckets, and no more than two folders of a bucket stay
    put(spark, root, 2, [(f"k{i}", 49, i) for i in range(30)])
    assert content(spark, root) == {f"k{i}": i for i in range(30)} | {"new": 1}
    assert all(batch > 0 for batch, _, _ in sinks._bucket_folders(spark, root))


def test_empty_micro_batch_searches_no_cases(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(pipeline.flow, "assess", lambda rows, similar=None, **_: (similar, rows.count()))
    assess = pipeline.fan_out_batch("", [], similar=lambda rows: searched.append(rows.count()) or "found").keywords["assess"]
    rows = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    assert assess(rows) == ("found", 2) and assess(rows.limit(0)) == (None, 0)
    assert searched == [2]


def test_a_micro_batch_leaves_no_tables_and_carries_only_what_it_writes(spark, monkeypatch):
    """Tables of the case search stayed for good, and the whole assessment was cached and shuffled."""
    monkeypatch.setattr(sinks, "store_rows", lambda rows: rows)
    monkeypatch.setattr(sinks, "analytic_rows", lambda rows: rows)
    root, folders, seen = new_folder(spark, "outputs"), [], []
    write = sinks.json_batch
    monkeypatch.setattr(sinks, "json_batch", lambda df, *rest: (seen.append(df.columns), write(df, *rest)))
    rows = spark.createDataFrame([("h", "a", "t1", dt.datetime(2024, 1, 1)), ("h", "a", "t2", dt.datetime(2024, 1, 2))],
                                 "account_id_hash string, account_id string, transaction_id string, event_time timestamp")

    def assess(found):
        table = materialise(found, "on-the-way")
        folders.extend(table.inputFiles())
        return table.selectExpr("*", "90.0 as risk_score", "'HIGH' as risk_level", "'BLOCK' as decision", "1.0 as confidence",
                                "0.0 as kb_score", "array('c') as similar_cases", "repeat('x', 1000) as wide")

    pipeline.fan_out(rows, 0, root, ["transaction_id"], assess)
    assert "wide" not in seen[1] and {"account_id", "event_time", "similar_cases"} <= set(seen[1])
    assert folders and not any(os.path.exists(f.removeprefix("file://")) for f in folders)
    assert spark.read.parquet(f"{root}/assessed").count() == spark.read.parquet(f"{root}/alerts").count() == 2
