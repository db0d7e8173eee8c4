"""The inverted-file index against plain products, its case search, and partial features of days."""

import datetime as dt
import math
import random
import statistics
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import case_search, features, ivf, partials, similar
from riskloom.session import new_folder


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, width))
    v = centres[rng.integers(0, 10, n)] + 0.3 * rng.standard_normal((n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def by_hand(queries, cases, k):
    out = {}
    for i, q in enumerate(queries.astype(np.float64)):
        s = np.round(cases.astype(np.float64) @ q, 6)
        order = sorted(range(len(s)), key=lambda j: (-s[j], j))[:k]
        out[i] = [(j, s[j]) for j in order]
    return out


def frame(spark, matrix, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"{key} long, vector array<float>")


@pytest.mark.parametrize("block_rows", [ivf.BLOCK_ROWS, 16])
def test_exact_search_equals_products(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ivf, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 20)
    cases = np.concatenate([clustered(600, 12, 1), np.repeat(clustered(1, 12, 2), 80, axis=0)])  # copies fill one cell
    queries = np.concatenate([clustered(40, 12, 3), cases[-1:]])
    path = new_folder(spark, "ivf")
    ivf.build(frame(spark, cases, "case_id"), path)
    index = ivf.load(spark, path)
    assert index.sizes.sum() == 680 and (index.blocks.max() > 1) == (block_rows == 16)
    hits, counts = ivf.search(frame(spark, queries, "query_id"), index, 7)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.case_id, r.similarity))
    assert got == by_hand(queries, cases, 7)
    pairs = counts.agg(F.sum("scanned"), F.sum("compared")).first()
    assert pairs[1] < pairs[0] < 680 * 41  # cells are left out, and most of what is scanned is not compared


def test_probes_trade_recall_for_pairs(spark):
    cases = clustered(1500, 16, 4)
    path = new_folder(spark, "ivf")
    index = ivf.build(frame(spark, cases, "case_id"), path)
    queries = frame(spark, cases[::15], "query_id")
    probes = ivf.tuned_probes(queries, index, recall=0.95)
    hits, counts = ivf.search(queries, index, 5, probes=probes)
    want = by_hand(cases[::15], cases, 5)
    found = [(r.query_id, r.case_id) for r in hits.collect()]
    recall = len({(q, c) for q, v in want.items() for c, _ in v} & set(found)) / (5 * len(want))
    shares = counts.agg(F.sum("scanned"), F.sum("compared")).first()
    assert recall >= 0.9 and probes < len(index.sizes)
    assert shares[1] < 0.2 * len(cases) * len(want)


def test_queries_go_once_to_a_group_of_cells(spark, monkeypatch):
    """What a query sends to the vectors grows with their number, not with that of the cells that it probes."""
    monkeypatch.setattr(ivf, "GROUP_ROWS", 300)
    cases, queries = clustered(900, 12, 7), clustered(30, 12, 8)
    path = new_folder(spark, "ivf")
    index = ivf.build(frame(spark, cases, "case_id"), path, cells=60)
    asked = frame(spark, queries, "query_id")
    probes = ivf._probed(asked, index, len(index.sizes), False)
    assert probes.count() <= 30 * 4 and int((index.sizes > 0).sum()) > 30
    hits, counts = ivf.search(asked, index, 4, probes=len(index.sizes))
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.case_id, r.similarity))
    assert got == by_hand(queries, cases, 4)
    assert {r.scanned for r in counts.collect()} == {900}


@pytest.mark.parametrize("part_bytes", [ivf.PART_BYTES, 1])
def test_exact_search_copies_nothing_for_what_it_meets(spark, monkeypatch, part_bytes):
    """Queries went to every group and the vectors to every block of queries, which filled the disk."""
    monkeypatch.setattr(ivf, "GROUP_ROWS", 100)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 10)
    monkeypatch.setattr(ivf, "PART_BYTES", part_bytes)
    cases, queries = np.concatenate([clustered(500, 12, 1), np.repeat(clustered(1, 12, 2), 40, axis=0)]), clustered(64, 12, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = ivf.build(frame(spark, cases, "case_id"), new_folder(spark, "ivf"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    asked = frame(spark, queries, "query_id")
    found, parts = ivf._met(asked, index, 4)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan
    assert (parts == 1 and found.count() == 64) if part_bytes > 1 else 64 < found.count() <= 64 * parts  # files may be empty
    rows = ivf.best(asked, index, 4).collect()
    assert {r.query_id: list(zip(r.case_ids, r.similarities)) for r in rows} == by_hand(queries, cases, 4)
    assert {(r.query_id, r.case_id, r.similarity) for r in ivf.search(asked, index, 4)[0].collect()} == {
        (q, c, s) for q, hits in by_hand(queries, cases, 4).items() for c, s in hits}


def test_hits_in_rows_and_in_lists_score_alike(spark):
    lists = spark.createDataFrame([(1, [7, 3, 9], [0.9, 0.5, 0.5]), (2, [4], [0.25]), (3, [], [])],
                                  "query_id long, case_ids array<long>, similarities array<double>")
    each = lists.selectExpr("query_id", "posexplode(arrays_zip(case_ids, similarities)) as (pos, hit)").selectExpr(
        "query_id", "hit.case_ids as case_id", "hit.similarities as similarity", "pos + 1 as rank")
    want = {(1, round(190 / 3, 9), ("7", "3")), (2, 25.0, ("4",))}
    for hits in (lists, each):
        assert {(r.query_id, round(r.kb_score, 9), tuple(r.similar_cases)) for r in similar.kb_score(hits, 2).collect()} == want


def test_index_of_nothing_and_fewer_than_k(spark):
    path = new_folder(spark, "ivf")
    index = ivf.build(frame(spark, np.zeros((0, 3), np.float32), "case_id"), path)
    queries = frame(spark, clustered(3, 3, 5), "query_id")
    assert ivf.search(queries, index, 5)[0].count() == 0
    index = ivf.build(frame(spark, clustered(2, 3, 6), "case_id"), new_folder(spark, "ivf"))
    assert ivf.search(queries, index, 5)[0].count() == 6
    with pytest.raises(ValueError):
        ivf.search(queries, index, 0)


def test_symbol_counts():
    counts = case_search.symbol_counts(["aAb 9é9", ""])
    assert counts[0, 0] == 2 and counts[0, 1] == 1 and counts[0, -1] == 2 and counts[0].sum() == 5 and not counts[1].any()


def test_days_merge_to_thirty(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(minutes=rng.randrange(31 * 1440)), D(rng.randrange(1, 10**7)) / 100,
             f"C{rng.randrange(4)}", f"M{rng.randrange(40)}", rng.choice(["TRANSFER", "WITHDRAW", "PAYMENT", "X"])) for _ in range(900)]
    rows += [("c", start + dt.timedelta(days=3), None, None, None, None), ("c", start + dt.timedelta(days=4), D("5.00"), "C", "M", "X")]
    df = spark.createDataFrame(rows, "account_id_hash string, transaction_time timestamp_ntz, amount decimal(18,2), channel_code string, "
                                     "merchant_id string, transaction_type string")
    path = new_folder(spark, "partials")
    days = partials.daily_partials(df)
    partials.write_days(days, path)
    partials.write_days(partials.daily_partials(df.filter(F.to_date("transaction_time") == "2024-01-07")), path)  # a repeated run
    merged = partials.features_from_partials(spark, path, "2024-01-31")
    look_back = df.filter("transaction_time >= timestamp'2024-01-01' and transaction_time < timestamp'2024-01-31'")
    want = {r.customer_id_hash: r for r in features.account_features_30d(look_back).collect()}
    got = {r.customer_id_hash: r for r in merged.collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        for name in w.asDict():
            a, b = getattr(got[key], name), getattr(w, name)
            assert a == b or math.isclose(float(a), float(b), rel_tol=1e-9), (key, name, a, b)
    amounts = [float(r[2]) for r in rows if r[0] == "a" and r[1] < dt.datetime(2024, 1, 31)]
    assert math.isclose(got["a"].std_amount_30d, statistics.stdev(amounts), rel_tol=1e-9)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # other days are not read
