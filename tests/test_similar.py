"""Similar-case search against brute force, and readers / writers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins, kpi, similar
from riskloom.session import new_folder
from riskloom.sources import readers, writers
from riskloom.streaming import ingest


def unit(n, d, seed, copies=False):
    m = np.random.default_rng(seed).standard_normal((n, d))
    if copies:  # a third of the vectors are the same
        m[: n // 3] = m[0]
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).round(6)


def frames(spark, queries, cases):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cases)], "case_id long, vector array<double>")
    return q, c


def brute(queries, cases, k):
    out = set()
    for i, sims in enumerate((queries @ cases.T).round(6)):
        for rank, j in enumerate(sorted(range(len(cases)), key=lambda j: (-sims[j], j))[:k], 1):
            out.add((i, j, rank))
    return out


@pytest.mark.parametrize("k", [1, 5, 50])
def test_exact_topk_both_ways(spark, k):
    queries, cases = unit(23, 8, 1), unit(61, 8, 2, copies=True)
    q, c = frames(spark, queries, cases)
    want = brute(queries, cases, k)
    for out in (similar.vector_topk(q, c, k), similar.blocked_topk(q, c, k, similar.dot, "vector", block_rows=7)):
        assert {(r.query_id, r.case_id, r["rank"]) for r in out.collect()} == want


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_blocks_meet_without_copies_of_their_vectors(spark, threshold):
    """Each side was copied for every block of the other, which filled the disk."""
    queries, cases = unit(90, 8, 3, copies=True), unit(80, 8, 2, copies=True)
    q, c = frames(spark, queries, cases)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = similar.blocked_topk(q, c, 5, similar.dot, "vector", block_rows=7)
        plan = out._jdf.queryExecution().toString()
        assert {(r.query_id, r.case_id, r["rank"]) for r in out.collect()} == brute(queries, cases, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate" not in plan and "CoGroup" not in plan
    assert ("CartesianProduct" in plan) == (threshold == "-1")


def test_parts_of_the_cases_follow_their_bytes(spark, monkeypatch):
    """Every part sends the best hits of all queries, so parts by cores would multiply them."""
    queries, cases = unit(90, 8, 3), unit(80, 8, 2)
    q, c = frames(spark, queries, cases)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, most in ((64 << 20, 1), (1, 80)):
            monkeypatch.setattr(similar, "PART_BYTES", limit)
            found = similar._every_pair(q, c, 5, similar.dot, "vector", 2)
            rows = found.collect()
            assert len(rows) == 90 * 5 if most == 1 else 90 * 5 < len(rows) <= 90 * 80
            assert {(r.query_id, r.case_id, r["rank"]) for r in similar._merged(found, 5).collect()} == brute(queries, cases, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_products_in_single_precision_lose_no_hit(monkeypatch, kind):
    """All pairs were multiplied, rounded and sorted in double precision."""
    queries, cases = unit(40, 64, 5).astype(kind), unit(3000, 64, 6).astype(kind)
    cases[100:140] = cases[0] + np.float64(3e-7) * np.arange(40)[:, None]  # closer than single precision tells
    queries[0], cases[2000:2010], queries[1] = cases[0], cases[1], 0
    names = np.arange(3000)[::-1].copy()
    want = similar._best(np.arange(40), names, queries.astype(np.float64) @ cases.astype(np.float64).T, 7)
    sizes = []
    monkeypatch.setattr(similar, "FEW_PAIRS", 11)
    plain = similar._ranked
    monkeypatch.setattr(similar, "_ranked", lambda q, c, rows, *rest: (sizes.append(len(rows)), plain(q, c, rows, *rest))[1])
    got = [similar._nearest(np.arange(40)[a:a + 1], names, queries[a:a + 1], cases, 7) for a in range(40)]
    assert [tuple(r) for g in got for r in g.to_numpy()] == [tuple(r) for r in want.to_numpy()]
    assert sizes[1] == 3000 and sum(sizes[2:]) < 38 * 100  # a query of zeros meets all, the others few


def test_exact_blocks_take_repeated_ids_and_text_ids(spark):
    queries, cases = unit(20, 8, 1), unit(30, 8, 2)
    q, c = frames(spark, queries, cases)
    twice = similar.blocked_topk(q.union(q), c.union(c), 4, similar.dot, "vector", block_rows=9)
    want = {(i, j) for i, j, _ in brute(queries, cases, 1)}
    rows = twice.collect()
    assert len(rows) == 20 * 4 and {(r.query_id, r.case_id) for r in rows} == want
    text = similar.blocked_topk(q.withColumn("query_id", F.concat(F.lit("q"), "query_id")),
                                c.withColumn("case_id", F.format_string("c%03d", "case_id")), 4, similar.dot, "vector", block_rows=9)
    assert {(int(r.query_id[1:]), int(r.case_id[1:]), r["rank"]) for r in text.collect()} == brute(queries, cases, 4)
    assert similar.blocked_topk(q, c.limit(0), 4, similar.dot, "vector").count() == 0
    assert similar.blocked_topk(q.limit(0), c, 4, similar.dot, "vector").count() == 0


def test_fewer_cases_than_k(spark):
    q, c = frames(spark, unit(3, 4, 1), unit(2, 4, 2))
    assert similar.vector_topk(q, c, 5).count() == 6


def test_lsh_recall_and_hot_bucket(spark):
    cases = unit(300, 16, 4, copies=True)
    queries = cases[90:150]
    q, c = frames(spark, queries, cases)
    exact = {(i, j) for i, j, _ in brute(queries, cases, 1)}
    found = {(r.query_id, r.case_id) for r in similar.vector_topk_lsh(q, c, 1, block_rows=20).collect()}
    assert len(exact & found) / len(exact) > 0.95


def test_lsh_recall_at_5_of_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"))

    def others(out):  # a query's own row is no achievement
        return {(r.query_id, r.case_id) for r in out.collect() if r.query_id != r.case_id}

    out = similar.vector_topk_lsh(q, c)
    exact, found = others(similar.vector_topk(q, c)), others(out)
    assert len(exact & found) / len(exact) >= 0.9
    assert out.first()["recall"] >= 0.9
    assert out.count() == 5 * rows.count()


def test_signatures_leave_in_pieces_of_bounded_size(spark, monkeypatch):
    """All tables of a whole input batch would be held at once otherwise."""
    q, _ = frames(spark, unit(50, 8, 9), unit(1, 8, 9))
    whole = sorted(tuple(r) for r in similar.signatures(q.coalesce(1), "query_id", "vector", 8, 6, 4, 3).select("query_id", "bucket").collect())
    monkeypatch.setattr(similar, "SIGNED_ROWS", 7)
    parts = sorted(tuple(r) for r in similar.signatures(q.coalesce(1), "query_id", "vector", 8, 6, 4, 3).select("query_id", "bucket").collect())
    assert parts == whole and len(parts) == 50 * 6


def test_lsh_short_queries_are_searched_exactly(spark):
    queries, cases = unit(40, 16, 5), unit(30, 16, 6)
    q, c = frames(spark, queries, cases)
    out = similar.vector_topk_lsh(q, c, 5, tables=1, bits=8)
    assert out.count() == 5 * 40 and out.first()["recall"] < 0.9


def test_text_search_deals_cases_not_terms(spark):
    """A term of most cases is no task of its own: only the cases are dealt, and a task sends its best hits."""
    docs = [(i if i % 7 else None, "A", f"fraud case {i % 5}" + " ring" * (i % 3)) for i in range(60)] + [(1, "A", "fraud ring"), (99, "A", None)]
    asked = spark.createDataFrame([(1, "fraud ring"), (2, "ring 3"), (None, "case 4"), (3, None)], "query_id long, text string")
    out = similar.text_search(spark.createDataFrame(docs, "case_id long, case_type string, text string"), asked, k=3)
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(case_id" in plan and "hashpartitioning(term" not in plan and "WindowGroupLimit" in plan

    cases = {}
    for case, _, text in docs:
        for term in (text or "").split():
            cases.setdefault(case, {}).setdefault(term, 0)
            cases[case][term] += 1
    rare = {t: np.log10(len(docs) / sum(t in c for c in cases.values())) ** 2 for t in {t for c in cases.values() for t in c}}
    want = set()
    for query, text in ((1, "fraud ring"), (2, "ring 3"), (None, "case 4")):
        hits = [(-round(sum(c.get(t, 0) * rare.get(t, 0) for t in text.split()), 6), i is not None, i) for i, c in cases.items()]
        hits = sorted((h for h in hits if h[0] < 0), key=lambda h: (h[0], h[1], h[2] or 0))[:3]
        want |= {(query, i, -score, rank) for rank, (score, _, i) in enumerate(hits, 1)}
    assert {(r.query_id, r.case_id, r.similarity, r.rank) for r in out.collect()} == want


def test_text_search_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Älter", "的"]
    docs = [(i, rng.choice(["FRAUD", "AML"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    asked = [(i, ", ".join(rng.choice(words) for _ in range(6))) for i in range(9)]
    out = similar.text_search(spark.createDataFrame(docs, "case_id long, case_type string, text string"),
                              spark.createDataFrame(asked, "query_id long, text string"), 4, "AML")
    pool = [(i, t.lower().split()) for i, kind, t in docs if kind == "AML"]
    want = set()
    for qid, text in asked:
        terms = set(text.lower().split(", "))
        scored = []
        for i, tokens in pool:
            s = sum(tokens.count(t) * np.log10(len(pool) / sum(t in d for _, d in pool)) ** 2 for t in terms if t in tokens)
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        want |= {(qid, i, r) for r, (_, i) in enumerate(sorted(scored)[:4], 1)}
    assert {(r.query_id, r.case_id, r["rank"]) for r in out.collect()} == want


def test_embed_with_function_and_pipeline(spark):
    df = spark.createDataFrame([("1", "a b c"), ("2", "a"), ("3", None)], "case_id string, text string")
    lengths = lambda texts: np.array([[len(t), 1.0] for t in texts])
    vectors = [np.array(r.vector) for r in similar.embed(df, "text", lengths).collect()]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors)
    encoder = similar.fit_encoder(df.dropna(), "text", 64)
    assert [len(r.vector) for r in similar.embed(df.dropna(), "text", encoder).collect()] == [64, 64]


def test_index_append_checks_dimension(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    index = similar.case_index_append(None, df, "id", "v", 2)
    grown = similar.case_index_append(index, df.withColumn("id", F.col("id") + 10), "id", "v", 2)
    assert [(r.id, r.position) for r in grown.orderBy("position").collect()] == [(1, 0), (3, 1), (11, 2), (13, 3)]
    with pytest.raises(ValueError):
        similar.case_index_append(index, df, "id", "v", 3)


def test_positions_across_ranges(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    got = [r.position for r in similar.with_position(df, "k", 5).orderBy("k").collect()]
    assert got == list(range(5, 5 + 143))


def test_blacklist_periods(spark):
    listing = spark.sql("""select * from values ('h', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-10', true),
        ('h', timestamp_ntz'2024-01-05', timestamp_ntz'2024-01-20', true), ('h', timestamp_ntz'2024-02-01', null, true),
        ('off', timestamp_ntz'2024-01-01', null, false) as t(entity_hash, effective_time, expire_time, enabled)""")
    txn = spark.sql("""select * from values (1, 'h', timestamp_ntz'2024-01-01'), (2, 'h', timestamp_ntz'2024-01-07'),
        (3, 'h', timestamp_ntz'2024-01-20'), (4, 'h', timestamp_ntz'2024-03-01'), (5, 'off', timestamp_ntz'2024-01-02'),
        (6, null, timestamp_ntz'2024-01-02'), (7, 'h', timestamp_ntz'2023-12-31') as t(id, counterparty_hash, transaction_time)""")
    flags = {r.id: r.sanction_matched for r in joins.match_blacklist(txn, listing).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    assert {r.id for r in joins.blacklist_hits(txn, listing).collect()} == {1, 2, 4}
    assert {r.id for r in joins.blacklist_clean(txn, listing).collect()} == {3, 5, 6, 7}


def test_csv_and_json(spark):
    folder = new_folder(spark, "csv")
    spark.createDataFrame([("# comment",), ("6222,h1,50000.00,EBANK,D1,1.1.1.1,false,true",)], "line string").coalesce(1).write.text(folder)
    rows = readers.load_csv(spark, folder).collect()
    assert len(rows) == 1 and rows[0].is_cross_border and str(rows[0].amount) == "50000.00"
    record = writers.to_json_records(readers.load_csv(spark, folder), "account_hash", ["account_id", "ip"]).first()
    assert record.key == "h1" and json.loads(record.value) == {"account_id": "6222", "ip": "1.1.1.1"}


def test_parse_json_rejects(spark):
    payloads = ['{"transaction_id": "1", "extra": 5}', "", "{bad", "[]", '{"other": 1}', None]
    good, bad = ingest.parse_json(spark.createDataFrame([(p,) for p in payloads], "value string"))
    assert [r.transaction_id for r in good.collect()] == ["1"] and bad.count() == 5


def test_day_filter_is_pushed(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = readers.on_day(orders, "o_orderdate", "1997-05-28").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_alarm_needs_consecutive_steps(spark):
    audit = spark.sql("""select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as created_at, if(h in (1, 3, 4, 5), 'BLOCK', 'PASS') as decision,
        10 as processing_time_ms, false as search_empty from values (0), (1), (2), (3), (4), (5), (9) as t(h)""")
    out = kpi.alert_conditions(audit, "1 hour", 2)
    got = {(r.condition, r.step.hour) for r in out.collect()}
    assert got == {("high_block_share", 4), ("high_block_share", 5), ("no_rule_execution", 7), ("no_rule_execution", 8)}
