"""Registered queries: links, similar cases, alerts, cases, reports, indicators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import (
    case_search, compliance, ivf, kpi, latest, lifecycle, links, model, reports, scoring, similar,
)
from riskloom.plans import bindings as b
from riskloom.plans.catalogue import (
    FUSED, assessed, audit, enriched, merged_features, money, query, rounded, scored,
)
from riskloom.session import checkpointed, kept, materialise, new_folder
from riskloom.sources import writers

# --- links ---------------------------------------------------------------------------------------


def link_rows(spark, sf_dir):
    return b.events(spark, sf_dir).select(F.col("account_id").alias("customer_id"), "ip_address", "device_id",
                                          F.col("transaction_time").alias("trans_time"), "amount")


@query
def link_same_ip(spark, sf_dir):
    return links.link_by_key(link_rows(spark, sf_dir), "ip_address", "SAME_IP", 5).withColumns(money("total_amount"))


@query
def link_same_device(spark, sf_dir):
    return links.link_by_key(link_rows(spark, sf_dir), "device_id", "SAME_DEVICE", 3).withColumns(money("total_amount"))


@query
def link_burst(spark, sf_dir):
    out = links.link_burst(link_rows(spark, sf_dir), unit="hour", min_txn=2)
    return out.withColumns(money("total_amount"))


@query
def relationship_groups(spark, sf_dir):
    out = links.relationship_groups(link_rows(spark, sf_dir), b.BATCH_DATE, unit="hour", min_txn=2)
    return out.withColumns(money("total_amount"))


@query
def link_edges(spark, sf_dir):
    return links.relationship_edges(link_rows(spark, sf_dir), unit="hour", min_txn=2)


@query
def link_components(spark, sf_dir):
    """Rings of customers connected through shared addresses, devices and bursts."""
    edges = links.relationship_edges(link_rows(spark, sf_dir), unit="hour", min_txn=2)
    found = links.connected_components(links.star_edges(edges))
    return found.select(F.col("node").alias("customer_id"), "component")


# --- similar cases -------------------------------------------------------------------------------

def case_library(spark, sf_dir):
    return b.documents_as_cases(spark, sf_dir)


@query
def case_text(spark, sf_dir):
    return similar.case_text(case_library(spark, sf_dir)).select("case_id", "case_text")


@query
def txn_text(spark, sf_dir):
    deviation = F.round("amount_deviation", 4).cast("decimal(20,4)")
    return similar.txn_text(enriched(spark, sf_dir).withColumn("amount_deviation", deviation)).select("transaction_id", "txn_text")


def vectors(spark, sf_dir):
    return b.table(spark, sf_dir, "embeddings")


def topk(spark, sf_dir, k=5) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return similar.vector_topk(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                               rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector")), k)


@query
def vector_topk(spark, sf_dir):
    return topk(spark, sf_dir)


@query
def vector_topk_blocked(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return similar.vector_topk(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                               rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector")),
                               broadcast_bytes=0)


@query
def vector_topk_lsh(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return similar.vector_topk_lsh(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                                   rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector")))


def ivf_index(spark, sf_dir) -> tuple[DataFrame, ivf.Index]:
    rows = vectors(spark, sf_dir)
    cases = rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"))
    path = new_folder(spark, "vector-index")
    ivf.build(cases, path)
    return cases.withColumnRenamed("case_id", "query_id"), ivf.load(spark, path)


@query
def vector_topk_ivf(spark, sf_dir):
    """Exact top-k over the persisted index: further cells are probed as long as they can hold something better."""
    queries, index = ivf_index(spark, sf_dir)
    hits, _ = ivf.search(queries, index)
    return hits


@query
def vector_ivf_recall(spark, sf_dir):
    """Approximate search of the rows with ``vec_id % 100 = 0``: recall and shares of pairs scanned and compared."""
    queries, index = ivf_index(spark, sf_dir)
    asked = queries.filter("query_id % 100 = 0")
    probes = ivf.tuned_probes(queries, index, recall=0.95)
    exact, _ = ivf.search(asked, index)
    hits, counts = ivf.search(asked, index, probes=probes)
    found = exact.join(hits.select("query_id", "case_id", F.lit(1).alias("hit")), ["query_id", "case_id"], "left")
    total = int(index.sizes.sum())
    pairs = counts.agg(F.count("*").alias("queries"), (F.sum("scanned") / F.count("*") / total).alias("scanned"),
                       (F.sum("compared") / F.count("*") / total).alias("compared")).first()
    return found.agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall")).withColumns({
        "queries": F.lit(pairs["queries"]), "probes": F.lit(probes), "cells": F.lit(int((index.sizes > 0).sum())),
        "scanned": F.lit(pairs["scanned"]), "compared": F.lit(pairs["compared"])})


@query
def embed_cases_symbols(spark, sf_dir):
    """Components of the case vectors of the plain encoder."""
    out = similar.embed(similar.case_text(case_library(spark, sf_dir)), "case_text", case_search.symbol_counts)
    return out.select("case_id", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def embed_cases(spark, sf_dir):
    texts = similar.case_text(case_library(spark, sf_dir))
    out = similar.embed(texts, "case_text", similar.fit_encoder(texts, "case_text"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("case_id", F.size("vector").alias("dimension"), F.round(norm, 4).alias("norm"))


@query
def kb_relevance(spark, sf_dir):
    out = similar.kb_score(topk(spark, sf_dir, k=10))
    return out.select("query_id", F.round("kb_score", 6).alias("kb_score"),
                      F.array_join("similar_cases", ",").alias("similar_cases"))


@query
def rag_context(spark, sf_dir):
    key = F.col("vec_id")
    described = vectors(spark, sf_dir).select(
        key.alias("case_id"), F.concat(F.lit("Case "), key).alias("case_title"),
        F.concat(F.lit("TYPE-"), "label").alias("case_type"), F.concat(F.lit("pattern "), key % 7).alias("fraud_pattern"),
        F.concat(F.lit("method "), key % 5).alias("modus_operandi"), F.concat(F.lit("resolution "), key % 3).alias("resolution"),
        F.when(key % 2 == 0, F.concat(F.lit("effect "), key)).alias("resolution_effect"))
    return similar.rag_context(topk(spark, sf_dir), described)


@query
def case_index_stats(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    first = similar.case_index_append(None, rows.filter("label < 5"), "vec_id", "embedding", 64)
    index = similar.case_index_append(first, rows.filter("label >= 5"), "vec_id", "embedding", 64)
    return index.select("vec_id", "position", F.size("embedding").alias("dimension"))


@query
def case_index_rebuild(spark, sf_dir):
    """Positions over the whole library by its text ids."""
    rows = vectors(spark, sf_dir).withColumn("case_id", F.col("vec_id").cast("string"))
    index = similar.case_index_rebuild(rows, "case_id", "embedding", 64)
    return index.select("case_id", "position", F.size("embedding").alias("dimension"))


def _searched(spark, sf_dir, category: str | None) -> DataFrame:
    cases = case_library(spark, sf_dir).select(
        F.col("case_id").cast("bigint").alias("case_id"), "case_type",
        F.concat_ws(" ", "case_title", "case_description", "modus_operandi").alias("text"))
    asked = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return similar.text_search(cases, asked, category=category)


@query
def text_search(spark, sf_dir):
    return _searched(spark, sf_dir, "FRAUD")


@query
def text_search_all(spark, sf_dir):
    """The whole library."""
    return _searched(spark, sf_dir, None)


@query
def assess_with_cases(spark, sf_dir):
    """The assessment including the case search for every transaction."""
    from riskloom.plans import assess as flow
    rows = enriched(spark, sf_dir)
    found = similar.case_search(rows, case_library(spark, sf_dir))
    out = flow.assess(rows, sanctions=b.sanctions(b.events(spark, sf_dir)), similar=found, stand_in=True)
    return out.select(*FUSED, F.round("kb_score", 4).alias("kb_score"), F.array_join("similar_cases", ",").alias("similar_cases"))


@query
def assess_with_library(spark, sf_dir):
    """The assessment with the case search of every transaction over a persisted index."""
    from riskloom.plans import assess as flow
    rows = materialise(enriched(spark, sf_dir), "enriched")
    path = new_folder(spark, "case-library")
    case_search.build_library(case_library(spark, sf_dir), path)
    plain = rows.withColumn("amount_deviation", F.round("amount_deviation", 4).cast("decimal(20,4)"))
    found = case_search.search_library(plain, ivf.load(spark, path))
    out = flow.assess(rows, sanctions=b.sanctions(b.events(spark, sf_dir)), similar=found, stand_in=True)
    return out.select(*FUSED, F.round("kb_score", 6).alias("kb_score"), F.array_join("similar_cases", ",").alias("similar_cases"))


def _held_out_scores(spark, sf_dir, *keep: str) -> DataFrame:
    """``keep``, label and score of the accounts that a model trained on the other four fifths has not seen.

    The label (an urgent order of the customer) comes from another table than the features.
    """
    urgent = (b.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
              .select(F.col("o_custkey").cast("string").alias("urgent_account")).distinct())
    rows = (scored(spark, sf_dir).drop("fraud_probability", "model_version")
            .join(urgent, F.col("account_id") == F.col("urgent_account"), "left")
            .withColumn("label", F.col("urgent_account").isNotNull().cast("double")))
    held = F.pmod(F.crc32(F.col("account_id").cast("binary")), F.lit(5)) == 0
    # the fit reads its rows more than once
    known = kept(rows.filter(~held).select("label", "features"))
    try:
        fitted = model.train_model(known, "label")
    finally:
        known.unpersist()
    return model.score_model(rows.filter(held).select(*keep, "label", "features"), fitted).drop("features")


@query
def model_scoring(spark, sf_dir):
    return _held_out_scores(spark, sf_dir, "transaction_id")


@query
def model_auc(spark, sf_dir):
    """Area under the curve on the held-out accounts."""
    # the curve is cut into bins by partitions, so it has to see those that the scores come in
    held = checkpointed(_held_out_scores(spark, sf_dir).select("label", "fraud_probability"))
    auc = model.area_under_curve(held, "label")
    return held.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives")).withColumn("auc", F.lit(auc))


# --- alerts and cases ----------------------------------------------------------------------------

def alerts(spark, sf_dir) -> DataFrame:
    return lifecycle.create_alerts(scored(spark, sf_dir))


@query
def alerts_created(spark, sf_dir):
    return alerts(spark, sf_dir)


@query
def alert_messages(spark, sf_dir):
    """Alert topic records."""
    rows = alerts(spark, sf_dir).withColumn("risk_score", F.col("risk_score").cast("string"))
    return writers.to_json_records(rows, "transaction_id", ["alert_id", "transaction_id", "risk_level", "alert_status"])


@query
def alert_state(spark, sf_dir):
    return lifecycle.fold_alerts(b.alert_actions(spark, sf_dir))


@query
def alert_status_counts(spark, sf_dir):
    return lifecycle.status_counts(lifecycle.fold_alerts(b.alert_actions(spark, sf_dir)), "alert_status")


@query
def alert_overdue(spark, sf_dir):
    out = lifecycle.sla_sweep(alerts(spark, sf_dir), b.AS_OF)
    return out.select("alert_id", "transaction_id", "alert_status", "escalation_level", "processing_deadline")


@query
def alert_page(spark, sf_dir):
    rows = lifecycle.fold_alerts(b.alert_actions(spark, sf_dir))
    return lifecycle.page(rows, [F.col("updated_at"), F.col("alert_id")], 1, 10, "CLOSED")


@query
def alert_page_after(spark, sf_dir):
    """The second page by the last key of the first one."""
    rows = materialise(lifecycle.fold_alerts(b.alert_actions(spark, sf_dir)), "alert-states")
    order = ["updated_at", "alert_id"]
    first = lifecycle.page_after(rows, order, 10, status="CLOSED").collect()  # a page
    last = max((r["updated_at"], r["alert_id"]) for r in first) if first else None
    return lifecycle.page_after(rows, order, 10, last, "CLOSED")


@query
def alert_page_overflow(spark, sf_dir):
    rows = lifecycle.fold_alerts(b.alert_actions(spark, sf_dir))
    return lifecycle.page(rows, [F.col("updated_at"), F.col("alert_id")], 100000, 10, "CLOSED")


@query
def alert_page_total(spark, sf_dir):
    rows = lifecycle.fold_alerts(b.alert_actions(spark, sf_dir))
    parts = [lifecycle.page_summary(rows, 1, 10, status, mode=mode).select(
        F.lit(status).alias("status"), F.lit(mode).alias("mode"), "total", "page", "size")
        for status, mode in (("CLOSED", "literal"), ("ALL", "literal"), ("ALL", "intent"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def cases_created(spark, sf_dir):
    return lifecycle.create_cases(alerts(spark, sf_dir)).select("case_id", "alert_id", "case_status", "priority", "created_at")


@query
def case_priority(spark, sf_dir):
    cases = b.orders_as_cases(spark, sf_dir).withColumn("priority", lifecycle.priority(F.col("risk_level")))
    return cases.groupBy("priority", "case_status").agg(F.count("*").alias("n"))


@query
def case_stats(spark, sf_dir):
    return lifecycle.case_stats(b.orders_as_cases(spark, sf_dir))


@query
def case_state(spark, sf_dir):
    return lifecycle.fold_cases(b.case_actions(spark, sf_dir))


@query
def case_durations(spark, sf_dir):
    out = lifecycle.case_durations(b.case_actions(spark, sf_dir), b.AS_OF)
    return out.withColumns(rounded("seconds", places=3))


@query
def case_page(spark, sf_dir):
    cases = b.orders_as_cases(spark, sf_dir)
    return lifecycle.page(cases, [F.col("created_at").desc(), F.col("case_id")], 2, 20, "INVESTIGATING",
                          "case_status", overflow="empty")


# --- reports and indicators ----------------------------------------------------------------------

def suspicious(spark, sf_dir) -> DataFrame:
    return compliance.suspicious_report(b.ledger(spark, sf_dir), b.BATCH_DATE)


def latest_case(spark, sf_dir) -> DataFrame:
    return latest.latest_per_key(b.orders_as_cases(spark, sf_dir), ["customer_id"], ["created_at", "case_id"])


@query
def report_compliance(spark, sf_dir):
    return reports.compliance_report(suspicious(spark, sf_dir), latest_case(spark, sf_dir)).withColumns(money("amount"))


@query
def report_base(spark, sf_dir):
    """Alerts with their transactions, cases (two thirds have one, in several states) and customers."""
    raised = alerts(spark, sf_dir)
    key = F.col("transaction_id").cast("long")
    cases = lifecycle.create_cases(raised).filter(key % 3 != 0).withColumns({
        "case_status": F.element_at(F.array(*[F.lit(s) for s in ("NEW", "ASSIGNED", "INVESTIGATING", "CLOSED")]), (key % 4 + 1).cast("int")),
        "updated_at": F.col("created_at") + F.expr("make_dt_interval(cast(transaction_id % 50 as int))")})
    stale = cases.withColumns({"case_status": F.lit("NEW"), "updated_at": F.col("created_at") - F.expr("interval 1 hour")})
    out = reports.report_base(raised, b.events(spark, sf_dir), cases.unionByName(stale), b.customers(spark, sf_dir))
    return out.withColumns(money("amount"))


@query
def report_customer_risk(spark, sf_dir):
    scores = scoring.batch_risk_scores(b.ledger(spark, sf_dir, parties=False), b.customers(spark, sf_dir), b.BATCH_DATE)
    return reports.customer_risk_report(scores, b.orders_as_cases(spark, sf_dir), suspicious(spark, sf_dir))


def _periodic(spark, sf_dir, grain):
    out = reports.kpi_report(suspicious(spark, sf_dir), b.orders_as_cases(spark, sf_dir), grain)
    return out.withColumns(rounded("change"))


@query
def report_daily(spark, sf_dir):
    return _periodic(spark, sf_dir, "daily")


@query
def report_weekly(spark, sf_dir):
    return _periodic(spark, sf_dir, "weekly")


@query
def report_monthly(spark, sf_dir):
    return _periodic(spark, sf_dir, "monthly")


def decisions(spark, sf_dir) -> DataFrame:
    """The columns of the decision log that the indicators read."""
    return scored(spark, sf_dir, "online").select(
        F.col("transaction_time").alias("created_at"), "decision", F.col("value").cast("int").alias("processing_time_ms"),
        (F.col("rule_count") == 0).alias("search_empty"), "matched_rules")


@query
def kpi_latency(spark, sf_dir):
    out = kpi.latency_windows(decisions(spark, sf_dir), "1 hour")
    return out.withColumns(rounded("p50_ms", "p95_ms", "p99_ms", places=4))


@query
def kpi_decision_rate(spark, sf_dir):
    out = kpi.decision_rates(decisions(spark, sf_dir), "1 hour", "30 minutes", 3600)
    return out.withColumns(rounded("per_second", places=9))


@query
def kpi_rule_rate(spark, sf_dir):
    hits = decisions(spark, sf_dir).select("created_at", F.explode("matched_rules.rule_id").alias("rule_id"))
    return kpi.rule_rates(hits, "1 day", 86400).withColumns(rounded("per_second", places=9))


@query
def alert_conditions(spark, sf_dir):
    return kpi.alert_conditions(decisions(spark, sf_dir), "1 hour", 2, latency_ms=90.0, block_share=0.05, empty_share=0.1)


# --- sinks ---------------------------------------------------------------------------------------

@query
def json_encode(spark, sf_dir):
    rows = b.events(spark, sf_dir).select("account_id", "transaction_id", "transaction_type", "k", "is_cross_border")
    return writers.to_json_records(rows, "account_id")


@query
def feature_store_latest(spark, sf_dir):
    rows = enriched(spark, sf_dir).select(
        "account_id", "transaction_time", "count_1h", "count_24h", "device_count_30d", "city_count_30d",
        "counterparty_count_30d", "is_night_time", "is_cross_border", "is_first_device", "ip_risk_level",
        *[c.alias(n) for n, c in money("amount_1h", "amount_24h").items()])
    return latest.feature_store(rows, "account_id", "transaction_time")


@query
def sink_overwrite(spark, sf_dir):
    """Scores written per batch date and one date rerun: the other date stays."""
    path = new_folder(spark, "customer-scores")
    txn, profile = b.ledger(spark, sf_dir, parties=False), b.customers(spark, sf_dir)
    for day in ("2024-01-30", "2024-01-31", "2024-01-31"):
        scores = scoring.batch_risk_scores(txn, profile, day).select("customer_id", "risk_score", "risk_level", "batch_date")
        writers.write_table(scores, path, partition_by=["batch_date"])
    return spark.read.parquet(path).withColumn("batch_date", F.col("batch_date").cast("string"))


@query
def sink_append(spark, sf_dir):
    path = new_folder(spark, "offline-features")
    writers.write_features(merged_features(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select("customer_id_hash", "total_count_30d", "night_count_30d", "weekend_count_30d",
                         "channel_diversity_30d", "merchant_diversity_30d", "feature_version", "computed_at",
                         *[c.alias(n) for n, c in money("total_amount_30d", "max_amount_30d").items()])


@query
def offline_feature_store(spark, sf_dir):
    """Offline features per account as store records with their own key prefix."""
    rows = merged_features(spark, sf_dir).select(
        "customer_id_hash", "total_count_30d", "night_count_30d", "channel_diversity_30d", "computed_at",
        *[c.alias(n) for n, c in (money("total_amount_30d", "max_amount_30d")
                                  | rounded("avg_amount_30d", "std_amount_30d", "avg_daily_count_30d", "amount_deviation_ratio",
                                            "frequency_deviation_ratio", places=4)).items()])
    return latest.feature_store(rows, "customer_id_hash", "computed_at", prefix="risk:offline_feature:")


@query
def enriched_nested(spark, sf_dir):
    """Enriched record with the transaction as a nested struct, flattened again for a sink."""
    from riskloom.streaming.pipeline import nest
    rows = enriched(spark, sf_dir)
    record = nest(rows, ["transaction_id", "account_id", "transaction_type", "amount", "ip_risk_level"])
    return record.select("transaction.transaction_id", "transaction.transaction_type", "count_24h", "is_first_device",
                         F.col("transaction.amount").cast("double").alias("amount"))
