"""Registered queries: every operator bound to the given tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables.
Money leaves as double, ratios are rounded last, sets leave as one row per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import cleaning, compliance, features, fusion, joins, latest, model, partials, rules, scoring
from riskloom.plans import assess as flow
from riskloom.plans import bindings as b
from riskloom.session import new_folder
from riskloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def money(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}


def rounded(*names: str, places: int = 6) -> dict[str, Column]:
    return {n: F.round(F.col(n).cast("double"), places) for n in names}


ACCOUNT_ROW = ("transaction_id", "account_id", "transaction_time", "transaction_type", "amount")


# --- sources -------------------------------------------------------------------------------------

@query
def scan_day(spark, sf_dir):
    day = readers.on_day(b.ledger(spark, sf_dir, parties=False), "trans_time", b.LEDGER_DAY)
    return day.withColumns(money("amount"))


@query
def scan_lookback(spark, sf_dir):
    rows = readers.last_days(b.events(spark, sf_dir), "transaction_time", b.AS_OF, 14)
    return rows.select("transaction_id", "account_id", "transaction_time", *[c.alias(n) for n, c in money("amount").items()])


@query
def scan_customers(spark, sf_dir):
    return readers.load_customers(b.customers(spark, sf_dir))


@query
def cdc_latest(spark, sf_dir):
    return latest.apply_cdc(b.profile_log(spark, sf_dir), ["customer_id"], "seq")


@query
def kb_load_cases(spark, sf_dir):
    cases = readers.load_cases(b.documents_as_cases(spark, sf_dir), "n_chars bigint")
    return cases.withColumn("key_features", F.col("key_features.n_chars")).drop("created_at")


@query
def load_csv(spark, sf_dir):
    """Events written as a header-less file with comment lines and read back."""
    path = new_folder(spark, "load-file")
    rows = b.events(spark, sf_dir).selectExpr(
        "account_id", "sha2(account_id, 256) as account_hash", "amount", "channel_code as channel", "device_id",
        "ip_address as ip", "is_emulator", "is_cross_border", "event_id")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns[:-1]])
    lines = rows.select(F.explode(F.when(F.col("event_id") % 100 == 0, F.array(F.lit("# note, with, commas"), line))
                                  .otherwise(F.array(line))).alias("value"))
    lines.write.text(path)
    return readers.load_csv(spark, path).withColumns(money("amount"))


# --- cleaning ------------------------------------------------------------------------------------

@query
def clean_valid_amount(spark, sf_dir):
    rows = cleaning.filter_valid_amount(b.raw_events(spark, sf_dir))
    return rows.select("event_id", F.col("amount").cast("double").alias("amount"))


@query
def validate_report(spark, sf_dir):
    return cleaning.validation_report(b.raw_events(spark, sf_dir))


@query
def clean_standardise(spark, sf_dir):
    rows = cleaning.standardise(b.raw_events(spark, sf_dir))
    return rows.select("event_id", F.col("amount").cast("double").alias("amount"), "currency", "channel_code",
                       "is_extreme_amount")


@query
def clean_hash(spark, sf_dir):
    return cleaning.hash_pii(b.raw_events(spark, sf_dir)).select("event_id", "account_id_hash", "counterparty_hash")


@query
def clean_gps(spark, sf_dir):
    rows = cleaning.coarsen_gps(b.raw_events(spark, sf_dir))
    return rows.select("event_id", *[c.alias(n) for n, c in money("gps_lat", "gps_lng").items()])


@query
def ip_risk(spark, sf_dir):
    return cleaning.classify_ip(b.raw_events(spark, sf_dir)).select("event_id", "ip_risk_level")


@query
def ip_risk_keep_stronger(spark, sf_dir):
    return cleaning.classify_ip(b.raw_events(spark, sf_dir), keep_stronger=True).select("event_id", "ip_risk_level")


@query
def clean_chain(spark, sf_dir):
    good, _ = cleaning.validate(b.raw_events(spark, sf_dir))
    return cleaning.clean(good).select(
        "event_id", "account_id_hash", "counterparty_hash", F.col("amount").cast("double").alias("amount"),
        "currency", "channel_code", "ip_risk_level")


def _padded(key: Column, width: int) -> Column:
    """Zeros up to ``width``; longer keys stay whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


@query
def mask_pii(spark, sf_dir):
    key = F.col("c_custkey")
    rows = b.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("138"), _padded(key, 8)).alias("phone"),
        F.concat(F.lit("110101199001"), _padded(key, 6)).alias("id_card"),
        F.concat(F.lit("6222"), _padded(key, 12)).alias("bank_card"),
        key.cast("string").alias("short_card"))
    return cleaning.mask_columns(rows, {"phone": "phone", "id_card": "id_card", "bank_card": "bank_card",
                                        "short_card": "bank_card"})


@query
def time_flags(spark, sf_dir):
    rows = cleaning.time_flags(b.raw_events(spark, sf_dir))
    return rows.select("event_id", "is_night_time", "is_weekend")


@query
def request_defaults(spark, sf_dir):
    rows = cleaning.apply_defaults(b.raw_events(spark, sf_dir).drop("transaction_id"))
    return rows.select("event_id", "account_id", "currency", "ip_address", "ip_risk_level", "counterparty_hash",
                       F.col("amount").cast("double").alias("amount"))


@query
def dedup_batch(spark, sf_dir):
    txn = latest.dedup(b.ledger(spark, sf_dir, parties=False), ["transaction_id"],
                       ["trans_time", "customer_id", "target_account", "amount"])
    return txn.withColumns(money("amount"))


# --- joins ---------------------------------------------------------------------------------------

@query
def join_profile(spark, sf_dir):
    stats = scoring.customer_stats(b.ledger(spark, sf_dir, parties=False))
    joined = scoring.enrich_profile(stats, b.customers(spark, sf_dir))
    return joined.select("customer_id", "txn_count", "customer_name", "account_type", "risk_level")


def _ledger_with_hash(spark, sf_dir):
    return b.ledger(spark, sf_dir, parties=False).withColumn(
        "counterparty_hash", F.sha2(F.col("target_account").cast("string"), 256))


def _ledger_rows(df):
    return df.select("transaction_id", "customer_id", "trans_time", "target_account", F.col("amount").cast("double").alias("amount"))


@query
def blacklist_hits(spark, sf_dir):
    return _ledger_rows(joins.blacklist_hits(_ledger_with_hash(spark, sf_dir), b.blacklist(spark, sf_dir), ts="trans_time"))


@query
def blacklist_clean(spark, sf_dir):
    return _ledger_rows(joins.blacklist_clean(_ledger_with_hash(spark, sf_dir), b.blacklist(spark, sf_dir), ts="trans_time"))


@query
def blacklist_flags(spark, sf_dir):
    flagged = joins.match_blacklist(_ledger_with_hash(spark, sf_dir), b.blacklist(spark, sf_dir), ts="trans_time")
    return (flagged.groupBy("sanction_matched", "sanction_detail")
            .agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total_amount")))


@query
def country_flags(spark, sf_dir):
    flagged = joins.flag_country(b.events(spark, sf_dir))
    return flagged.select("transaction_id", "is_fatf_country", "is_war_country")


@query
def info_changed_flag(spark, sf_dir):
    ev = b.events(spark, sf_dir)
    out = features.realtime_features(ev.select(*ACCOUNT_ROW), rolling=False, history=False, diversity=False,
                                     profile_changes=b.profile_changes(ev))
    return out.select("transaction_id", "info_changed_recently")


# --- customer scoring and compliance -------------------------------------------------------------

STATS = ("total_amount", "avg_amount", "max_amount", "min_amount", "stddev_amount")


@query
def customer_stats(spark, sf_dir):
    stats = scoring.customer_stats(b.ledger(spark, sf_dir, parties=False))
    return stats.withColumns(money("total_amount", "max_amount", "min_amount") | rounded("avg_amount", "stddev_amount", places=4))


@query
def batch_risk_scores(spark, sf_dir):
    scores = scoring.batch_risk_scores(b.ledger(spark, sf_dir, parties=False), b.customers(spark, sf_dir), b.BATCH_DATE)
    return scores.withColumns(money("total_amount", "max_amount", "min_amount") | rounded("avg_amount", "stddev_amount", places=4))


@query
def split_days(spark, sf_dir):
    days = compliance.daily_split_candidates(b.ledger(spark, sf_dir, parties=False))
    return days.withColumns(money("daily_total", "min_amount", "max_amount"))


@query
def compliance_large(spark, sf_dir):
    return compliance.detect_large(b.ledger(spark, sf_dir)).withColumns(money("amount"))


@query
def compliance_split(spark, sf_dir):
    return compliance.detect_split(b.ledger(spark, sf_dir)).withColumns(money("amount"))


@query
def compliance_cross_border(spark, sf_dir):
    return compliance.detect_cross_border(b.ledger(spark, sf_dir)).withColumns(money("amount"))


@query
def suspicious_report(spark, sf_dir):
    return compliance.suspicious_report(b.ledger(spark, sf_dir), b.BATCH_DATE).withColumns(money("amount"))


@query
def compliance_summary(spark, sf_dir):
    report = compliance.suspicious_report(b.ledger(spark, sf_dir), b.BATCH_DATE)
    return compliance.compliance_summary(report).withColumns(money("total_amount"))


# --- account features ----------------------------------------------------------------------------

def _profiled(spark, sf_dir):
    rows = readers.last_days(b.events(spark, sf_dir), "transaction_time", b.AS_OF, 30)
    return rows.withColumn("account_id_hash", F.col("account_id"))


FEATURE_RATIOS = ("avg_amount_30d", "std_amount_30d", "avg_daily_count_30d")
FEATURE_MONEY = ("total_amount_30d", "max_amount_30d", "min_amount_30d")
DEVIATION_RATIOS = ("recent7d_avg_amount", "prior21d_avg_amount", "prior21d_daily_avg",
                    "amount_deviation_ratio", "frequency_deviation_ratio")


@query
def features_30d(spark, sf_dir):
    out = features.account_features_30d(_profiled(spark, sf_dir))
    return out.withColumns(money(*FEATURE_MONEY) | rounded(*FEATURE_RATIOS, places=4))


@query
def features_30d_partials(spark, sf_dir):
    """The same features merged from stored days; the last day is run twice."""
    path = new_folder(spark, "daily-partials")
    rows = _profiled(spark, sf_dir)
    partials.write_days(partials.daily_partials(rows), path)
    partials.write_days(partials.daily_partials(rows.filter(F.to_date("transaction_time") == F.date_sub(F.to_date(F.lit(b.AS_OF)), 1))), path)
    out = partials.features_from_partials(spark, path, b.AS_OF)
    return out.withColumns(money(*FEATURE_MONEY) | rounded(*FEATURE_RATIOS, places=4))


@query
def deviation_features(spark, sf_dir):
    out = features.deviation_features(_profiled(spark, sf_dir), b.AS_OF)
    return out.withColumns(rounded(*DEVIATION_RATIOS, places=4))


def merged_features(spark, sf_dir):
    rows = _profiled(spark, sf_dir)
    return features.merge_features(features.account_features_30d(rows), features.deviation_features(rows, b.AS_OF), b.AS_OF)


@query
def features_merged(spark, sf_dir):
    return merged_features(spark, sf_dir).withColumns(
        money(*FEATURE_MONEY) | rounded(*FEATURE_RATIOS, *DEVIATION_RATIOS, places=4))


@query
def diversity_30d(spark, sf_dir):
    return features.diversity_30d(_profiled(spark, sf_dir))


@query
def rolling_1h_24h(spark, sf_dir):
    rows = b.events(spark, sf_dir).select(*ACCOUNT_ROW)
    out = features.realtime_features(rows, history=False, diversity=False)
    return out.select("transaction_id", "count_1h", "count_24h",
                      *[c.alias(n) for n, c in money("amount_1h", "amount_24h", "inflow_1h").items()])


@query
def diversity_asof(spark, sf_dir):
    rows = b.events(spark, sf_dir).select(*ACCOUNT_ROW, "device_id", "ip_city", "counterparty_hash")
    out = features.realtime_features(rows, rolling=False, history=False)
    return out.select("transaction_id", *features.DIVERSITY)


@query
def first_device(spark, sf_dir):
    rows = b.events(spark, sf_dir).select(*ACCOUNT_ROW, "device_id", "ip_city", "counterparty_hash")
    return features.first_device(rows).select("transaction_id", "is_first_device")


@query
def first_device_intent(spark, sf_dir):
    rows = b.events(spark, sf_dir).select(*ACCOUNT_ROW, "device_id")
    return features.first_device(rows, mode="intent").select("transaction_id", "is_first_device")


@query
def amount_deviation(spark, sf_dir):
    rows = b.events(spark, sf_dir).select(*ACCOUNT_ROW)
    out = features.realtime_features(rows, rolling=False, diversity=False)
    return out.select("transaction_id", F.round("amount_deviation", 6).alias("amount_deviation"))


# --- rules, model, fusion ------------------------------------------------------------------------

def enriched(spark, sf_dir) -> DataFrame:
    """Events with all real-time features and profile signals, from one shuffle by account."""
    ev = b.events(spark, sf_dir)
    return features.realtime_features(ev, profile_changes=b.profile_changes(ev))


def with_sanctions(spark, sf_dir) -> DataFrame:
    return joins.match_blacklist(enriched(spark, sf_dir), b.sanctions(b.events(spark, sf_dir)))


def scored(spark, sf_dir, policy: str = "engine") -> DataFrame:
    return flow.score(with_sanctions(spark, sf_dir), policy, stand_in=True)


def assessed(spark, sf_dir, policy: str = "online") -> DataFrame:
    return flow.assess(enriched(spark, sf_dir), sanctions=b.sanctions(b.events(spark, sf_dir)), policy=policy, stand_in=True)


@query
def rule_hits(spark, sf_dir):
    hits = rules.explode_hits(rules.evaluate_rules(with_sanctions(spark, sf_dir)), "transaction_id")
    return hits.select("transaction_id", "rule_id", "rule_name", "risk_weight", "risk_level", "risk_score")


@query
def rule_hits_intent(spark, sf_dir):
    hits = rules.explode_hits(rules.evaluate_rules(with_sanctions(spark, sf_dir), mode="intent"), "transaction_id")
    return hits.select("transaction_id", "rule_id")


@query
def rules_enabled(spark, sf_dir):
    """Hits of the rules that a table switches on, with its weights and levels.

    The table also holds rows that must neither run nor stop anything: quotes, NULLs, unknown levels and rules.
    """
    table = rules.definitions(spark).withColumns({
        "enabled": F.col("risk_weight") != 30, "risk_weight": (F.col("risk_weight") + 5).cast("int"), "version": F.lit(2)})
    odd = spark.createDataFrame([
        ("R004", "IT'S", None, 500, "X' || version() || '", "a 'b'", True, 2), ("R202", "n", None, None, "HIGH", "d", True, 2),
        ("R203", "n", None, 500, "IT'S", "d", True, 2), ("R204", "n", None, 500, None, "d", True, 2),
        ("X' or 1=1", "n", None, 500, "HIGH", "d", True, 2), (None, "n", None, 500, "HIGH", "d", True, 2),
        ("R206", "n", None, -1, "LOW", "d", True, 2), ("R305", "n", None, 500, "HIGH", "d", None, 2)], table.schema)
    table = table.unionByName(odd)
    hits = rules.explode_hits(rules.evaluate_rules(with_sanctions(spark, sf_dir), rules.load_rules(table)), "transaction_id")
    return hits.groupBy("rule_id", F.col("risk_weight").alias("weight"), F.col("risk_level").alias("level")).agg(
        F.count("*").alias("hits")).withColumn("version", F.lit(2))


@query
def rules_rejected(spark, sf_dir):
    """Enabled rows of the watch list read as a rule table: none can be used, each says why."""
    table = b.blacklist(spark, sf_dir).selectExpr(
        "if(entity_value % 3 = 0, 'R001', concat('X', entity_value)) as rule_id", "list_type as rule_name", "entity_type as rule_category",
        "if(entity_value % 2 = 0, null, 10) as risk_weight", "concat(\"it's \", entity_value) as risk_level", "entity_hash as description",
        "enabled", "1 as version")
    return rules.rejected_rules(table).groupBy("reason").agg(F.count("*").alias("n"))


@query
def rule_score(spark, sf_dir):
    out = rules.rule_score(rules.evaluate_rules(with_sanctions(spark, sf_dir)))
    return out.select("transaction_id", "rule_score", "rule_count", "total_weight", "highest_risk_level")


@query
def rule_hit_stats(spark, sf_dir):
    return rules.rule_stats(rules.evaluate_rules(with_sanctions(spark, sf_dir)))


@query
def risk_factors(spark, sf_dir):
    out = rules.risk_factors(scored(spark, sf_dir))
    return out.select("transaction_id", F.array_join("risk_factors", "|").alias("risk_factors"))


@query
def feature_vector(spark, sf_dir):
    out = model.feature_vector(enriched(spark, sf_dir))
    return out.select("transaction_id", *[F.expr(f"round(features[{i}], 6) as v{i}") for i in range(32)])


@query
def model_fallback(spark, sf_dir):
    out = flow.score(with_sanctions(spark, sf_dir), "batch")
    return out.select("transaction_id", "fraud_probability", "model_version", "risk_score", "decision")


@query
def feature_contributions(spark, sf_dir):
    out = model.top_contributions(model.feature_vector(enriched(spark, sf_dir)))
    return out.select("transaction_id", F.posexplode("top_features").alias("pos", "f")).select(
        "transaction_id", "pos", "f.feature_name", "f.shap_value")


@query
def feature_contributions_intent(spark, sf_dir):
    out = model.top_contributions(model.feature_vector(enriched(spark, sf_dir)), k=1, mode="intent")
    return out.select("transaction_id", F.round(F.col("top_features")[0]["shap_value"], 6).alias("top_value"))


FUSED = ("transaction_id", "risk_score", "risk_level", "decision", "confidence", "rule_score", "ml_score")


@query
def fusion_engine(spark, sf_dir):
    return scored(spark, sf_dir, "engine").select(*FUSED)


@query
def fusion_online(spark, sf_dir):
    return scored(spark, sf_dir, "online").select(*FUSED)


@query
def fusion_batch(spark, sf_dir):
    return scored(spark, sf_dir, "batch").select(*FUSED)


@query
def assess_flow(spark, sf_dir):
    out = assessed(spark, sf_dir)
    return out.select(
        *FUSED, "kb_score", "sanction_matched", "sanction_detail",
        F.array_join(F.transform("matched_rules", lambda h: h["rule_id"]), ",").alias("matched_rules"),
        F.array_join("risk_factors", "|").alias("risk_factors"),
        F.array_join(F.transform("top_features", lambda f: f["feature_name"]), ",").alias("top_features"))


@query
def assess_summary(spark, sf_dir):
    """Every event is assessed, those with a broken id or amount fail alone."""
    e = F.col("event_id")
    rows = enriched(spark, sf_dir).withColumns({
        "transaction_id": F.when(e % 53 != 0, F.col("transaction_id")).when(e % 2 == 0, F.lit(" ")),
        "amount": F.when(e % 61 != 0, F.col("amount"))})
    return flow.assess_summary(rows, sanctions=b.sanctions(b.events(spark, sf_dir)), stand_in=True)


@query
def account_age(spark, sf_dir):
    """Age of the account at each order, from the opening date of its customer."""
    opened = b.table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("date_add(date'1992-01-01', cast(c_custkey % 1500 as int))").alias("open_date"))
    rows = b.table(spark, sf_dir, "orders").join(opened, F.col("o_custkey") == F.col("c_custkey"), "left")
    return cleaning.account_age(rows, ts="o_orderdate").select("o_orderkey", "account_age_days")


@query
def assess_fallback(spark, sf_dir):
    out = assessed(spark, sf_dir).filter(F.col("account_id").cast("int") % 10 != 0)
    return fusion.with_fallback(b.events(spark, sf_dir), out)


def audit(spark, sf_dir) -> DataFrame:
    timed = assessed(spark, sf_dir).withColumn("processing_time_ms", F.col("value"))
    return flow.audit_log(timed)


@query
def audit_log(spark, sf_dir):
    out = audit(spark, sf_dir)
    return out.select("transaction_id", "request_id", "risk_level", "decision", "processing_time_ms", "created_at",
                      F.get_json_object("matched_rules", "$[0].rule_id").alias("first_rule"),
                      *[c.alias(n) for n, c in money("risk_score", "rule_score", "ml_score", "kb_score", "confidence").items()])


@query
def decision_distribution(spark, sf_dir):
    return fusion.decision_stats(scored(spark, sf_dir)).withColumns(rounded("avg_score", places=4))


@query
def score_distribution(spark, sf_dir):
    return fusion.score_histogram(scored(spark, sf_dir))


@query
def score_quantiles(spark, sf_dir):
    return fusion.score_quantiles(scored(spark, sf_dir)).withColumns(rounded("p50", "p90", "p99", places=4))
