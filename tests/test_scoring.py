"""Golden values and boundaries of scores, rules, fusion and compliance."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.operators import cleaning, compliance, fusion, model, rules, scoring


def fused(spark, rule_score, p, hits, policy="engine", sanction=False):
    entries = ", ".join(f"struct('{i}' as rule_id, {w} as risk_weight)" for i, w in hits)
    array = f"array({entries})" if hits else "cast(array() as array<struct<rule_id:string,risk_weight:int>>)"
    df = spark.range(1).selectExpr(f"{rule_score}D as rule_score", f"{p}D as fraud_probability", f"{array} as matched_rules",
                                   f"{len(hits)} as rule_count", f"{str(sanction).lower()} as sanction_matched")
    return fusion.fuse(df, policy).first()


@pytest.mark.parametrize("rule_score,p,hits,score,level,decision", [
    (80, 0.85, [("R001", 30)], 83.0, "HIGH", "BLOCK"),
    (10, 0.10, [], 10.0, "LOW", "PASS"),
    (50, 0.60, [("R101", 40)], 56.0, "MEDIUM", "REVIEW"),
    (100, 0.70, [("T001", 100)], 82.0, "HIGH", "BLOCK"),
    (60, 0.80, [], 72.0, "MEDIUM", "REVIEW"),
    (0, 0.0, [], 0.0, "LOW", "PASS"),
    (100, 1.0, [], 100.0, "HIGH", "BLOCK"),
    (100, 0.80, [("R206", 70)], 88.0, "HIGH", "REVIEW"),
    (0, 0.1, [("X", 90)], 6.0, "LOW", "BLOCK"),
])
def test_fusion_engine(spark, rule_score, p, hits, score, level, decision):
    row = fused(spark, rule_score, p, hits)
    assert (row.risk_score, row.risk_level, row.decision) == (score, level, decision)


def test_fusion_confidence(spark):
    assert fused(spark, 80, 0.85, [("R001", 30)]).confidence >= 0.5
    assert fused(spark, 0, 0.5, [("A", 1)] * 20).confidence == 0.65


def test_fusion_policies_differ(spark):
    heavy = [("R", 95)]
    assert fused(spark, 0, 0.1, heavy, "online").decision == "PASS"
    assert fused(spark, 0, 0.1, heavy, "batch").decision == "PASS"
    assert fused(spark, 0, 0.1, [], "online", sanction=True).decision == "BLOCK"
    assert fused(spark, 100, 0.80, [], "batch").decision == "BLOCK"
    assert fused(spark, 100, 0.80, [], "online").decision == "REVIEW"
    with pytest.raises(ValueError):
        fused(spark, 1, 0.1, [], "other")


@pytest.mark.parametrize("p,level", [(0.0, "LOW"), (0.45, "LOW"), (0.499, "LOW"), (0.5, "MEDIUM"), (0.65, "MEDIUM"),
                                     (0.799, "MEDIUM"), (0.8, "HIGH"), (0.95, "HIGH"), (1.0, "HIGH")])
def test_levels(spark, p, level):
    df = spark.range(1).selectExpr("0D as rule_score", f"{p}D as fraud_probability", "0 as rule_count", "false as sanction_matched")
    assert fusion.fuse(df, "batch", weights=(0.0, 1.0)).first().risk_level == level


QUIET = {
    "amount": "100.50", "amount_1h": "0", "inflow_1h": "0", "amount_24h": "0", "count_1h": 1, "count_24h": 1, "transaction_type": "PAYMENT",
    "is_night_time": False, "is_weekend": False, "is_cross_border": False, "counterparty_country": "CN",
    "ip_risk_level": "NORMAL", "city_count_30d": 3, "is_first_device": False, "is_emulator": False, "is_rooted": False,
    "device_count_30d": 2, "account_age_days": 100, "info_changed_recently": False, "sanction_matched": False,
    "counterparty_industry": "RETAIL",
}
TYPES = {str: "string", bool: "boolean", int: "int"}
FIRES = {
    "R001": {"amount": "500000"}, "R002": {"count_24h": 5, "amount_24h": "1000000"},
    "R003": {"count_24h": 10, "amount_24h": "300000", "transaction_type": "TRANSFER"},
    "R004": {"amount": "50000"}, "R005": {"amount": "10000", "amount_1h": "10000"},
    "R007": {"count_1h": 3, "amount": "50001"}, "R101": {"count_1h": 3, "is_night_time": True, "amount": "50001"},
    "R102": {"amount": "200001", "is_weekend": True}, "R106": {"count_1h": 5, "amount_1h": "200000"},
    "R202": {"is_cross_border": True}, "R203": {"ip_risk_level": "TOR"},
    "R204": {"city_count_30d": 1, "ip_risk_level": "MEDIUM_RISK"}, "R206": {"ip_risk_level": "HIGH_RISK"},
    "R301": {"is_first_device": True, "amount": "10001"}, "R302": {"is_emulator": True}, "R305": {"is_rooted": True},
    "R306": {"device_count_30d": 5}, "R401": {"amount": "50001", "account_age_days": 1},
    "R403": {"info_changed_recently": True, "amount": "10001"}, "T001": {"sanction_matched": True},
    "T002": {"counterparty_industry": "NPO"}, "T005": {"is_cross_border": True, "counterparty_country": "SY"},
}
JUST_SHORT = {
    "R001": {"amount": "499999.99"}, "R002": {"count_24h": 4, "amount_24h": "1000000"},
    "R003": {"count_24h": 10, "amount_24h": "300000", "transaction_type": "PAYMENT"},
    "R004": {"amount": "40000"}, "R005": {"amount": "9999.99", "amount_1h": "10000"},
    "R007": {"count_1h": 2, "amount": "50001"}, "R101": {"count_1h": 3, "is_night_time": False, "amount": "50001"},
    "R102": {"amount": "199999", "is_weekend": True}, "R106": {"count_1h": 4, "amount_1h": "200000"},
    "R202": {"is_cross_border": True, "counterparty_country": ""}, "R203": {"ip_risk_level": "MEDIUM_RISK"},
    "R204": {"city_count_30d": 2, "ip_risk_level": "MEDIUM_RISK"}, "R206": {"ip_risk_level": "MEDIUM_RISK"},
    "R301": {"is_first_device": True, "amount": "9999"}, "R302": {"is_emulator": False}, "R305": {"is_rooted": False},
    "R306": {"device_count_30d": 4}, "R401": {"amount": "50001", "account_age_days": 2},
    "R403": {"info_changed_recently": True, "amount": "9999"}, "T001": {"sanction_matched": False},
    "T002": {"counterparty_industry": "RETAIL"}, "T005": {"is_cross_border": False, "counterparty_country": "SY"},
}
MONEY = ("amount", "amount_1h", "amount_24h", "inflow_1h")


def facts(spark, cases):
    rows = [tuple([name] + [({**QUIET, **case})[c] for c in QUIET]) for name, case in cases.items()]
    schema = "name string, " + ", ".join(f"{c} {TYPES[type(v)]}" for c, v in QUIET.items())
    return spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("decimal(18,2)") for c in MONEY})


def fired(df, mode="literal"):
    out = rules.evaluate_rules(df, mode=mode).select("name", "matched_rules.rule_id").collect()
    return {r.name: r.rule_id for r in out}


def test_every_rule_fires_and_just_does_not(spark):
    assert set(FIRES) == {r.rule_id for r in rules.RULES} == set(JUST_SHORT)
    for rule, ids in fired(facts(spark, FIRES)).items():
        assert rule in ids
    for rule, ids in fired(facts(spark, JUST_SHORT)).items():
        assert rule not in ids
    assert fired(facts(spark, {"quiet": {}})) == {"quiet": []}


def test_missing_facts_fire_nothing(spark):
    df = facts(spark, {"nothing": {c: None for c in QUIET}})
    assert fired(df) == {"nothing": []}


def test_intent_mode(spark):
    cases = {"cn": {"is_cross_border": True}, "kp": {"is_cross_border": True, "counterparty_country": "KP"},
             "inflow": {"amount": "10000", "amount_1h": "10000", "inflow_1h": "10000"},
             "no_inflow": {"amount": "10000", "amount_1h": "10000"}}
    literal, intent = fired(facts(spark, cases)), fired(facts(spark, cases), "intent")
    assert "R202" in literal["cn"] and "R202" not in intent["cn"] and "R202" in intent["kp"]
    assert "R005" in intent["inflow"] and "R005" in literal["no_inflow"] and "R005" not in intent["no_inflow"]


def test_hits_are_ordered_by_salience(spark):
    case = {"all": {k: v for f in ("R001", "R302", "R306", "T001", "R305") for k, v in FIRES[f].items()}}
    ids = fired(facts(spark, case))["all"]
    salience = {r.rule_id: r.salience for r in rules.RULES}
    assert ids == sorted(ids, key=lambda i: (-salience[i], [r.rule_id for r in rules.RULES].index(i)))


def test_rule_score(spark):
    out = rules.rule_score(rules.evaluate_rules(facts(spark, {"none": {}, "one": FIRES["R305"], "max": FIRES["T001"]})))
    scores = {r["name"]: (r.rule_score, r.rule_count, r.highest_risk_level) for r in out.collect()}
    assert scores == {"none": (0.0, 0, "LOW"), "one": (67.5, 1, "MEDIUM"), "max": (100.0, 1, "HIGH")}


def test_rules_from_table(spark):
    table = rules.definitions(spark).withColumns({
        "enabled": F.col("rule_id") == "R302", "risk_weight": F.lit(10)}).unionByName(
        rules.definitions(spark).limit(1).withColumn("rule_id", F.lit("drop table")))
    loaded = rules.load_rules(table)
    assert [(r.rule_id, r.weight) for r in loaded] == [("R302", 10)]


def test_customer_score_boundaries(spark):
    rows = [  # txn_count, avg, targets, stddev, level -> score
        (51, 50001.0, 21, 200000.0, "HIGH", 155.0, "CRITICAL"),
        (50, 50000.0, 20, 100000.0, "MEDIUM", 25 + 20 + 20 + 0 + 15.0, "CRITICAL"),
        (20, 20000.0, 10, None, "LOW", 10 + 10 + 10 + 0 + 0.0, "MEDIUM"),
        (10, 10000.0, 5, 0.0, None, 0.0, "LOW"),
        (11, 0.0, 1, 5.0, "HIGH", 40.0, "MEDIUM"),
    ]
    df = spark.createDataFrame(rows, "txn_count long, avg_amount double, unique_targets long, stddev_amount double, "
                                     "risk_level string, want double, want_level string")
    for r in scoring.score_customers(df).collect():
        assert (r.risk_score, r.risk_level) == (r.want, r.want_level)
    assert scoring.score_customers(df, clamp=True).agg(F.max("risk_score")).first()[0] == 100.0


LEDGER = ("transaction_id string, customer_id long, trans_time timestamp_ntz, amount decimal(18,2), target_account long, "
          "is_cross_border boolean, country string")


def ledger(spark, *rows):
    import datetime as dt
    return spark.createDataFrame([(i, c, dt.datetime(2024, 1, d, 12), D(a), 1, x, "N") for i, c, d, a, x in rows], LEDGER)


def test_compliance_boundaries(spark):
    txn = ledger(spark, ("a", 1, 1, "50000.00", False), ("b", 1, 2, "49999.99", False), ("c", 2, 1, "100000.00", True),
                 ("d", 3, 1, "25000.00", False), ("e", 3, 1, "25000.00", False), ("f", 4, 1, "24999.99", True),
                 ("g", 4, 1, "25000.00", False), ("h", 5, 1, "9999.99", True), ("i", 5, 2, "10000.00", True))
    got = {(r.transaction_id, r.suspicious_type, r.suspicious_level) for r in compliance.suspicious_report(txn, "d").collect()}
    assert got == {("a", "LARGE_AMOUNT", "MEDIUM"), ("c", "LARGE_AMOUNT", "HIGH"), ("c", "CROSS_BORDER", "HIGH"),
                   ("d", "SPLIT_TRANSACTION", "HIGH"), ("e", "SPLIT_TRANSACTION", "HIGH"), ("f", "CROSS_BORDER", "MEDIUM"),
                   ("i", "CROSS_BORDER", "MEDIUM")}
    parts = compliance.detect_large(txn).union(compliance.detect_split(txn)).union(compliance.detect_cross_border(txn))
    assert {tuple(r) for r in parts.distinct().collect()} == {
        tuple(r) for r in compliance.suspicious_report(txn, "d").drop("report_date").collect()}


def test_masking(spark):
    df = spark.createDataFrame([("13812345678", "110101199001011234", "6222021234567890"), ("1", "2", "3"), (None, None, None)],
                               "phone string, card string, bank string")
    out = cleaning.mask_columns(df, {"phone": "phone", "card": "id_card", "bank": "bank_card"}).collect()
    assert tuple(out[0]) == ("138****5678", "110101********1234", "6222****7890")
    assert tuple(out[1]) == ("1", "2", "3") and tuple(out[2]) == (None, None, None)


def test_amount_edges_and_times(spark):
    df = spark.sql("""select * from values (0.0099, timestamp_ntz'2024-01-06 03:00:00'), (0.0100, timestamp_ntz'2024-01-08 05:59:59'),
        (10000000.0000, timestamp_ntz'2024-01-08 06:00:00'), (10000000.0100, null), (null, null) as t(amount, transaction_time)""")
    kept = [str(r.amount) for r in cleaning.filter_valid_amount(df).collect()]
    assert kept == ["0.0100", "10000000.0000"]
    flags = [(r.is_night_time, r.is_weekend) for r in cleaning.time_flags(df).collect()]
    assert flags == [(True, True), (True, False), (False, False), (False, False), (False, False)]


def test_model_fallback_and_training(spark):
    df = facts(spark, FIRES)
    plain = model.score_model(model.feature_vector(df), None).first()
    assert (plain.fraud_probability, plain.model_version) == (fv.FALLBACK_PROBABILITY, "fallback")
    vectors = model.feature_vector(df).withColumn("label", (F.col("amount") > 100000).cast("double"))
    fitted = model.train_model(vectors, "label")
    broken = vectors.withColumn("features", F.when(F.col("name") != "R001", F.col("features")))
    scored = {r.name: (r.fraud_probability, r.model_version) for r in model.score_model(broken, fitted).collect()}
    assert scored["R001"] == (0.5, "fallback") and scored["R302"][1] == "2.0.0" and 0 <= scored["R302"][0] <= 1


def test_feature_vector_defaults(spark):
    vector = model.feature_vector(spark.range(1).selectExpr("cast(null as decimal(18,2)) as amount")).first().features
    assert len(vector) == 32 and vector[0] == 0.0 and vector[18] == 1.0 and vector[23] == 1.0 and vector[24] == 1.0
    assert sum(vector) == 3.0
