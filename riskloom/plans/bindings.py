"""Views that present the star-schema and event tables under the canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import ip_class, is_night, is_weekend, sha256_hex
from riskloom.schemas import MONEY

AS_OF = "2024-01-31"
BATCH_DATE = "2024-01-31"
EVENT_DAY = "2024-01-15"
LEDGER_DAY = "1997-05-28"

CHANNELS = ("EBANK", "MBANK", "COUNTER", "ATM", "POS", "THIRD_PARTY")
COUNTRIES = (*fv.FATF_COUNTRIES, "CN", "CN", "CN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, parties: bool = True) -> DataFrame:
    """Order lines as ledger transactions.

    ``parties=False`` leaves out the joins that only serve the country columns.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "cast(l_extendedprice as decimal(18,2)) as amount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    columns = ("concat('TX', l_orderkey, '-', l_linenumber) as transaction_id", "o_custkey as customer_id",
               "o_orderdate as trans_time", "amount", "l_suppkey as target_account")
    if not parties:
        return joined.selectExpr(*columns)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nations, F.expr("s_nationkey = n_nationkey"))
    return (joined.join(customers, F.expr("o_custkey = c_custkey")).join(suppliers, F.expr("l_suppkey = s_suppkey"))
            .selectExpr(*columns, "c_nationkey <> s_nationkey as is_cross_border", "n_name as country"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("account_type"),
        F.when(balance < 0, "HIGH").when(balance < 1000, "MEDIUM").otherwise("LOW").alias("risk_level"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(
        F.lit("SANCTION").alias("list_type"), F.lit("ACCOUNT").alias("entity_type"),
        key.cast("string").alias("entity_value"), sha256_hex(key).alias("entity_hash"),
        F.lit("1996-01-01").cast("timestamp_ntz").alias("effective_time"),
        F.when(key % 2 == 1, F.lit("1999-01-01").cast("timestamp_ntz")).alias("expire_time"),
        (key % 7 != 0).alias("enabled"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as account transactions.

    ``account_age_days``, industry and sanction marks are attributes of the parties here;
    the features of 2.10 are derived by the operators.
    """
    return events_view(table(spark, sf_dir, "events"))


def events_view(raw: DataFrame) -> DataFrame:
    """The same for any DataFrame, batch or streaming, with the columns of ``events``."""
    channels = ", ".join(f"'{c}'" for c in CHANNELS)
    countries = ", ".join(f"'{c}'" for c in COUNTRIES)
    keyed = raw.selectExpr("event_id", "user_id", "ts", "event_type", "value",
                           "cast(get_json_object(props, '$.k') as int) as k")
    return keyed.selectExpr(
        "event_id", "cast(event_id as string) as transaction_id", "cast(user_id as string) as account_id",
        "ts as transaction_time", "event_type", "value", "k", "cast(value * 2000 as decimal(18,2)) as amount",
        """case event_type when 'click' then 'TRANSFER' when 'purchase' then 'PAYMENT' when 'signup' then 'WITHDRAW'
           when 'view' then 'DEPOSIT' else 'OTHER' end as transaction_type""",
        f"element_at(array({channels}), k % 6 + 1) as channel_code",
        """concat('DEV-', user_id div 5, '-', case when k < 70 then 0 when k < 85 then 1 when k < 93 then 2
           when k < 97 then 3 else 4 end) as device_id""",
        "concat(case when k < 5 then '185.220.0.' when k < 20 then '103.0.0.' else '10.0.0.' end, k) as ip_address",
        "concat('CITY-', k % 10) as ip_city", "concat('CP-', event_id % 500) as counterparty_hash",
        "concat('M-', k % 20) as merchant_id", "k % 33 = 0 as is_emulator", "k % 25 = 0 as is_rooted",
        "k % 7 = 0 as is_cross_border", f"element_at(array({countries}), k % 12 + 1) as counterparty_country",
        "greatest(0, datediff(ts, date_add(date'2023-12-31', cast(user_id % 20 as int)))) as account_age_days",
        """case event_id % 500 when 0 then 'VIRTUAL_CURRENCY' when 1 then 'NPO' when 2 then 'GAMBLING'
           else 'RETAIL' end as counterparty_industry""",
    ).withColumns({
        "ip_risk_level": ip_class(F.col("ip_address")),
        "is_night_time": is_night(F.col("transaction_time")),
        "is_weekend": is_weekend(F.col("transaction_time")),
    })


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they would arrive before cleaning: odd amounts, blanks, mixed case."""
    return events(spark, sf_dir).selectExpr(
        "event_id", "if(event_id % 53 = 0, '', transaction_id) as transaction_id",
        "if(event_id % 59 = 0, null, account_id) as account_id",
        "if(k % 4 = 0, sha2(account_id, 256), null) as account_id_hash",
        "counterparty_hash as counterparty_account", "if(k % 3 = 0, 'known-hash', null) as counterparty_hash",
        "transaction_type", "lower(channel_code) as channel_code", "transaction_time",
        """cast(case when event_id % 61 = 0 then null when event_id % 67 = 0 then 0.0090
           when event_id % 71 = 0 then 10000000.0100 when event_id % 73 = 0 then 10000000.0000
           when event_id % 79 = 0 then 0.0100 else amount + 0.0050 end as decimal(18,4)) as amount""",
        "case event_id % 3 when 0 then null when 1 then '' else 'USD' end as currency",
        """case when event_id % 83 = 0 then null when event_id % 89 = 0 then '' when event_id % 97 = 0 then '10.0.0'
           else ip_address end as ip_address""",
        "case k % 5 when 0 then 'TOR' when 1 then 'LOW_RISK' end as ip_risk_level",
        "cast(cast(event_id * 7919 % 900000001 as decimal(18,0)) * 0.0000001 as decimal(10,7)) as gps_lat",
        "cast(cast(event_id * 104729 % 1800000001 as decimal(18,0)) * 0.0000001 as decimal(10,7)) as gps_lng")


def profile_changes(ev: DataFrame) -> DataFrame:
    """A sign-up event counts as a change of the account's profile."""
    return ev.filter(F.col("event_type") == "signup").select("account_id", "transaction_time")


def sanctions(ev: DataFrame) -> DataFrame:
    """Listing of the counterparties 7, 8 and 9, in force for all time."""
    listed = ev.filter(F.col("event_id") % 500 >= 7).filter(F.col("event_id") % 500 <= 9)
    return listed.select("counterparty_hash").distinct().select(
        F.lit("SANCTION").alias("list_type"), F.col("counterparty_hash").alias("entity_hash"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("effective_time"),
        F.lit(None).cast("timestamp_ntz").alias("expire_time"), F.lit(True).alias("enabled"))


def alert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on the alert of their user."""
    names = {"signup": "CREATE", "click": "PROCESSING", "purchase": "RESOLVED", "view": "CLOSED", "error": "ESCALATE"}
    action = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), "ts", action.alias("action"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("analyst-"), F.col("event_id") % 7)).alias("assignee"))


def case_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"signup": "CREATE", "click": "ASSIGN", "purchase": "PROCESS", "view": "CLOSE", "error": "PROCESS"}
    action = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), "ts", action.alias("action"),
        F.concat(F.lit("analyst-"), F.col("event_id") % 7).alias("assignee"))


def profile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of customer profiles; an error event is a delete."""
    return profile_log_view(table(spark, sf_dir, "events"))


def profile_log_view(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "user_id as customer_id", "event_id as seq", "ts as last_update",
        "case when value >= 40 then 'HIGH' when value >= 15 then 'MEDIUM' else 'LOW' end as risk_level",
        "if(event_type = 'error', 'delete', 'update') as op")


def orders_as_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", "NEW").when(F.col("o_orderstatus") == "F", "CLOSED")
         .otherwise("INVESTIGATING").alias("case_status"),
        F.when(F.col("o_orderpriority").startswith("1"), "CRITICAL")
         .when(F.col("o_orderpriority").startswith("2"), "HIGH")
         .when(F.col("o_orderpriority").startswith("3"), "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.col("o_orderdate").alias("created_at"))


def documents_as_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the case library, whole texts."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        key.cast("string").alias("case_id"), F.concat(F.lit("Case "), key).alias("case_title"),
        F.when(key % 3 == 0, "FRAUD").when(key % 3 == 1, "AML").otherwise("CTF").alias("case_type"),
        F.when(key % 2 == 0, "HIGH").otherwise("MEDIUM").alias("case_level"),
        F.col("text").alias("case_description"),
        F.when(key % 4 != 0, F.col("source")).alias("modus_operandi"),
        F.when(key % 5 != 0, F.col("lang")).alias("fraud_pattern"),
        F.when(key % 6 != 0, F.concat(F.lit('{"n_chars": '), F.col("n_chars"), F.lit("}"))).alias("key_features"),
        F.when(key % 7 != 0, F.col("n_chars").cast(MONEY)).alias("involved_amount"),
        F.when(key % 8 != 0, F.concat(F.lit("resolved "), key)).alias("resolution"),
        F.when(key % 9 != 0, F.concat(F.lit("effect "), key)).alias("resolution_effect"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
