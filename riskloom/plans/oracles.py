"""Independent ANSI/DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from riskloom import fixed_values as fv
from riskloom.operators.rules import RULES
from riskloom.plans import bindings as b

ORACLES: dict[str, str] = {}

# --- shared views as common table expressions ----------------------------------------------------
CTE: dict[str, tuple[tuple[str, ...], str]] = {}

CTE["ledger"] = ((), """
  select 'TX' || l_orderkey || '-' || l_linenumber as transaction_id, o_custkey as customer_id,
         o_orderdate as trans_time, cast(l_extendedprice as decimal(18,2)) as amount,
         l_suppkey as target_account, c_nationkey <> s_nationkey as is_cross_border, n_name as country
  from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey""")

CTE["profile"] = ((), """
  select c_custkey as customer_id, c_name as customer_name, c_mktsegment as account_type,
         case when c_acctbal < 0 then 'HIGH' when c_acctbal < 1000 then 'MEDIUM' else 'LOW' end as risk_level
  from customer""")

CTE["listing"] = ((), """
  select sha256(cast(s_suppkey as varchar)) as entity_hash, timestamp '1996-01-01' as effective_time,
         case when s_suppkey % 2 = 1 then timestamp '1999-01-01' end as expire_time,
         s_suppkey % 7 <> 0 as enabled
  from supplier where s_acctbal < 0""")

CTE["e0"] = ((), """
  select *, cast(json_extract(props, '$.k') as int) as k from events""")

_channels = ", ".join(f"'{c}'" for c in b.CHANNELS)
_countries = ", ".join(f"'{c}'" for c in b.COUNTRIES)

CTE["e"] = (("e0",), f"""
  select event_id, cast(event_id as varchar) as transaction_id, cast(user_id as varchar) as account_id, user_id,
    ts as transaction_time, event_type, value, k, cast(value * 2000 as decimal(18,2)) as amount,
    case event_type when 'click' then 'TRANSFER' when 'purchase' then 'PAYMENT' when 'signup' then 'WITHDRAW'
      when 'view' then 'DEPOSIT' else 'OTHER' end as transaction_type,
    list_extract([{_channels}], k % 6 + 1) as channel_code,
    'DEV-' || (user_id // 5) || '-' || (case when k < 70 then 0 when k < 85 then 1 when k < 93 then 2
      when k < 97 then 3 else 4 end) as device_id,
    case when k < 5 then '185.220.0.' || k when k < 20 then '103.0.0.' || k else '10.0.0.' || k end as ip_address,
    case when k < 5 then 'HIGH_RISK' when k < 20 then 'MEDIUM_RISK' else 'NORMAL' end as ip_risk_level,
    'CITY-' || (k % 10) as ip_city, 'CP-' || (event_id % 500) as counterparty_hash, 'M-' || (k % 20) as merchant_id,
    k % 33 = 0 as is_emulator, k % 25 = 0 as is_rooted, k % 7 = 0 as is_cross_border,
    list_extract([{_countries}], k % 12 + 1) as counterparty_country,
    greatest(0, date_diff('day', date '2023-12-31' + cast(user_id % 20 as int), cast(ts as date))) as account_age_days,
    case event_id % 500 when 0 then 'VIRTUAL_CURRENCY' when 1 then 'NPO' when 2 then 'GAMBLING'
      else 'RETAIL' end as counterparty_industry,
    event_id % 500 between 7 and 9 as sanction_matched,
    extract(hour from ts) < 6 as is_night_time, extract(dow from ts) in (0, 6) as is_weekend
  from e0""")

CTE["raw"] = (("e",), """
  select event_id, case when event_id % 53 = 0 then '' else transaction_id end as transaction_id,
    case when event_id % 59 = 0 then null else account_id end as account_id,
    case when k % 4 = 0 then sha256(account_id) end as account_id_hash,
    counterparty_hash as counterparty_account,
    case when k % 3 = 0 then 'known-hash' end as counterparty_hash,
    transaction_type, lower(channel_code) as channel_code, transaction_time,
    case when event_id % 61 = 0 then null when event_id % 67 = 0 then 0.0090
      when event_id % 71 = 0 then 10000000.0100 when event_id % 73 = 0 then 10000000.0000
      when event_id % 79 = 0 then 0.0100 else cast(amount as decimal(18,4)) + 0.0050 end as amount,
    case event_id % 3 when 0 then null when 1 then '' else 'USD' end as currency,
    case when event_id % 83 = 0 then null when event_id % 89 = 0 then '' when event_id % 97 = 0 then '10.0.0'
      else ip_address end as ip_address,
    case k % 5 when 0 then 'TOR' when 1 then 'LOW_RISK' end as ip_risk_level,
    cast(event_id * 7919 % 900000001 as decimal(18,0)) * cast(0.0000001 as decimal(10,7)) as gps_lat,
    cast(event_id * 104729 % 1800000001 as decimal(18,0)) * cast(0.0000001 as decimal(10,7)) as gps_lng
  from e""")

CTE["feat0"] = (("e",), """
  select *, count(*) over h as count_1h, sum(amount) over h as amount_1h,
    count(*) over d as count_24h, sum(amount) over d as amount_24h,
    coalesce(sum(case when transaction_type = 'DEPOSIT' then amount end) over h, 0) as inflow_1h,
    count(*) over a as count_all, cast(sum(amount) over a as double) as amount_all,
    count(distinct device_id) over m as device_count_30d, count(distinct ip_city) over m as city_count_30d,
    count(distinct counterparty_hash) over m as counterparty_count_30d,
    count(*) filter (where event_type = 'signup') over d - (event_type = 'signup')::int > 0 as info_changed_recently
  from e
  window h as (partition by account_id order by transaction_time
               range between interval 1 hour preceding and current row),
         d as (partition by account_id order by transaction_time
               range between interval 24 hour preceding and current row),
         m as (partition by account_id order by transaction_time
               range between interval 30 day preceding and current row),
         a as (partition by account_id order by transaction_time
               range between unbounded preceding and current row)""")

CTE["feat"] = (("feat0",), """
  select *, device_count_30d = 1 as is_first_device,
    coalesce(case when count_all >= 2 then abs(cast(amount as double) - amount_all / count_all)
      / nullif(amount_all / count_all, 0) end, 0.0) as amount_deviation
  from feat0""")

RULE_SQL = {
    "R001": "amount >= 500000",
    "R002": "count_24h >= 5 and amount_24h >= 1000000",
    "R003": "count_24h >= 10 and amount_24h >= 300000 and transaction_type = 'TRANSFER'",
    "R004": "amount % 10000 = 0 and amount >= 50000",
    "R005": "amount >= 10000 and amount_1h >= amount",
    "R007": "count_1h >= 3 and amount >= 50000",
    "R101": "count_1h >= 3 and is_night_time and amount >= 50000",
    "R102": "amount >= 200000 and (is_night_time or is_weekend)",
    "R106": "count_1h >= 5 and amount_1h >= 200000",
    "R202": "is_cross_border and length(counterparty_country) > 0",
    "R203": "ip_risk_level in ('VPN','PROXY','TOR','HIGH_RISK')",
    "R204": "city_count_30d = 1 and ip_risk_level = 'MEDIUM_RISK'",
    "R206": "ip_risk_level = 'HIGH_RISK'",
    "R301": "is_first_device and amount >= 10000",
    "R302": "is_emulator",
    "R305": "is_rooted",
    "R306": "device_count_30d >= 5",
    "R401": "amount >= 50000 and account_age_days <= 1",
    "R403": "info_changed_recently and amount >= 10000",
    "T001": "sanction_matched",
    "T002": "counterparty_industry in ('VIRTUAL_CURRENCY','NPO','GAMBLING')",
    "T005": "is_cross_border and counterparty_country in ('SY','YE','LY','SO')",
}
RULE_SQL_INTENT = RULE_SQL | {
    "R005": "amount >= 10000 and transaction_type <> 'DEPOSIT' and inflow_1h >= amount",
    "R202": "is_cross_border and counterparty_country in ('KP','IR','SY','MM','YE','LY','SO','CU','VE')",
}


def _hits(rule_sql):
    branches = []
    for position, rule in enumerate(RULES):
        branches.append(
            f"select transaction_id, '{rule.rule_id}' as rule_id, '{rule.name}' as rule_name, {rule.weight} as w, "
            f"'{rule.level}' as lvl, {rule.salience} * 1000 - {position} as ord from feat where {rule_sql[rule.rule_id]}")
    return "\n  union all ".join(branches)


CTE["hits"] = (("feat",), _hits(RULE_SQL))
CTE["hits_intent"] = (("feat",), _hits(RULE_SQL_INTENT))

CTE["agg"] = (("hits",), """
  select transaction_id, count(*) as rule_count, cast(sum(w) as double) as total_weight,
    round(cast(least(100.0, cast(sum(w * w) as double) / sum(w) * 1.5) as decimal(18,8)), 2) as rule_score,
    max(case lvl when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) as lvl, max(w) as max_weight,
    bool_or(rule_id = 'T001') as t001, string_agg(rule_id, ',' order by ord desc) as ids,
    string_agg('[' || rule_id || '] ' || rule_name, '|' order by ord desc) as labels
  from hits group by transaction_id""")

_slots = {
    0: "log10(greatest(cast(amount as double), 1.0)) / 8.0", 1: "count_1h / 100.0::double", 2: "count_24h / 1000.0::double",
    3: "device_count_30d / 50.0::double", 4: "city_count_30d / 20.0::double", 5: "counterparty_count_30d / 100.0::double",
    6: "is_night_time::int::double", 7: "is_cross_border::int::double", 8: "is_first_device::int::double",
    9: "case ip_risk_level when 'HIGH_RISK' then 0.9::double when 'MEDIUM_RISK' then 0.5::double when 'LOW_RISK' then 0.2::double else 0.0::double end",
    10: "least(1.0::double, amount_deviation / 10.0::double)", 11: "is_emulator::int::double", 12: "is_rooted::int::double",
    **{13 + i: f"(channel_code = '{c}')::int::double" for i, c in enumerate(fv.CHANNELS)},
    18: "(channel_code not in ('EBANK','MBANK','COUNTER','ATM','POS'))::int::double",
    **{19 + i: f"(transaction_type = '{t}')::int::double" for i, t in enumerate(fv.TRANSACTION_TYPES)},
    23: "(transaction_type not in ('TRANSFER','PAYMENT','WITHDRAW','DEPOSIT'))::int::double",
    24: "(amount <= 10000)::int::double", 25: "(amount > 10000 and amount <= 100000)::int::double",
    26: "(amount > 100000 and amount <= 500000)::int::double", 27: "(amount > 500000)::int::double",
    28: "is_weekend::int::double", 29: "0.0::double",
    30: "case when amount > 0 then cast(amount_1h as double) / cast(amount as double) else 0.0::double end",
    31: "case when device_count_30d > 0 then cast(count_24h as double) / device_count_30d else 0.0::double end",
}
CTE["vec"] = (("feat",), "\n  select *, " + ",\n    ".join(f"{sql} as v{i}" for i, sql in _slots.items()) + "\n  from feat")

_weights = " + ".join(f"{w}::double * v{i}" for i, (_, w) in enumerate(fv.FEATURE_IMPORTANCE))
CTE["prob"] = (("vec",), f"\n  select *, least(1.0::double, 3.0::double * ({_weights})) as p from vec")

CTE["joined"] = (("prob", "agg"), """
  select prob.*, coalesce(cast(agg.rule_score as double), 0.0) as rule_score, coalesce(rule_count, 0) as rule_count,
    coalesce(max_weight, 0) as max_weight, coalesce(t001, false) as t001, coalesce(ids, '') as ids, labels,
    least(100.0::double, p * 100) as ml
  from prob left join agg using (transaction_id)""")

CTE["raw_scores"] = (("joined",), """
  select *, greatest(0.0::double, least(100.0::double, 0.4::double * rule_score + 0.6::double * ml)) as raw from joined""")


def _fused(block: str) -> str:
    return f"""
  select transaction_id, account_id, transaction_time, value, ids, labels, is_first_device, is_night_time, is_cross_border, sanction_matched,
    cast(round(cast(raw as decimal(18,8)), 2) as double) as risk_score,
    case when raw >= 80 then 'HIGH' when raw >= 50 then 'MEDIUM' else 'LOW' end as risk_level,
    case when {block} then 'BLOCK' when raw >= 50 then 'REVIEW' else 'PASS' end as decision,
    cast(round(cast(least(1.0::double, least(1.0::double, rule_count / 10.0::double) * 0.3::double + p * 0.7::double) as decimal(18,8)), 2) as double) as confidence,
    rule_score, cast(round(cast(ml as decimal(18,8)), 2) as double) as ml_score
  from raw_scores"""


CTE["engine"] = (("raw_scores",), _fused("t001 or max_weight >= 90 or (raw >= 80 and ml >= 85)"))
CTE["online"] = (("raw_scores",), _fused("sanction_matched or (raw >= 80 and ml >= 85)"))
CTE["batch"] = (("raw_scores",), _fused("raw >= 80"))

CTE["assessed"] = (("online",), f"""
  select *, concat_ws('|', labels, case when is_first_device then '{fv.FACTOR_NEW_DEVICE}' end,
      case when is_night_time then '{fv.FACTOR_NIGHT}' end, case when is_cross_border then '{fv.FACTOR_CROSS_BORDER}' end,
      case when ml_score >= 80 then '{fv.FACTOR_MODEL}' end) as factors
  from online""")


def sql(body: str, *needs: str) -> str:
    """``body`` after the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name):
        for dependency in CTE[name][0]:
            visit(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in ordered) + "\n" + body


def avg4(amount: str) -> str:
    """Mean of a decimal(18,2): the engine keeps six places, the query four."""
    return f"cast(round(cast(round(avg(cast({amount} as double)), 6) as decimal(22,6)), 4) as double)"


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)


# --- sources -------------------------------------------------------------------------------------
oracle("scan_day", f"""select transaction_id, customer_id, trans_time, cast(amount as double) as amount, target_account
  from ledger where cast(trans_time as date) = date '{b.LEDGER_DAY}'""", "ledger")
oracle("scan_lookback", f"""select transaction_id, account_id, transaction_time, cast(amount as double) as amount
  from e where transaction_time >= timestamp '{b.AS_OF}' - interval 14 day""", "e")
oracle("scan_customers", "select * from profile", "profile")
oracle("cdc_latest", """select customer_id, seq, last_update, risk_level from (
  select user_id as customer_id, event_id as seq, ts as last_update, event_type,
    case when value >= 40 then 'HIGH' when value >= 15 then 'MEDIUM' else 'LOW' end as risk_level,
    row_number() over (partition by user_id order by event_id desc) as rn from events)
  where rn = 1 and event_type <> 'error'""")

CTE["cases"] = ((), """
  select cast(doc_id as varchar) as case_id, 'Case ' || doc_id as case_title,
    case doc_id % 3 when 0 then 'FRAUD' when 1 then 'AML' else 'CTF' end as case_type,
    case when doc_id % 2 = 0 then 'HIGH' else 'MEDIUM' end as case_level, text as case_description,
    case when doc_id % 4 <> 0 then source end as modus_operandi, case when doc_id % 5 <> 0 then lang end as fraud_pattern,
    case when doc_id % 6 <> 0 then n_chars end as key_features,
    case when doc_id % 7 <> 0 then cast(n_chars as double) end as involved_amount,
    case when doc_id % 8 <> 0 then 'resolved ' || doc_id end as resolution,
    case when doc_id % 9 <> 0 then 'effect ' || doc_id end as resolution_effect, doc_id
  from documents""")
oracle("kb_load_cases", """select case_id, case_title, case_type, case_level, case_description,
  coalesce(modus_operandi, '') as modus_operandi, coalesce(fraud_pattern, '') as fraud_pattern, key_features,
  coalesce(involved_amount, 0.0) as involved_amount, coalesce(resolution, '') as resolution,
  coalesce(resolution_effect, '') as resolution_effect from cases""", "cases")

# --- cleaning ------------------------------------------------------------------------------------
oracle("clean_valid_amount", """select event_id, cast(amount as double) as amount from raw
  where amount between 0.01 and 10000000.00""", "raw")
oracle("validate_report", r"""select reason, count(*) as rejected from (
  select 'transaction_id_blank' as reason from raw where coalesce(trim(transaction_id), '') = ''
  union all select 'account_id_blank' from raw where coalesce(trim(account_id), '') = ''
  union all select 'amount_null' from raw where amount is null
  union all select 'amount_too_small' from raw where amount < 0.01
  union all select 'amount_too_large' from raw where amount > 10000000
  union all select 'ip_address_invalid' from raw
    where not regexp_matches(ip_address, '^$|^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')) group by reason""", "raw")
oracle("clean_standardise", """select event_id, cast(round(amount, 2) as double) as amount,
  case when coalesce(currency, '') = '' then 'CNY' else currency end as currency, upper(channel_code) as channel_code,
  coalesce(round(amount, 2) >= 10000000, false) as is_extreme_amount from raw""", "raw")
oracle("clean_hash", """select event_id, coalesce(account_id_hash, sha256(account_id)) as account_id_hash,
  coalesce(counterparty_hash, sha256(counterparty_account)) as counterparty_hash from raw""", "raw")
oracle("clean_gps", """select event_id, cast(round(gps_lat, 2) as double) as gps_lat,
  cast(round(gps_lng, 2) as double) as gps_lng from raw""", "raw")
_ip_case = """case when ip_address like '185.220.%' or ip_address like '23.129.%' then 'HIGH_RISK'
    when ip_address like '103.%' or ip_address like '45.%' then 'MEDIUM_RISK' else 'NORMAL' end"""
oracle("ip_risk", f"""select event_id, case when ip_address is null then ip_risk_level else {_ip_case} end as ip_risk_level from raw""", "raw")
oracle("ip_risk_keep_stronger", f"""select event_id, case when ip_risk_level in ('VPN','PROXY','TOR') then ip_risk_level
  when ip_address is null then ip_risk_level else {_ip_case} end as ip_risk_level from raw""", "raw")
oracle("clean_chain", rf"""select event_id, coalesce(account_id_hash, sha256(account_id)) as account_id_hash,
  coalesce(counterparty_hash, sha256(counterparty_account)) as counterparty_hash, cast(round(amount, 2) as double) as amount,
  case when coalesce(currency, '') = '' then 'CNY' else currency end as currency, upper(channel_code) as channel_code,
  case when ip_address is null then ip_risk_level else {_ip_case} end as ip_risk_level
  from raw where amount between 0.01 and 10000000 and coalesce(trim(transaction_id), '') <> ''
    and coalesce(trim(account_id), '') <> ''
    and coalesce(regexp_matches(ip_address, '^$|^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}$'), true)""", "raw")
oracle("mask_pii", """select c_custkey, '138****' || right(lpad(cast(c_custkey as varchar), cast(greatest(8, len(cast(c_custkey as varchar))) as int), '0'), 4) as phone,
  '110101********' || right(lpad(cast(c_custkey as varchar), cast(greatest(6, len(cast(c_custkey as varchar))) as int), '0'), 4) as id_card,
  '6222****' || right(lpad(cast(c_custkey as varchar), cast(greatest(12, len(cast(c_custkey as varchar))) as int), '0'), 4) as bank_card,
  case when length(cast(c_custkey as varchar)) >= 8 then left(cast(c_custkey as varchar), 4) || '****' || right(cast(c_custkey as varchar), 4)
    else cast(c_custkey as varchar) end as short_card from customer""")
oracle("time_flags", """select event_id, extract(hour from transaction_time) between 0 and 5 as is_night_time,
  extract(isodow from transaction_time) >= 6 as is_weekend from raw""", "raw")
oracle("request_defaults", """select event_id, coalesce(account_id, '') as account_id, coalesce(currency, 'CNY') as currency,
  coalesce(ip_address, '') as ip_address, coalesce(ip_risk_level, 'NORMAL') as ip_risk_level,
  coalesce(counterparty_hash, '') as counterparty_hash, coalesce(cast(amount as double), 0.0) as amount from raw""", "raw")
oracle("dedup_batch", """select transaction_id, customer_id, trans_time, cast(amount as double) as amount, target_account from (
  select *, row_number() over (partition by transaction_id order by trans_time, customer_id, target_account, amount) as rn
  from ledger) where rn = 1""", "ledger")

# --- joins ---------------------------------------------------------------------------------------
oracle("join_profile", """select customer_id, txn_count, customer_name, account_type, risk_level
  from (select customer_id, count(*) as txn_count from ledger group by customer_id)
  left join profile using (customer_id)""", "ledger", "profile")
_listed = """exists (select 1 from listing where enabled and entity_hash = sha256(cast(l.target_account as varchar))
    and effective_time <= l.trans_time and (expire_time is null or l.trans_time < expire_time))"""
_ledger_cols = "transaction_id, customer_id, trans_time, target_account, cast(amount as double) as amount"
oracle("blacklist_hits", f"select {_ledger_cols} from ledger l where {_listed}", "ledger", "listing")
oracle("blacklist_clean", f"select {_ledger_cols} from ledger l where not {_listed}", "ledger", "listing")
oracle("blacklist_flags", f"""select sanction_matched, case when sanction_matched then '{fv.SANCTION_DETAIL}' else '' end as sanction_detail,
  count(*) as n, cast(sum(amount) as double) as total_amount
  from (select amount, {_listed} as sanction_matched from ledger l) group by 1, 2""", "ledger", "listing")
oracle("country_flags", """select transaction_id,
  counterparty_country in ('KP','IR','SY','MM','YE','LY','SO','CU','VE') as is_fatf_country,
  counterparty_country in ('SY','YE','LY','SO') as is_war_country from e""", "e")
oracle("info_changed_flag", """select transaction_id, exists (select 1 from e c where c.event_type = 'signup' and c.account_id = x.account_id
  and c.transaction_time < x.transaction_time and c.transaction_time >= x.transaction_time - interval 24 hour) as info_changed_recently
  from e x""", "e")

# --- customer scoring and compliance -------------------------------------------------------------
CTE["stats"] = (("ledger",), f"""
  select customer_id, count(*) as txn_count, sum(amount) as total_amount, avg(cast(amount as double)) as avg_amount, {avg4("amount")} as avg4,
    max(amount) as max_amount, min(amount) as min_amount, stddev_samp(cast(amount as double)) as stddev_amount,
    count(distinct target_account) as unique_targets from ledger group by customer_id""")
_stats = """customer_id, txn_count, cast(total_amount as double) as total_amount,
  avg4 as avg_amount,
  cast(max_amount as double) as max_amount, cast(min_amount as double) as min_amount,
  round(stddev_amount, 4) as stddev_amount, unique_targets"""
oracle("customer_stats", f"select {_stats} from stats", "stats")
CTE["customer_scores"] = (("stats", "profile"), """
  select *, (case when txn_count > 50 then 40.0 when txn_count > 20 then 25.0 when txn_count > 10 then 10.0 else 0.0 end
    + case when avg_amount > 50000 then 35.0 when avg_amount > 20000 then 20.0 when avg_amount > 10000 then 10.0 else 0.0 end
    + case when unique_targets > 20 then 30.0 when unique_targets > 10 then 20.0 when unique_targets > 5 then 10.0 else 0.0 end
    + case when stddev_amount / nullif(avg_amount, 0) > 2 then 20.0 else 0.0 end
    + case risk_level when 'HIGH' then 30.0 when 'MEDIUM' then 15.0 else 0.0 end)::double as risk_score
  from stats left join profile using (customer_id)""")
_customer_level = "case when risk_score >= 70 then 'CRITICAL' when risk_score >= 50 then 'HIGH' when risk_score >= 30 then 'MEDIUM' else 'LOW' end"
oracle("batch_risk_scores", f"""select {_stats}, customer_name, account_type, risk_score, {_customer_level} as risk_level,
  '{b.BATCH_DATE}' as batch_date from customer_scores""", "customer_scores")
CTE["split_days"] = (("ledger",), """
  select customer_id, cast(trans_time as date) as trans_date, sum(amount) as daily_total, count(*) as txn_count,
    min(amount) as min_amount, max(amount) as max_amount
  from ledger group by 1, 2 having sum(amount) >= 50000 and count(*) >= 2 and max(amount) < 50000""")
oracle("split_days", """select customer_id, trans_date, cast(daily_total as double) as daily_total, txn_count,
  cast(min_amount as double) as min_amount, cast(max_amount as double) as max_amount from split_days""", "split_days")
_base = "transaction_id, customer_id, trans_time, amount, target_account, is_cross_border, country"
CTE["large"] = (("ledger",), f"""
  select {_base}, 'LARGE_AMOUNT' as suspicious_type, case when amount >= 100000 then 'HIGH' else 'MEDIUM' end as suspicious_level,
    '{fv.REASON_LARGE}' || cast(amount as varchar) as reason from ledger where amount >= 50000""")
CTE["split"] = (("split_days",), f"""
  select transaction_id, l.customer_id, trans_time, amount, target_account, is_cross_border, country,
    'SPLIT_TRANSACTION' as suspicious_type, 'HIGH' as suspicious_level,
    '{fv.REASON_SPLIT_TOTAL}' || cast(daily_total as varchar) || '{fv.REASON_SPLIT_COUNT}' || txn_count as reason
  from ledger l join split_days d on l.customer_id = d.customer_id and cast(l.trans_time as date) = d.trans_date""")
CTE["crossing"] = (("ledger",), f"""
  select {_base}, 'CROSS_BORDER' as suspicious_type, case when amount >= 50000 then 'HIGH' else 'MEDIUM' end as suspicious_level,
    '{fv.REASON_CROSS_BORDER}' || cast(amount as varchar) || ' ' || country as reason
  from ledger where is_cross_border and amount >= 10000""")
for _name, _cte in (("compliance_large", "large"), ("compliance_split", "split"), ("compliance_cross_border", "crossing")):
    oracle(_name, f"select * replace (cast(amount as double) as amount) from {_cte}", _cte)
CTE["suspicious"] = (("large", "split", "crossing"), f"""
  select *, '{b.BATCH_DATE}' as report_date from (select * from large union select * from split union select * from crossing)""")
oracle("suspicious_report", "select * replace (cast(amount as double) as amount) from suspicious", "suspicious")
oracle("compliance_summary", """select suspicious_type, suspicious_level, count(*) as count, cast(sum(amount) as double) as total_amount
  from suspicious group by 1, 2""", "suspicious")

# --- account features ----------------------------------------------------------------------------
CTE["recent30"] = (("e",), f"\n  select * from e where transaction_time >= timestamp '{b.AS_OF}' - interval 30 day")
CTE["base30"] = (("recent30",), f"""
  select account_id as customer_id_hash, cast(sum(amount) as double) as total_amount_30d,
    {avg4("amount")} as avg_amount_30d, cast(max(amount) as double) as max_amount_30d,
    cast(min(amount) as double) as min_amount_30d, round(stddev_samp(cast(amount as double)), 4) as std_amount_30d,
    count(*) as total_count_30d, round(count(*) / 30.0::double, 4) as avg_daily_count_30d,
    count(*) filter (where is_night_time) as night_count_30d, count(*) filter (where is_weekend) as weekend_count_30d,
    count(distinct channel_code) as channel_diversity_30d, count(distinct merchant_id) as merchant_diversity_30d,
    count(*) filter (where transaction_type = 'TRANSFER') as transfer_count_30d,
    count(*) filter (where transaction_type = 'WITHDRAW') as withdraw_count_30d,
    count(*) filter (where transaction_type = 'PAYMENT') as payment_count_30d
  from recent30 group by account_id""")
CTE["deviation"] = (("recent30",), f"""
  select r.account_id as customer_id_hash, ra4 as recent7d_avg_amount, rc as recent7d_tx_count,
    pa4 as prior21d_avg_amount, round(pc / 21.0::double, 4) as prior21d_daily_avg,
    round(case when pa > 0 then (ra - pa) / pa else 0.0 end, 4) as amount_deviation_ratio,
    round(case when pc / 21.0::double > 0 then (rc / 7.0::double - pc / 21.0::double) / (pc / 21.0::double) else 0.0 end, 4)
      as frequency_deviation_ratio
  from (select account_id, avg(cast(amount as double)) as ra, {avg4("amount")} as ra4, count(*) as rc from recent30
        where transaction_time >= timestamp '{b.AS_OF}' - interval 7 day group by 1) r
  left join (select account_id, avg(cast(amount as double)) as pa, {avg4("amount")} as pa4, count(*) as pc from recent30
        where transaction_time < timestamp '{b.AS_OF}' - interval 7 day group by 1) p using (account_id)""")
oracle("features_30d", "select * from base30", "base30")
oracle("features_30d_partials", "select * from base30", "base30")
oracle("deviation_features", "select * from deviation", "deviation")
oracle("features_merged", f"""select *, '2.0' as feature_version, timestamp '{b.AS_OF}' as computed_at
  from base30 left join deviation using (customer_id_hash)""", "base30", "deviation")
oracle("diversity_30d", """select account_id, count(distinct counterparty_hash) as counterparty_count_30d,
  count(distinct device_id) as device_count_30d, count(distinct ip_city) as city_count_30d from recent30 group by 1""", "recent30")
oracle("rolling_1h_24h", """select transaction_id, count_1h, count_24h, cast(amount_1h as double) as amount_1h,
  cast(amount_24h as double) as amount_24h, cast(inflow_1h as double) as inflow_1h from feat0""", "feat0")
oracle("diversity_asof", "select transaction_id, device_count_30d, city_count_30d, counterparty_count_30d from feat0", "feat0")
oracle("first_device", "select transaction_id, is_first_device from feat", "feat")
oracle("first_device_intent", """select transaction_id, row_number() over (partition by account_id, device_id
  order by transaction_time, transaction_id) = 1 as is_first_device from e""", "e")
oracle("amount_deviation", "select transaction_id, round(amount_deviation, 6) as amount_deviation from feat", "feat")

# --- rules, model, fusion ------------------------------------------------------------------------
oracle("rule_hits", """select transaction_id, rule_id, rule_name, w as risk_weight, lvl as risk_level,
  cast(w as double) as risk_score from hits""", "hits")
oracle("rule_hits_intent", "select transaction_id, rule_id from hits_intent", "hits_intent")
oracle("rules_enabled", """select rule_id, w + 5 as weight, lvl as level, 2 as version, count(*) as hits from hits
  where w <> 30 group by rule_id, w, lvl""", "hits")
oracle("rules_rejected", """select case when s_suppkey % 3 <> 0 then 'unknown rule' when s_suppkey % 2 = 0 then 'no usable weight'
    else 'unknown level' end as reason, count(*) as n from supplier where s_acctbal < 0 and s_suppkey % 7 <> 0 group by 1""")
oracle("rule_score", """select transaction_id, coalesce(cast(rule_score as double), 0.0) as rule_score,
  coalesce(rule_count, 0) as rule_count, coalesce(total_weight, 0.0) as total_weight,
  case lvl when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as highest_risk_level
  from e left join agg using (transaction_id)""", "e", "agg")
oracle("rule_hit_stats", """select rule_id, count(*) as fired, (select count(*) from e) as executions,
  (select count(*) from hits) as fired_total from hits group by rule_id""", "e", "hits")
oracle("risk_factors", f"""select transaction_id, concat_ws('|', labels, case when is_first_device then '{fv.FACTOR_NEW_DEVICE}' end,
  case when is_night_time then '{fv.FACTOR_NIGHT}' end, case when is_cross_border then '{fv.FACTOR_CROSS_BORDER}' end,
  case when ml_score >= 80 then '{fv.FACTOR_MODEL}' end) as risk_factors from engine""", "engine")
oracle("feature_vector", "select transaction_id, " + ", ".join(f"round(v{i}, 6) as v{i}" for i in range(32)) + " from vec", "vec")
oracle("model_fallback", """select transaction_id, 0.5::double as fraud_probability, 'fallback' as model_version,
  cast(round(cast(0.4::double * coalesce(cast(rule_score as double), 0.0) + 30 as decimal(18,8)), 2) as double) as risk_score,
  case when 0.4::double * coalesce(cast(rule_score as double), 0.0) + 30 >= 80 then 'BLOCK'
    when 0.4::double * coalesce(cast(rule_score as double), 0.0) + 30 >= 50 then 'REVIEW' else 'PASS' end as decision
  from e left join agg using (transaction_id)""", "e", "agg")
_top5 = [(i, n, w) for i, (n, w) in enumerate(sorted(fv.FEATURE_IMPORTANCE, key=lambda x: -x[1])[:5])]
oracle("feature_contributions", "select transaction_id, pos, feature_name, shap_value::double as shap_value from e cross join (values "
       + ", ".join(f"({i}, '{n}', {w})" for i, n, w in _top5) + ") as t(pos, feature_name, shap_value)", "e")
oracle("feature_contributions_intent", "select transaction_id, round(greatest("
       + ", ".join(f"{w}::double * v{i}" for i, (_, w) in enumerate(fv.FEATURE_IMPORTANCE)) + "), 6) as top_value from vec", "vec")
_fused_cols = "transaction_id, risk_score, risk_level, decision, confidence, rule_score, ml_score"
for _policy in ("engine", "online", "batch"):
    oracle(f"fusion_{_policy}", f"select {_fused_cols} from {_policy}", _policy)
_top_names = ",".join(n for _, n, _ in _top5)
oracle("assess_flow", f"""select {_fused_cols}, 0.0::double as kb_score, sanction_matched,
  case when sanction_matched then '{fv.SANCTION_DETAIL}' else '' end as sanction_detail, ids as matched_rules,
  factors as risk_factors, '{_top_names}' as top_features from assessed""", "assessed")
oracle("assess_summary", """select count(*) as total, count(*) filter (where event_id % 53 <> 0 and event_id % 61 <> 0) as success,
  count(*) filter (where event_id % 53 = 0 or event_id % 61 = 0) as failed from events""")
oracle("load_csv", """select account_id, sha256(account_id) as account_hash, cast(amount as double) as amount,
  channel_code as channel, device_id, ip_address as ip, is_emulator, is_cross_border from e""", "e")
oracle("account_age", """select o_orderkey, cast(greatest(0, coalesce(date_diff('day',
    date '1992-01-01' + cast(c_custkey % 1500 as int), cast(o_orderdate as date)), 0)) as int) as account_age_days
  from orders left join customer on o_custkey = c_custkey""")
oracle("assess_fallback", """select transaction_id, case when known then risk_score else 30.0 end as risk_score,
  case when known then risk_level else 'LOW' end as risk_level, case when known then decision else 'PASS' end as decision,
  case when known then confidence else 0.5 end as confidence, case when known then rule_score else 0.0 end as rule_score,
  case when known then ml_score else 0.0 end as ml_score, 0.0::double as kb_score
  from (select *, cast(account_id as int) % 10 <> 0 as known from online)""", "online")
oracle("audit_log", """select transaction_id, sha256(transaction_id) as request_id, risk_level, decision,
  cast(trunc(value) as int) as processing_time_ms, transaction_time as created_at, nullif(split_part(ids, ',', 1), '') as first_rule,
  risk_score, rule_score, ml_score, 0.0::double as kb_score, confidence from online""", "online")
oracle("decision_distribution", """select risk_level, decision, count(*) as n, round(avg(risk_score), 4) as avg_score
  from engine group by 1, 2""", "engine")
oracle("score_distribution", """select cast(floor(risk_score / 10) * 10 as int) as bin, count(*) as n from engine group by 1""", "engine")
oracle("score_quantiles", """select round(quantile_cont(risk_score, 0.5), 4) as p50, round(quantile_cont(risk_score, 0.9), 4) as p90,
  round(quantile_cont(risk_score, 0.99), 4) as p99 from engine""", "engine")
