"""SQL for links, similar cases, alerts, cases, reports, indicators and sinks."""

from __future__ import annotations

from riskloom import fixed_values as fv
from riskloom.operators import reports
from riskloom.operators.case_search import SYMBOLS
from riskloom.plans import bindings as b
from riskloom.plans.oracles import CTE, _customer_level, oracle

# --- links ---------------------------------------------------------------------------------------
CTE["link"] = (("e",), """
  select account_id as customer_id, ip_address, device_id, transaction_time as trans_time, amount from e""")


def _members(kind, key, having="true"):
    return f"""select '{kind}' as relationship_type, {key} as group_key, customer_id, count(*) as n, sum(amount) as total
      from link group by {key}, customer_id having {having}"""


CTE["members"] = (("link",), f"""
  {_members('SAME_IP', 'ip_address')} union all {_members('SAME_DEVICE', 'device_id')} union all
  {_members('BURST_TXN', "strftime(date_trunc('hour', trans_time), '%Y-%m-%d %H:%M')", 'count(*) >= 2')}""")
CTE["groups"] = (("members",), """
  select relationship_type, group_key, count(*) as customer_count, cast(sum(n) as bigint) as txn_count,
    cast(sum(total) as double) as total_amount,
    case when relationship_type = 'BURST_TXN' then 'HIGH' when relationship_type = 'SAME_IP' and count(*) >= 5 then 'HIGH'
      when relationship_type = 'SAME_DEVICE' and count(*) >= 3 then 'HIGH' else 'MEDIUM' end as risk_level
  from members group by relationship_type, group_key having count(*) > 1""")
for _name, _kind in (("link_same_ip", "SAME_IP"), ("link_same_device", "SAME_DEVICE"), ("link_burst", "BURST_TXN")):
    oracle(_name, f"select * from groups where relationship_type = '{_kind}'", "groups")
oracle("relationship_groups", f"select *, '{b.BATCH_DATE}' as batch_date from groups", "groups")
oracle("link_edges", """select relationship_type, group_key, customer_id, n as weight
  from members join groups using (relationship_type, group_key)""", "members", "groups")
# stars: every member of a group to the group's smallest one, then reachability over all kinds of links
CTE["stars"] = (("members", "groups"), """
  select distinct u, v from (
    select customer_id as u, min(customer_id) over (partition by relationship_type, group_key) as v
    from members join groups using (relationship_type, group_key)) where u <> v""")
oracle("link_components", """select customer_id, component from (
  with recursive both_ways as (select u, v from stars union select v, u from stars),
  reach(u, v) as (select u, v from both_ways union select r.u, p.v from reach r join both_ways p on r.v = p.u)
  select u as customer_id, least(u, min(v)) as component from reach group by u)""", "stars")

# --- similar cases -------------------------------------------------------------------------------
_labels = fv.CASE_TEXT_LABELS
CTE["case_texts"] = (("cases",), f"""
  select case_id, concat_ws(chr(10), '{_labels[0]}: ' || case_title, '{_labels[1]}: ' || case_type,
  '{_labels[2]}: ' || coalesce(nullif(fraud_pattern, ''), '{fv.TEXT_UNKNOWN}'),
  '{_labels[3]}: ' || coalesce(nullif(modus_operandi, ''), '{fv.TEXT_NONE}'), '{_labels[4]}: ' || case_description,
  '{_labels[5]}: ' || coalesce(nullif(resolution, ''), '{fv.TEXT_NONE}')) as case_text from cases""")
oracle("case_text", "select * from case_texts", "case_texts")
_t = fv.TRANSACTION_TEXT_LABELS
CTE["txn_texts"] = (("feat",), f"""
  select transaction_id, concat_ws(chr(10), '{_t[0]}: ' || cast(amount as varchar), '{_t[1]}: ' || transaction_type,
  '{_t[2]}: ' || channel_code, '{_t[3]}: ' || rtrim(rtrim(strftime(transaction_time, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'),
  '{_t[4]}: ' || count_1h, '{_t[5]}: ' || count_24h,
  '{_t[6]}: ' || case when is_first_device then 'True' else 'False' end,
  '{_t[7]}: ' || case when is_cross_border then 'True' else 'False' end, '{_t[8]}: ' || ip_risk_level,
  '{_t[9]}: ' || device_count_30d, '{_t[10]}: ' || city_count_30d, '{_t[11]}: ' || cast(cast(round(amount_deviation, 4) as decimal(20, 4)) as varchar)) as txn_text from feat""")
oracle("txn_text", "select * from txn_texts", "txn_texts")

CTE["sims"] = ((), """
  select q.vec_id as query_id, c.vec_id as case_id,
    round(list_inner_product(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as similarity
  from embeddings q cross join embeddings c""")
CTE["top10"] = (("sims",), """
  select * from (select *, cast(row_number() over (partition by query_id order by similarity desc, case_id) as int) as rank from sims)
  where rank <= 10""")
for _name in ("vector_topk", "vector_topk_blocked", "vector_topk_ivf"):
    oracle(_name, "select query_id, case_id, similarity, rank from top10 where rank <= 5", "top10")
_symbols = "['" + "','".join(SYMBOLS) + "']"


def _embedded(key: str, text: str, source: str) -> str:
    """Unit vectors of symbol counts in single precision, as doubles."""
    counts = (f"list_transform({_symbols}, lambda s: length({text}) - length(replace(replace({text}, s, ''), upper(s), '')))")
    return f"""
  select {key}, list_transform(c, lambda x: case when norm > 0 then x / norm else 0.0 end::float::double) as v
  from (select {key}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))::double) as norm
        from (select {key}, {counts} as c from {source}))"""


CTE["case_vectors"] = (("case_texts",), _embedded("case_id", "coalesce(case_text, '')", "case_texts"))
CTE["txn_vectors"] = (("txn_texts",), _embedded("transaction_id", "txn_text", "txn_texts"))
CTE["case_hits"] = (("case_vectors", "txn_vectors"), f"""
  select transaction_id, avg(similarity) * 100 as kb_score, string_agg(case_id, ',' order by rank) as similar_cases from (
    select *, row_number() over (partition by transaction_id order by similarity desc, case_id) as rank from (
      select transaction_id, case_id, round(array_inner_product(t.v::double[{len(SYMBOLS)}], c.v::double[{len(SYMBOLS)}]), 6) as similarity
      from txn_vectors t cross join case_vectors c) qualify rank <= 5) group by transaction_id""")
oracle("embed_cases_symbols", """select case_id, (pos - 1)::int as pos, round(v[pos], 6) as value
  from case_vectors, unnest(range(1, len(v) + 1)) as u(pos)""", "case_vectors")
oracle("assess_with_library", """select transaction_id, risk_score, risk_level, decision, confidence, rule_score, ml_score,
  round(kb_score, 6) as kb_score, similar_cases from online join case_hits using (transaction_id)""", "online", "case_hits")
oracle("stream_assess_cases", """select transaction_id, risk_score, risk_level, decision, round(kb_score, 6) as kb_score, similar_cases
  from online join case_hits using (transaction_id)""", "online", "case_hits")
oracle("kb_relevance", """select query_id, round(avg(similarity) * 100, 6) as kb_score,
  string_agg(cast(case_id as varchar), ',' order by rank) filter (where rank <= 5) as similar_cases from top10 group by query_id""", "top10")
_c = fv.CONTEXT_LABELS
oracle("rag_context", f"""select query_id, '{fv.CONTEXT_HEADER}' || chr(10) || string_agg(
    '### 案例' || rank || ': Case ' || case_id || ' (相似度: ' || cast(cast(cast(similarity as decimal(10,6)) * 100 as decimal(10,2)) as varchar) || '%)' || chr(10)
    || '- **{_c[0]}**: TYPE-' || label || chr(10) || '- **{_c[1]}**: pattern ' || case_id % 7 || chr(10)
    || '- **{_c[2]}**: method ' || case_id % 5 || chr(10) || '- **{_c[3]}**: resolution ' || case_id % 3 || chr(10)
    || '- **{_c[4]}**: ' || case when case_id % 2 = 0 then 'effect ' || case_id else '{fv.TEXT_NONE}' end || chr(10),
    chr(10) order by rank) as context
  from top10 join embeddings on case_id = vec_id where rank <= 3 group by query_id""", "top10")
oracle("case_index_stats", """select vec_id, row_number() over (order by label >= 5, vec_id) - 1 as position,
  len(embedding) as dimension from embeddings""")
_split = r"string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+')"
for _name, _where in (("text_search", "case_type = 'FRAUD'"), ("text_search_all", "true")):
    oracle(_name, f"""
, words as (select doc_id, unnest({_split.format("case_title || ' ' || case_description || coalesce(' ' || modus_operandi, '')")}) as term
    from cases where {_where}),
asked as (select distinct item_id, unnest({_split.format('text')}) as term from benchmark),
tf as (select doc_id, term, count(*) as tf from words where term in (select term from asked) and term <> '' group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
scores as (select item_id as query_id, doc_id as case_id,
    round(sum(tf * pow(log10((select count(*) from cases where {_where}) / df::double), 2)), 6) as similarity
  from asked join tf using (term) join df using (term) group by 1, 2)
select * from (select query_id, case_id, similarity, cast(row_number() over (partition by query_id order by similarity desc, case_id) as int) as rank
  from scores where similarity > 0) where rank <= 5""".lstrip(), "cases")
oracle("case_index_rebuild", """select cast(vec_id as varchar) as case_id, row_number() over (order by cast(vec_id as varchar)) - 1 as position,
  len(embedding) as dimension from embeddings""")

# --- alerts and cases ----------------------------------------------------------------------------
CTE["alerts"] = (("engine",), """
  select 'ALT' || sha256(transaction_id) as alert_id, transaction_id, account_id as customer_id,
    'FRAUD' as alert_type, risk_score, risk_level, decision as agent_decision, 'NEW' as alert_status, 0 as escalation_level,
    transaction_time as created_at, transaction_time + interval 24 hour as processing_deadline
  from engine where risk_level = 'HIGH'""")
oracle("alerts_created", "select * from alerts", "alerts")
oracle("alert_messages", """select transaction_id as key, '{"alert_id":"' || alert_id || '","transaction_id":"' || transaction_id
  || '","risk_level":"HIGH","alert_status":"NEW"}' as value from alerts""", "alerts")
CTE["alert_states"] = ((), """
  select user_id as alert_id, case arg_max(event_type, event_id) when 'signup' then 'NEW' when 'click' then 'PROCESSING'
      when 'purchase' then 'RESOLVED' when 'error' then 'PENDING' else 'CLOSED' end as alert_status,
    'analyst-' || (max(event_id) filter (where event_type in ('click', 'purchase', 'view')) % 7) as assignee,
    count(*) filter (where event_type = 'error') as escalation_level, max(ts) as updated_at
  from events group by user_id""")
oracle("alert_state", "select * from alert_states", "alert_states")
oracle("stream_alert_state", "select * from alert_states", "alert_states")
oracle("stream_escalations", """select user_id as alert_id, s.ts + interval 24 hour as deadline from events s, lateral (
    select event_type, event_id from events a where a.user_id = s.user_id and a.ts <= s.ts + interval 24 hour
    order by a.ts desc, a.event_id desc limit 1) last
  where s.event_type = 'signup' and s.ts + interval 24 hour < (select max(ts) from events) - interval 10 second
    and last.event_type in ('signup', 'click', 'error') and not exists (select 1 from events n where n.user_id = s.user_id
      and n.event_type = 'signup' and n.ts > s.ts and n.ts <= s.ts + interval 24 hour)""")
oracle("alert_status_counts", "select alert_status, count(*) as n from alert_states group by 1", "alert_states")
oracle("alert_overdue", f"""select alert_id, transaction_id, 'PENDING' as alert_status, 1 as escalation_level, processing_deadline
  from alerts where processing_deadline < timestamp '{b.AS_OF}'""", "alerts")
oracle("alert_page_after", """select * from alert_states where alert_status = 'CLOSED' order by updated_at, alert_id
  limit 10 offset 10""", "alert_states")
# a page beyond the end shows the first page
for _name, _page in (("alert_page", 1), ("alert_page_overflow", 100000)):
    oracle(_name, f"""select alert_id, alert_status, assignee, escalation_level, updated_at from (
      select *, row_number() over (order by updated_at, alert_id) - 1 as rn, count(*) over () as total
      from alert_states where alert_status = 'CLOSED')
      where rn // 10 = case when total <= {_page} * 10 then 0 else {_page} end""", "alert_states")
oracle("alert_page_total", """select status, mode, total, 1 as page, 10 as size from (
    select 'CLOSED' as status, 'literal' as mode, count(*) filter (where alert_status = 'CLOSED') as total from alert_states
    union all select 'ALL', 'literal', 0
    union all select 'ALL', 'intent', count(*) from alert_states)""", "alert_states")
oracle("cases_created", """select 'CASE' || upper(sha256(alert_id)) as case_id, alert_id, 'NEW' as case_status,
  2 as priority, created_at from alerts""", "alerts")
CTE["order_cases"] = ((), """
  select o_orderkey as case_id, o_custkey as customer_id, case o_orderstatus when 'P' then 'NEW' when 'F' then 'CLOSED' else 'INVESTIGATING' end as case_status,
    case left(o_orderpriority, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM' else 'LOW' end as risk_level,
    o_orderdate as created_at from orders""")
oracle("case_priority", """select case risk_level when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 else 4 end as priority,
  case_status, count(*) as n from order_cases group by 1, 2""", "order_cases")
oracle("case_stats", """select count(*) as total_cases, count(*) filter (where case_status = 'NEW') as new_cases,
  count(*) filter (where case_status in ('ASSIGNED', 'INVESTIGATING')) as in_progress,
  count(*) filter (where case_status in ('CLOSED', 'ARCHIVED')) as closed_cases from order_cases""", "order_cases")
_case_state = """case event_type when 'signup' then 'NEW' when 'click' then 'ASSIGNED' when 'view' then 'CLOSED' else 'INVESTIGATING' end"""
oracle("case_state", f"""select user_id as case_id, arg_max({_case_state}, event_id) as case_status,
  'analyst-' || (max(event_id) filter (where event_type = 'click') % 7) as assignee, min(ts) as created_at,
  max(ts) filter (where event_type = 'click') as assigned_at, max(ts) filter (where event_type = 'view') as closed_at,
  max(ts) as updated_at from events group by user_id""")
oracle("case_durations", f"""select case_id, case_status, count(*) as entered, round(sum(us) / 1e6, 3) as seconds from (
  select user_id as case_id, {_case_state} as case_status, date_diff('microsecond', ts,
    coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '{b.AS_OF}')) as us from events) group by 1, 2""")
oracle("case_page", "select * from order_cases where case_status = 'INVESTIGATING' order by created_at desc, case_id limit 20 offset 40", "order_cases")

# --- reports and indicators ----------------------------------------------------------------------
oracle("report_compliance", """select report_date, transaction_id, s.customer_id, cast(amount as double) as amount, suspicious_type,
  suspicious_level, coalesce(status, 'NEW') as status from suspicious s left join (
    select customer_id, arg_max(case_status, (created_at, case_id)) as status from order_cases group by 1) c using (customer_id)""",
       "suspicious", "order_cases")
oracle("report_base", """select cast(a.created_at as date) as report_date, alert_id, a.transaction_id, transaction_time as trans_time,
  a.customer_id, customer_name, account_type, cast(amount as double) as amount, 'FRAUD' as alert_type, a.risk_level,
  case when event_id % 3 <> 0 then 'CASE' || upper(sha256(alert_id)) end as case_id,
  case when event_id % 3 = 0 then 'NEW' else ['NEW', 'ASSIGNED', 'INVESTIGATING', 'CLOSED'][event_id % 4 + 1] end as status,
  a.created_at + case when event_id % 3 <> 0 then interval 1 day * (event_id % 50) else interval 0 day end as last_update
  from alerts a join e using (transaction_id) left join profile p on cast(p.customer_id as varchar) = a.customer_id""", "alerts", "e", "profile")
oracle("report_customer_risk", f"""select customer_id, customer_name, {_customer_level} as risk_level,
  coalesce(case_count, 0) as case_count, last_update, coalesce(anomaly_count, 0) as anomaly_count
  from customer_scores left join (select customer_id, count(*) as case_count, max(created_at) as last_update from order_cases group by 1) using (customer_id)
  left join (select customer_id, count(*) as anomaly_count from suspicious group by 1) using (customer_id)""",
       "customer_scores", "suspicious", "order_cases")
for _grain, _unit in reports.GRAINS.items():
    oracle(f"report_{_grain}", f"""
, counted as (
  select cast(date_trunc('{_unit}', trans_time) as date) as period, 'new_alerts' as metric, count(*) as value from suspicious group by 1
  union all select cast(date_trunc('{_unit}', created_at) as date), 'cases_in_progress',
    count(*) filter (where case_status = 'INVESTIGATING') from order_cases group by 1
  union all select cast(date_trunc('{_unit}', created_at) as date), 'cases_closed',
    count(*) filter (where case_status = 'CLOSED') from order_cases group by 1),
lagged as (select *, lag(value) over (partition by metric order by period) as previous from counted)
select period, metric, value, round((value - previous) / nullif(previous::double, 0), 6) as change,
  case when value > previous then '{fv.TREND_UP}' when value < previous then '{fv.TREND_DOWN}'
    when value = previous then '{fv.TREND_FLAT}' end as trend from lagged""".lstrip(), "suspicious", "order_cases")

CTE["decisions"] = (("online",), """
  select transaction_time as created_at, decision, cast(trunc(value) as int) as ms, ids = '' as search_empty from online""")
oracle("kpi_latency", """select time_bucket(interval 1 hour, created_at) as window_start, count(*) as n,
  round(quantile_cont(ms, 0.5), 4) as p50_ms, round(quantile_cont(ms, 0.95), 4) as p95_ms, round(quantile_cont(ms, 0.99), 4) as p99_ms
  from decisions group by 1""", "decisions")
oracle("kpi_decision_rate", """select window_start, decision, count(*) as n, round(count(*) / 3600.0::double, 9) as per_second from (
  select time_bucket(interval 30 minute, created_at) as window_start, decision from decisions
  union all select time_bucket(interval 30 minute, created_at) - interval 30 minute, decision from decisions) group by 1, 2""", "decisions")
oracle("kpi_rule_rate", """select time_bucket(interval 1 day, transaction_time) as window_start, rule_id, count(*) as n,
  round(count(*) / 86400.0::double, 9) as per_second from hits join e using (transaction_id) group by 1, 2""", "hits", "e")
oracle("alert_conditions", """
, steps as (select time_bucket(interval 1 hour, created_at) as step, quantile_cont(ms, 0.99) as p99,
    count(*) filter (where decision = 'BLOCK') / count(*)::double as blocked,
    count(*) filter (where search_empty) / count(*)::double as empty from decisions group by 1),
calendar as (select unnest(generate_series(min(step), max(step), interval 1 hour)) as step from steps),
states as (select calendar.step, unnest([
    {'condition': 'high_latency', 'held': coalesce(p99 > 90.0, false)},
    {'condition': 'high_block_share', 'held': coalesce(blocked > 0.05, false)},
    {'condition': 'no_rule_execution', 'held': steps.step is null},
    {'condition': 'empty_search_share', 'held': coalesce(empty > 0.1, false)}]) as s
  from calendar left join steps on calendar.step = steps.step)
select condition, step from (select s.condition as condition, step, s.held as held,
    lag(s.held) over (partition by s.condition order by step) as before from states) where held and before""".lstrip(), "decisions")

# --- sinks ---------------------------------------------------------------------------------------
oracle("json_encode", """select account_id as key, '{"account_id":"' || account_id || '","transaction_id":"' || transaction_id
  || '","transaction_type":"' || transaction_type || '","k":' || k || ',"is_cross_border":' || is_cross_border || '}' as value from e""", "e")
oracle("feature_store_latest", """select account_id, transaction_time, count_1h, count_24h, device_count_30d, city_count_30d,
  counterparty_count_30d, is_night_time, is_cross_border, is_first_device, ip_risk_level, cast(amount_1h as double) as amount_1h,
  cast(amount_24h as double) as amount_24h, 'risk:feature:' || account_id as store_key, transaction_time + interval 24 hour as expires_at
  from feat qualify row_number() over (partition by account_id order by transaction_time desc) = 1""", "feat")
oracle("sink_overwrite", f"""select customer_id, risk_score, {_customer_level} as risk_level, batch_date
  from customer_scores cross join (values ('2024-01-30'), ('2024-01-31')) as d(batch_date)""", "customer_scores")
oracle("sink_append", f"""select customer_id_hash, total_count_30d, night_count_30d, weekend_count_30d, channel_diversity_30d,
  merchant_diversity_30d, '2.0' as feature_version, timestamp '{b.AS_OF}' as computed_at, total_amount_30d, max_amount_30d
  from base30""", "base30")
oracle("offline_feature_store", f"""select customer_id_hash, total_count_30d, night_count_30d, channel_diversity_30d,
  timestamp '{b.AS_OF}' as computed_at, total_amount_30d, max_amount_30d, avg_amount_30d, std_amount_30d, avg_daily_count_30d,
  amount_deviation_ratio, frequency_deviation_ratio, 'risk:offline_feature:' || customer_id_hash as store_key,
  timestamp '{b.AS_OF}' + interval 24 hour as expires_at from base30 left join deviation using (customer_id_hash)""", "base30", "deviation")
oracle("enriched_nested", """select transaction_id, transaction_type, count_24h, is_first_device, cast(amount as double) as amount from feat""", "feat")
