"""Transaction rules as SQL predicates, and what is derived from their hits.

All rules are evaluated in one narrow projection: an array with one entry per rule, NULL
where the rule does not fire.  A NULL input makes a predicate NULL and so no hit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.schemas import RULE_DEFINITION



@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    description: str
    weight: int
    level: str
    salience: int
    when: str
    intent: str | None = None

    def predicate(self, mode: str) -> str:
        return self.intent if mode == "intent" and self.intent else self.when


def _among(column: str, values: Sequence[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


# Identifiers, names, weights, levels and salience of the published rules.
RULES: tuple[Rule, ...] = (
    Rule("R001", "单笔大额交易", "单笔交易金额≥50万元", 30, "MEDIUM", 100, "amount >= 500000"),
    Rule("R002", "频繁大额交易", "单日累计≥100万元", 40, "MEDIUM", 95, "count_24h >= 5 and amount_24h >= 1000000"),
    Rule("R003", "分散转入集中转出", "单日转入≥10笔且转出累计≥30万元", 60, "HIGH", 90,
         "count_24h >= 10 and amount_24h >= 300000 and transaction_type = 'TRANSFER'"),
    Rule("R004", "整数金额交易", "交易金额为整数万且≥5万元", 20, "LOW", 70, "amount % 10000 = 0 and amount >= 50000"),
    Rule("R005", "快进快出", "1小时内资金转入后立即转出", 45, "MEDIUM", 85,
         "amount >= 10000 and amount_1h >= amount",
         "amount >= 10000 and transaction_type <> 'DEPOSIT' and inflow_1h >= amount"),
    Rule("R007", "小额试探交易", "1h≥3笔交易后立即大额转出", 50, "HIGH", 80, "count_1h >= 3 and amount >= 50000"),
    Rule("R101", "凌晨高频交易", "00:00-05:00交易次数≥3笔且金额≥5万元", 40, "MEDIUM", 85,
         "count_1h >= 3 and is_night_time and amount >= 50000"),
    Rule("R102", "非营业时间大额交易", "非营业时间单笔≥20万元", 30, "MEDIUM", 80,
         "amount >= 200000 and (is_night_time or is_weekend)"),
    Rule("R106", "交易脉冲", "1h≥5笔交易且总金额≥20万元", 55, "HIGH", 75, "count_1h >= 5 and amount_1h >= 200000"),
    Rule("R202", "跨境交易高风险", "资金流向/来源为FATF高风险国家", 60, "HIGH", 90,
         "is_cross_border and length(counterparty_country) > 0",
         "is_cross_border and " + _among("counterparty_country", fv.FATF_COUNTRIES)),
    Rule("R203", "高匿名IP交易", "IP为VPN/代理/Tor", 50, "HIGH", 95, _among("ip_risk_level", fv.ANONYMOUS_IP_LEVELS)),
    Rule("R204", "IP归属地异常", "IP归属地与常驻城市不一致", 35, "MEDIUM", 70,
         "city_count_30d = 1 and ip_risk_level = 'MEDIUM_RISK'"),
    Rule("R206", "高风险地区交易", "IP位于高风险制裁地区", 70, "HIGH", 95, "ip_risk_level = 'HIGH_RISK'"),
    Rule("R301", "新设备首次交易", "设备首次绑定账户且交易≥1万元", 30, "MEDIUM", 80, "is_first_device and amount >= 10000"),
    Rule("R302", "模拟器检测", "设备为模拟器/虚拟机", 60, "HIGH", 95, "is_emulator"),
    Rule("R305", "ROOT/越狱设备", "设备安全状态异常", 45, "MEDIUM", 85, "is_rooted"),
    Rule("R306", "频繁换设备", "30天绑定设备数≥5台", 40, "MEDIUM", 75, "device_count_30d >= 5"),
    Rule("R401", "新注册即大额交易", "账户注册≤24h即发起大额交易", 55, "HIGH", 90,
         "amount >= 50000 and account_age_days <= 1"),
    Rule("R403", "信息变更后交易", "修改绑定信息后立即发起交易", 50, "HIGH", 85, "info_changed_recently and amount >= 10000"),
    Rule("T001", "制裁名单命中", "交易对手命中制裁名单", 100, "HIGH", 100, "sanction_matched"),
    Rule("T002", "高风险行业交易", "交易对手为高风险行业", 55, "HIGH", 80,
         _among("counterparty_industry", fv.RISKY_INDUSTRIES)),
    Rule("T005", "涉及战乱国家", "交易对手位于受制裁/战乱国家", 75, "HIGH", 90,
         "is_cross_border and " + _among("counterparty_country", fv.WAR_COUNTRIES)),
)

def definitions(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rule set as a ``rule_definition`` table."""
    rows = [(r.rule_id, r.name, None, r.weight, r.level, r.description, True, 1) for r in rules]
    return spark.createDataFrame(rows, RULE_DEFINITION)


def _fault(rules: Sequence[Rule]) -> str:
    """SQL: why a row of a rule table cannot be used, or NULL."""
    return f"""case when rule_id is null or not {_among('rule_id', [r.rule_id for r in rules])} then 'unknown rule'
        when risk_weight is null or risk_weight < 0 then 'no usable weight'
        when risk_level is null or not {_among('risk_level', fv.RULE_LEVELS)} then 'unknown level' end"""


def rejected_rules(table: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows that are switched on but cannot be used, with the reason: to be reported, they stop nothing."""
    return table.filter("enabled").withColumn("reason", F.expr(_fault(rules))).filter("reason is not null")


def load_rules(table: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[Rule, ...]:
    """Rules switched on in a ``rule_definition`` table, with its weights and levels.

    Predicates come from the known rules only, levels from the known ones, weights are numbers; rows with
    anything else are left out (``rejected_rules``).  Of several rows for a rule the heaviest counts.
    """
    # one row per known rule at most, whatever the table holds
    rows = (table.filter("enabled").filter(f"({_fault(rules)}) is null").groupBy("rule_id")
            .agg(F.max_by(F.struct("risk_weight", "risk_level"), F.struct("risk_weight", "risk_level")).alias("r"))
            .select("rule_id", "r.*").collect())
    on = {row.rule_id: row for row in rows}
    return tuple(replace(r, weight=on[r.rule_id].risk_weight, level=on[r.rule_id].risk_level)
                 for r in rules if r.rule_id in on)


def evaluate_rules(df: DataFrame, rules: Sequence[Rule] = RULES, mode: str = "literal") -> DataFrame:
    """Adds ``matched_rules``, ordered by salience (highest first), then by rule order.

    All but the predicate, which is code, is bound as a literal: no text of a table is parsed.
    """
    ranked = sorted(rules, key=lambda r: -r.salience)
    names = ("rule_id", "rule_name", "description", "risk_weight", "risk_level", "risk_score")
    entries = [F.when(F.expr(r.predicate(mode)), F.struct(*[
        F.lit(v).alias(n) for n, v in zip(names, (r.rule_id, r.name, r.description, r.weight, r.level, float(r.weight)))])) for r in ranked]
    empty = F.array().cast("array<struct<rule_id:string,rule_name:string,description:string,risk_weight:int,risk_level:string,risk_score:double>>")
    return df.withColumn("matched_rules", F.array_compact(F.array(*entries)) if entries else empty)


def explode_hits(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.inline("matched_rules"))


def rule_score(df: DataFrame, hits: str = "matched_rules") -> DataFrame:
    """Score, hit count, total weight and highest level, from the hit array (no shuffle)."""
    weight = f"aggregate({hits}, 0.0D, (acc, h) -> acc + h.risk_weight)"
    weighted = f"aggregate({hits}, 0.0D, (acc, h) -> acc + h.risk_weight * h.risk_score)"
    sums = df.selectExpr("*", f"size({hits}) as rule_count", f"{weight} as total_weight", f"{weighted} as _weighted", f"""
        case when exists({hits}, h -> h.risk_level = 'HIGH') then 'HIGH'
             when exists({hits}, h -> h.risk_level = 'MEDIUM') then 'MEDIUM' else 'LOW' end as highest_risk_level""")
    score = f"if(total_weight > 0, least(100.0D, _weighted / total_weight * {fv.RULE_SCORE_FACTOR}D), 0.0D)"
    return sums.withColumn("rule_score", F.expr(f"round({score}, 2)")).drop("_weighted")


def requires_block(hits: str = "matched_rules") -> str:
    """SQL condition: a sanction hit or any rule heavy enough to block on its own."""
    return f"exists({hits}, h -> h.rule_id = '{fv.SANCTION_RULE}' or h.risk_weight >= {fv.BLOCKING_RULE_WEIGHT})"


def risk_factors(df: DataFrame, hits: str = "matched_rules", model_score: str = "ml_score") -> DataFrame:
    """Readable reasons: one per hit, then the device, night, border and model remarks."""
    return df.withColumn("risk_factors", F.expr(f"""concat(
        transform({hits}, h -> concat('[', h.rule_id, '] ', h.rule_name)),
        array_compact(array(if(is_first_device, '{fv.FACTOR_NEW_DEVICE}', null), if(is_night_time, '{fv.FACTOR_NIGHT}', null),
                            if(is_cross_border, '{fv.FACTOR_CROSS_BORDER}', null),
                            if({model_score} >= 80, '{fv.FACTOR_MODEL}', null))))"""))


def rule_stats(assessed: DataFrame) -> DataFrame:
    """Per rule: times fired, with the number of evaluations and of all hits alongside.

    One pass: a transaction is counted where its first hit is, or on its own when it has
    none.  The totals are then taken over one row per rule.
    """
    lines = assessed.selectExpr("posexplode_outer(matched_rules) as (pos, hit)").selectExpr(
        "hit.rule_id as rule_id", "if(coalesce(pos, 0) = 0, 1, 0) as opens")
    per_rule = lines.groupBy("rule_id").agg(F.count("rule_id").alias("fired"), F.sum("opens").alias("opened"))
    return per_rule.selectExpr("rule_id", "fired", "sum(opened) over () as executions",
                               "sum(fired) over () as fired_total").filter("rule_id is not null")
