"""Fusion of rule and model scores into a level, a decision and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.operators.rules import requires_block

POLICIES = ("engine", "online", "batch")


def confidence(probability: str, rule_count: str = "rule_count") -> Column:
    return F.expr(f"least(1.0D, least(1.0D, {rule_count} / 10.0D) * 0.3D + {probability} * 0.7D)")


def fuse(df: DataFrame, policy: str = "engine", weights: tuple[float, float] = (fv.RULE_WEIGHT, fv.MODEL_WEIGHT),
         probability: str = "fraud_probability") -> DataFrame:
    """Adds ``ml_score``, ``risk_score``, ``risk_level``, ``decision`` and ``confidence``.

    ``engine`` blocks on a blocking rule or a high score confirmed by the model,
    ``online`` replaces the rule condition by a sanction match, ``batch`` looks at the
    score alone.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    scored = df.selectExpr("*", f"least(100.0D, {probability} * 100) as _ml").selectExpr(
        "*", f"greatest(0.0D, least(100.0D, {weights[0]}D * rule_score + {weights[1]}D * _ml)) as _raw")
    confirmed = f"(_raw >= {fv.HIGH_SCORE} and _ml >= {fv.MODEL_BLOCK_SCORE})"
    block = {
        "engine": f"{requires_block()} or {confirmed}",
        "online": f"coalesce(sanction_matched, false) or {confirmed}",
        "batch": f"_raw >= {fv.HIGH_SCORE}",
    }[policy]
    return scored.withColumns({
        "ml_score": F.expr("round(_ml, 2)"),
        "risk_score": F.expr("round(_raw, 2)"),
        "risk_level": F.expr(f"case when _raw >= {fv.HIGH_SCORE} then 'HIGH' when _raw >= {fv.MEDIUM_SCORE} then 'MEDIUM' else 'LOW' end"),
        "decision": F.expr(f"case when {block} then 'BLOCK' when _raw >= {fv.MEDIUM_SCORE} then 'REVIEW' else 'PASS' end"),
        "confidence": F.round(confidence(probability), 2),
    }).drop("_ml", "_raw")


def with_fallback(requests: DataFrame, assessed: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Every request, with the neutral answer where there is no assessment."""
    neutral = {"risk_score": 30.0, "risk_level": "LOW", "decision": "PASS", "confidence": 0.5,
               "rule_score": 0.0, "ml_score": 0.0, "kb_score": 0.0}
    neutral = {c: v for c, v in neutral.items() if c in assessed.columns}
    joined = requests.select(key).join(assessed.select(key, *neutral), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in neutral.items()})


def decision_stats(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("risk_level", "decision").agg(F.count("*").alias("n"), F.avg("risk_score").alias("avg_score"))


def score_histogram(assessed: DataFrame, width: int = 10) -> DataFrame:
    return (assessed.groupBy((F.floor(F.col("risk_score") / width) * width).cast("int").alias("bin"))
            .agg(F.count("*").alias("n")))


def score_quantiles(assessed: DataFrame) -> DataFrame:
    """Exact quantiles; scores have two places, so at most 10 001 distinct values are counted."""
    return assessed.select(*[F.percentile("risk_score", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])
