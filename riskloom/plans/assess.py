"""The assessment of transactions: features, lists, rules, model, cases, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import cleaning, fusion, joins, model, rules

ASSESSMENT = ("transaction_id", "risk_score", "risk_level", "decision", "confidence", "rule_score",
              "ml_score", "kb_score", "matched_rules", "similar_cases", "risk_factors",
              "top_features", "sanction_matched", "sanction_detail")


def score(enriched: DataFrame, policy: str = "online", scorer: PipelineModel | None = None,
          stand_in: bool = False, rule_set: Sequence[rules.Rule] = rules.RULES, mode: str = "literal") -> DataFrame:
    """Rules, model and fusion on rows that carry all features: narrow, one stage."""
    out = model.feature_vector(rules.rule_score(rules.evaluate_rules(enriched, rule_set, mode)))
    if stand_in:
        out = model.importance_probability(out).withColumn("model_version", F.lit("stand-in"))
    else:
        out = model.score_model(out, scorer)
    return fusion.fuse(out, policy)


def assess(enriched: DataFrame, sanctions: DataFrame | None = None, similar: DataFrame | None = None,
           policy: str = "online", scorer: PipelineModel | None = None, stand_in: bool = False,
           rule_set: Sequence[rules.Rule] = rules.RULES, mode: str = "literal") -> DataFrame:
    """Full assessment, one row per transaction.

    ``sanctions`` is a watch list; ``similar`` holds ``transaction_id``, ``kb_score`` and
    ``similar_cases`` from the case search (0 and empty where a row has none).
    """
    rows = cleaning.apply_defaults(enriched)
    if sanctions is not None:
        rows = joins.match_blacklist(rows, sanctions)
    elif "sanction_matched" not in rows.columns:
        rows = rows.withColumns({"sanction_matched": F.lit(False), "sanction_detail": F.lit("")})
    out = model.top_contributions(rules.risk_factors(score(rows, policy, scorer, stand_in, rule_set, mode)))
    if similar is not None:
        out = out.join(similar.select("transaction_id", "kb_score", "similar_cases"), "transaction_id", "left")
        out = out.withColumn("kb_score", F.coalesce("kb_score", F.lit(0.0)))
    else:
        out = out.withColumns({"kb_score": F.lit(0.0), "similar_cases": F.array().cast("array<string>")})
    return out


def try_assess(enriched: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Assessed rows and failed rows: a record without the facts to score it fails alone."""
    named = F.coalesce(F.trim("transaction_id"), F.lit("")) != ""
    usable = named & F.col("amount").isNotNull()
    return assess(enriched.filter(usable), **options), enriched.filter(~usable)


def assess_summary(requests: DataFrame, **options) -> DataFrame:
    """Requests in all, those assessed with a decision, and those that failed alone."""
    done, failed = try_assess(requests, **options)
    outcome = done.select(F.col("decision").isNotNull().alias("ok")).unionByName(failed.select(F.lit(False).alias("ok")))
    return outcome.select(F.count("*").alias("total"), F.count_if("ok").alias("success"),
                          F.count_if(~F.col("ok")).alias("failed"))


def audit_log(assessed: DataFrame, created_at: str = "transaction_time") -> DataFrame:
    """One log row per decision, with a request id derived from the transaction id."""
    return assessed.select(
        "transaction_id", F.sha2("transaction_id", 256).alias("request_id"),
        *[F.col(c).cast("decimal(5,2)").alias(c) for c in ("risk_score", "rule_score", "ml_score", "kb_score")],
        "risk_level", "decision", F.col("confidence").cast("decimal(3,2)").alias("confidence"),
        F.to_json("matched_rules").alias("matched_rules"), F.to_json("similar_cases").alias("similar_cases"),
        F.col("processing_time_ms").cast("int").alias("processing_time_ms"),
        F.col(created_at).alias("created_at"))
