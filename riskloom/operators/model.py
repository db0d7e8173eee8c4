"""Feature vector, model scoring with fallback, and feature contributions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import truthy


def feature_vector(df: DataFrame, output: str = "features") -> DataFrame:
    """The 32 model inputs as ``array<double>``; a missing input or column is 0."""
    present = set(df.columns)

    def number(name: str) -> str:
        return f"coalesce(cast({name} as double), 0.0D)" if name in present else "0.0D"

    def flag(name: str) -> str:
        return f"if(coalesce({name}, false), 1.0D, 0.0D)" if name in present else "0.0D"

    def label(name: str, default: str) -> str:
        return f"upper(coalesce({name}, '{default}'))" if name in present else f"'{default}'"

    def one_hot(name: str, values: tuple[str, ...]) -> list[str]:
        known = ", ".join(f"'{v}'" for v in values)
        value = label(name, "OTHER")
        return [f"if({value} = '{v}', 1.0D, 0.0D)" for v in values] + [f"if({value} in ({known}), 0.0D, 1.0D)"]

    amount, (low, mid, high) = number("amount"), fv.AMOUNT_BINS
    codes = " ".join(f"when '{level}' then {code}D" for level, code in fv.IP_LEVEL_CODES)
    devices = number("device_count_30d")
    slots = [
        f"log10(greatest({amount}, 1.0D)) / 8.0D",
        f"{number('count_1h')} / 100.0D", f"{number('count_24h')} / 1000.0D",
        f"{devices} / 50.0D", f"{number('city_count_30d')} / 20.0D", f"{number('counterparty_count_30d')} / 100.0D",
        flag("is_night_time"), flag("is_cross_border"), flag("is_first_device"),
        f"case {label('ip_risk_level', 'NORMAL')} {codes} else 0.0D end",
        f"least(1.0D, {number('amount_deviation')} / 10.0D)",
        flag("is_emulator"), flag("is_rooted"),
        *one_hot("channel_code", fv.CHANNELS), *one_hot("transaction_type", fv.TRANSACTION_TYPES),
        f"if({amount} <= {low}, 1.0D, 0.0D)", f"if({amount} > {low} and {amount} <= {mid}, 1.0D, 0.0D)",
        f"if({amount} > {mid} and {amount} <= {high}, 1.0D, 0.0D)", f"if({amount} > {high}, 1.0D, 0.0D)",
        flag("is_weekend"), flag("is_holiday"),
        f"if({amount} > 0, {number('amount_1h')} / {amount}, 0.0D)",
        f"if({devices} > 0, {number('count_24h')} / {devices}, 0.0D)",
    ]
    return df.withColumn(output, F.expr(f"array({', '.join(slots)})"))


def importance_probability(df: DataFrame, features: str = "features", factor: float = 3.0,
                           output: str = "fraud_probability") -> DataFrame:
    """Stand-in probability: importance-weighted sum of the first slots, scaled and clipped."""
    terms = " + ".join(f"{weight}D * {features}[{i}]" for i, (_, weight) in enumerate(fv.FEATURE_IMPORTANCE))
    return df.withColumn(output, F.expr(f"least(1.0D, {factor}D * ({terms}))"))


def train_model(vectors: DataFrame, label: str, features: str = "features", seed: int = 7,
                stages: list | None = None) -> PipelineModel:
    """Fit a classifier on labelled feature arrays; ``stages`` replaces the default one."""
    data = vectors.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("_vector"))
    stages = stages or [LogisticRegression(featuresCol="_vector", labelCol="label", maxIter=25, regParam=0.01)]
    return Pipeline(stages=stages).fit(data)


def score_model(df: DataFrame, model: PipelineModel | None, features: str = "features") -> DataFrame:
    """Adds ``fraud_probability`` and ``model_version``.

    A missing model, or a row the model gives no number for, gets the fallback
    probability and the version ``fallback``.
    """
    if model is None:
        raw = df.withColumn("_p", F.lit(None).cast("double"))
    else:
        usable = F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x))
        zero = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda _: F.lit(0.0))
        ready = df.withColumns({"_usable": truthy(usable),
                                "_vector": array_to_vector(F.when(usable, F.col(features)).otherwise(zero))})
        scored = model.transform(ready)
        raw = scored.select(*df.columns, F.when(F.col("_usable"), vector_to_array("probability")[1]).alias("_p"))
    ok = F.col("_p").isNotNull() & ~F.isnan("_p")
    return raw.select(
        *df.columns,
        F.when(ok, F.col("_p")).otherwise(fv.FALLBACK_PROBABILITY).alias("fraud_probability"),
        F.when(ok, F.lit("2.0.0")).otherwise("fallback").alias("model_version"))


def area_under_curve(scored: DataFrame, label: str, probability: str = "fraud_probability") -> float:
    """Area under the ROC curve of a scored table."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=probability).evaluate(
        scored.select(F.col(label).cast("double").alias(label), probability))


def top_contributions(df: DataFrame, k: int = 5, mode: str = "literal", features: str = "features",
                      output: str = "top_features") -> DataFrame:
    """The ``k`` most important features, ties in table order.

    ``literal`` ranks the fixed importances; ``intent`` ranks importance times value.
    """
    entries = ", ".join(
        "struct({value} as shap_value, {i} as slot, '{name}' as feature_name)".format(
            value=f"{weight}D" if mode == "literal" else f"{weight}D * {features}[{i}]", i=i, name=name)
        for i, (name, weight) in enumerate(fv.FEATURE_IMPORTANCE))
    by_value = "case when a.shap_value <> b.shap_value then sign(b.shap_value - a.shap_value) else a.slot - b.slot end"
    best = f"slice(array_sort(array({entries}), (a, b) -> cast({by_value} as int)), 1, {k})"
    return df.withColumn(output, F.expr(
        f"transform({best}, f -> struct(f.feature_name, f.shap_value, f.feature_name as description))"))
