"""The rows of the model are computed once for its training and once for its curve."""

import pytest

from riskloom.operators import model
from riskloom.plans import catalogue_links


@pytest.fixture
def rows(spark, monkeypatch):
    scored = spark.createDataFrame(
        [(f"t{i}", None if i % 97 == 0 else str(i % 120), [float((i * j) % 11) for j in range(32)], 0.5, "x") for i in range(600)],
        "transaction_id string, account_id string, features array<double>, fraud_probability double, model_version string")
    orders = spark.createDataFrame([(c, "1-URGENT" if c % 3 else "5-LOW") for c in range(120)], "o_custkey long, o_orderpriority string")
    monkeypatch.setattr(catalogue_links, "scored", lambda *_: scored.repartition(5, "transaction_id"))
    monkeypatch.setattr(catalogue_links.b, "table", lambda *_: orders)
    return scored


def test_training_rows_are_kept_while_the_model_is_fitted(spark, rows, monkeypatch):
    seen = []

    def train(vectors, label):
        seen.append((vectors, vectors.storageLevel.useDisk, vectors.columns))
        return fit(vectors, label)

    fit = model.train_model
    monkeypatch.setattr(model, "train_model", train)
    out = catalogue_links.model_scoring(spark, "").collect()
    (vectors, kept, columns), = seen
    assert kept and columns == ["label", "features"] and not vectors.storageLevel.useDisk
    assert out and len(out) + vectors.count() < len(rows.collect()) and {r.label for r in out} == {0.0, 1.0}


def test_curve_and_counts_read_the_same_scores(spark, rows):
    out = catalogue_links.model_auc(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" in plan
    n, positives, auc = out.first()
    scores = catalogue_links.model_scoring(spark, "").collect()
    assert n == len(scores) and positives == sum(r.label for r in scores)
    pairs = [(p.fraud_probability > q.fraud_probability) + (p.fraud_probability == q.fraud_probability) / 2
             for p in scores if p.label for q in scores if not q.label]
    assert auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
