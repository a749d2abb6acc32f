from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortflow.operators import assignment, evaluation

RNG = np.random.default_rng(11)


def outcomes(spark, y, predicted, p1):
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(y, predicted, p1)]
    return spark.createDataFrame(rows, "y int, predicted int, p1 double").repartition(6)


@pytest.fixture(scope="module")
def scored(spark):
    y = RNG.random(3000) < 0.2
    # A third of the rows share one score.
    p1 = np.round(np.clip(RNG.normal(0.3 + 0.35 * y, 0.2), 0, 1), 2)
    p1[::3] = 0.4
    return outcomes(spark, y, p1 > 0.5, p1)


def test_auc_equals_other_definitions(spark, scored):
    found = evaluation.roc_auc(scored).first()["auc"]
    rows = scored.toPandas()
    pos, neg = rows.p1[rows.y == 1].to_numpy(), rows.p1[rows.y == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert found == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="label", numBins=0)
    assert found == pytest.approx(evaluator.evaluate(scored.withColumn("label", F.col("y").cast("double"))), abs=1e-9)


def test_auc_needs_both_classes(spark):
    assert evaluation.roc_auc(outcomes(spark, [1, 1], [1, 0], [0.9, 0.1])).first()["auc"] is None


def test_counts_and_metrics(spark, scored):
    rows = scored.toPandas()
    tp = int(((rows.y == 1) & (rows.predicted == 1)).sum())
    fp = int(((rows.y == 0) & (rows.predicted == 1)).sum())
    fn = int(((rows.y == 1) & (rows.predicted == 0)).sum())
    tn = len(rows) - tp - fp - fn
    cells = evaluation.counts(scored)
    assert cells.first().asDict() == {"tn": tn, "fp": fp, "fn": fn, "tp": tp}
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion_matrix(cells).collect()}
    assert matrix == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}
    metrics = evaluation.binary_metrics(cells).first()
    precision, recall = tp / (tp + fp), tp / (tp + fn)
    assert metrics["accuracy"] == pytest.approx((tp + tn) / len(rows))
    assert metrics["precision"] == pytest.approx(precision)
    assert metrics["recall"] == pytest.approx(recall)
    assert metrics["f1_score"] == pytest.approx(2 * precision * recall / (precision + recall))
    business = evaluation.business_metrics(cells).first()
    assert business["total_test_users"] == len(rows)
    assert business["bucketing_efficiency"] == pytest.approx(precision)
    assert business["coverage"] == pytest.approx(recall)


def test_no_positive_predictions_give_zeros(spark):
    cells = evaluation.counts(outcomes(spark, [1, 0, 0], [0, 0, 0], [0.1, 0.1, 0.1]))
    metrics = evaluation.binary_metrics(cells).first()
    assert (metrics["precision"], metrics["recall"], metrics["f1_score"]) == (0.0, 0.0, 0.0)
    business = evaluation.business_metrics(cells).first()
    assert (business["bucketing_efficiency"], business["coverage"]) == (0.0, 0.0)


def test_report(spark):
    cells = spark.createDataFrame([(50, 10, 5, 35)], "tn long, fp long, fn long, tp long")
    report = {r["class"]: r for r in evaluation.classification_report(cells).collect()}
    assert report["0"]["precision"] == pytest.approx(50 / 55) and report["0"]["support"] == 60
    assert report["1"]["recall"] == pytest.approx(35 / 40) and report["1"]["support"] == 40
    assert report["accuracy"]["f1_score"] == pytest.approx(0.85)
    assert report["macro avg"]["precision"] == pytest.approx((50 / 55 + 35 / 45) / 2)
    assert report["weighted avg"]["recall"] == pytest.approx(0.6 * 50 / 60 + 0.4 * 35 / 40)


def test_approval_passes_at_the_threshold(spark):
    rows = [(0.75, 0.70, 0.65, 0.80), (0.75, 0.70, 0.65, 0.7999), (0.75, 0.70, 0.65, None)]
    df = spark.createDataFrame(rows, "accuracy double, precision double, recall double, auc double")
    first, second, third = evaluation.approval(df).collect()
    assert first["approve_model"] and first["recommendation_reason"] == "All criteria met"
    assert not second["approve_model"] and second["recommendation_reason"] == "Some criteria not met"
    assert second["approval_criteria"].asDict() == {
        "accuracy_pass": True, "precision_pass": True, "recall_pass": True, "auc_pass": False
    }
    assert not third["approve_model"]
    assert first["thresholds"].asDict() == {"min_accuracy": 0.75, "min_precision": 0.7, "min_recall": 0.65, "min_auc": 0.8}


def test_evaluation_record(spark, scored):
    record = evaluation.evaluation_record(scored).first()
    cells = evaluation.counts(scored).first()
    assert record["confusion_matrix"] == [[cells["tn"], cells["fp"]], [cells["fn"], cells["tp"]]]
    assert {r["class"] for r in record["classification_report"]} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert record["business_metrics"]["total_test_users"] == 3000
    assert record["test_auc"] == pytest.approx(evaluation.roc_auc(scored).first()["auc"])


@pytest.mark.parametrize(
    ("prediction", "probability", "kind", "priority"),
    [
        (1, 0.81, "premium_features", "high"),
        (1, 0.8, "engagement_boost", "medium"),
        (1, 0.2, "engagement_boost", "medium"),
        (0, 0.9, "conversion_optimization", "medium"),
        (0, 0.31, "conversion_optimization", "medium"),
        (0, 0.3, "basic_features", "low"),
    ],
)
def test_assignment_table(spark, prediction, probability, kind, priority):
    df = spark.createDataFrame([("u", prediction, probability)], "user_id string, predicted int, p1 double")
    row = assignment.assign_experiments(df).first()
    assert (row["experiment_assignment"]["experiment_type"], row["experiment_assignment"]["priority"]) == (kind, priority)
    assert row["predicted_bucket"] == ("high_value" if prediction else "standard")
    assert row["confidence"] == pytest.approx(probability if prediction else 1 - probability)
    assert row["high_value_probability"] + row["standard_probability"] == pytest.approx(1)


def test_variants_are_sticky_and_balanced(spark):
    def variants(partitions, salt="experiment"):
        df = spark.range(0, 4000, 1, partitions).select(F.concat(F.lit("u"), "id").alias("k"))
        return dict(map(tuple, df.select("k", assignment.variant(F.col("k"), salt)).collect()))

    first = variants(2)
    assert first == variants(9)
    assert first != variants(2, "other test")
    assert sum(v == "A" for v in first.values()) / 4000 == pytest.approx(0.5, abs=0.03)


def test_index_and_json(spark):
    df = spark.createDataFrame([(f"u{i:03d}", 0, i / 100) for i in range(100)], "user_id string, predicted int, p1 double")
    indexed = assignment.with_user_index(assignment.assign_experiments(df.repartition(5)), ["user_id"])
    rows = sorted(indexed.collect(), key=lambda r: r["user_index"])
    assert [r["high_value_probability"] for r in rows] == [i / 100 for i in range(100)]
    text = assignment.as_json(indexed)
    assert text.select(F.from_json("value", indexed.schema).alias("r")).select("r.*").exceptAll(indexed).count() == 0
