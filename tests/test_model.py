from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.model import LOGISTIC_REGRESSION, CohortModel, feature_importance, model_metadata, top_features, train
from cohortflow.operators.validation import InvalidInput, observed
from cohortflow.plans import jobs
from cohortflow.schemas import FEATURES, RAW_INPUTS, TARGET
from cohortflow.session import materialize
from cohortflow.sources import registry, requests, synthetic
from cohortflow.sources.registry import read_approval


@pytest.fixture(scope="module")
def users(spark):
    return materialize(synthetic.synthetic_cohort(spark, 3000), "test-users")


@pytest.fixture(scope="module")
def forest(users):
    return jobs.train_and_evaluate(users, n_estimators=20, max_depth=6)


def test_training_job(spark, forest, tmp_path):
    validation = forest.validation_metrics.first()
    assert validation["auc"] > 0.95 and validation["accuracy"] > 0.9
    sizes = {r["split"]: r["count"] for r in forest.split.groupBy("split").count().collect()}
    assert sizes == {"train": 1800, "validation": 600, "test": 600}
    # Without arguments the settings come from the model.
    plain = model_metadata(forest.model, forest.split, forest.split).first()["hyperparameters"]
    assert plain["n_estimators"] == 20 and plain["max_depth"] == forest.model.classifier.getMaxDepth()
    metadata = forest.metadata.first()
    assert (metadata["training_samples"], metadata["validation_samples"]) == (1800, 600)
    assert metadata["target_classes"] == [0, 1] and metadata["feature_names"] == FEATURES
    assert metadata["hyperparameters"]["n_estimators"] == 20
    assert sum(metadata["feature_importance"].values()) == pytest.approx(1.0)
    zone = str(tmp_path / "zone")
    path = jobs.publish(forest, "m1", zone)
    registered = spark.read.parquet(f"{zone}/model_registry").first()
    assert (registered["model_id"], registered["path"], registered["status"]) == ("m1", path, "Approved")
    assert registered["metrics"]["business_metrics"]["total_test_users"] == 600
    assert read_approval(spark, f"{path}/model_approval").first()["approve_model"] is True


def test_importance(forest):
    top = top_features(feature_importance(forest.model)).collect()
    assert len(top) == 5
    assert {"engagement_score", "total_spent"} <= {r["feature"] for r in top}
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)


def test_saved_model_scores_alike(spark, forest, users, tmp_path):
    forest.model.save(str(tmp_path / "m"))
    loaded = CohortModel.load(spark, str(tmp_path / "m"))
    first = forest.model.score(users).select("user_id", "predicted", "p1")
    assert first.exceptAll(loaded.score(users).select("user_id", "predicted", "p1")).count() == 0


def test_logistic_regression_on_raw_and_scaled_rows(forest):
    rows = forest.split.where(F.col("split") == "train")
    raw = train(rows, LOGISTIC_REGRESSION)
    scaled_rows = raw.features.transform(rows).select("features_scaled.*", TARGET)
    scaled = train(scaled_rows, LOGISTIC_REGRESSION)
    assert scaled.features is None and feature_importance(scaled).count() == 0
    assert raw.classifier.coefficients.toArray() == pytest.approx(scaled.classifier.coefficients.toArray(), abs=1e-3)
    p_raw = sorted(r["p1"] for r in raw.score(rows).collect())
    p_scaled = sorted(r["p1"] for r in scaled.score(scaled_rows).collect())
    assert p_raw == pytest.approx(p_scaled, abs=1e-3)
    record = model_metadata(scaled, rows, rows).first()
    assert record["model_type"] == LOGISTIC_REGRESSION and record["feature_importance"] == {}


def test_unknown_model(forest):
    with pytest.raises(ValueError, match="unknown model"):
        train(forest.split, "tree")


def test_sample_request(spark, forest, tmp_path):
    (tmp_path / "request.json").write_text(
        '{"age": 35, "session_count": 20, "avg_session_duration": 450.0, "page_views": 35, "purchase_history": 5, '
        '"total_spent": 250.0, "engagement_score": 0.75, "historical_conversion_rate": 0.4, "gender": "female", '
        '"location": "US", "user_id": "r1"}'
    )
    batch = requests.accepted(requests.read_requests(spark, str(tmp_path / "request.json")))
    # "female" was not trained: index 0, the class F.
    encoded = forest.model.features.engineered(batch).first()
    assert (encoded["gender_encoded"], encoded["age_group"], encoded["spending_tier"]) == (0, "adult", "high")
    row = jobs.score_requests(batch, forest.model, capture_path=str(tmp_path / "capture")).first()
    assert row["predicted_bucket"] in ("high_value", "standard")
    assert row["experiment_assignment"]["variant"] in ("A", "B")
    captured = spark.read.parquet(str(tmp_path / "capture")).first()
    assert captured["input"]["age"] == 35.0 and captured["output"]["predicted_bucket"] == row["predicted_bucket"]


def test_failing_requests_are_read_once_and_not_captured(spark, forest, tmp_path):
    rows = [("u1", 35, 20, 450.0, 35, 5, 250.0, 0.75, 0.4, "M", "US"), ("u2", 200, 20, 450.0, 35, 5, 250.0, 0.75, 0.4, "M", "US")]
    batch = spark.createDataFrame(rows, ["user_id", *RAW_INPUTS])
    batch.write.parquet(str(tmp_path / "requests"))
    stored = spark.read.parquet(str(tmp_path / "requests"))
    with pytest.raises(InvalidInput, match="age"):
        jobs.score_requests(stored, forest.model, capture_path=str(tmp_path / "capture"))
    assert not (tmp_path / "capture").exists()
    # The plan that scores and counts scans the requests once.
    counted, _ = observed(stored)
    plan = forest.model.score(counted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "CollectMetrics" in plan
    good = jobs.score_requests(stored.where("age < 100"), forest.model, capture_path=str(tmp_path / "capture"))
    assert good.count() == 1 and spark.read.parquet(str(tmp_path / "capture")).count() == 1


def test_publishing_twice_registers_once(spark, forest, tmp_path):
    rows = lambda: registry.read_rows(spark, f"{tmp_path}/model_registry", "model_id string, status string").count()
    for _ in range(2):
        jobs.publish(forest, "model-9", str(tmp_path), rejects=str(tmp_path / "rejects"))
    rejected = registry.read_rows(spark, str(tmp_path / "rejects"), "model_id string").count()
    assert rows() + rejected == 1


def test_requests_without_an_id(spark, forest, users, tmp_path):
    nameless = users.select(F.lit(None).cast("string").alias("user_id"), *RAW_INPUTS)
    path = str(tmp_path / "capture")
    assigned = jobs.score_requests(nameless, forest.model, mode="quarantine", capture_path=path)
    share = assigned.where("experiment_assignment.variant = 'A'").count() / 3000
    assert share == pytest.approx(0.5, abs=0.05)
    assert spark.read.parquet(path).count() == 3000


def test_label_scope(users):
    train_only = jobs.label_and_split(users.select("user_id", *RAW_INPUTS), label_scope="train")
    assert train_only.groupBy("split").count().count() == 3
    with pytest.raises(ValueError, match="label scope"):
        jobs.label_and_split(users, label_scope="other")


def test_ingest_job(spark, tmp_path):
    report = jobs.ingest(spark, str(tmp_path), "synthetic", n=50)
    assert report["rows"] == 50
