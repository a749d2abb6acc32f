from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from cohortflow.operators import pipeline
from cohortflow.operators.features import fit_label_rule
from cohortflow.operators.model import LOGISTIC_REGRESSION, train
from cohortflow.schemas import RAW_INPUTS, TARGET
from cohortflow.session import materialize
from cohortflow.sources import synthetic


@pytest.fixture(scope="module")
def rows(spark):
    users = materialize(synthetic.synthetic_cohort(spark, 1500), "pipeline-users")
    return materialize(users.select("user_id", *RAW_INPUTS, fit_label_rule(users).label().alias(TARGET)), "pipeline-rows")


def logistic(n, **more):
    return LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, **more)


def scores(df):
    return {r["user_id"]: r["p1"] for r in df.select("user_id", "p1").collect()}


def test_a_saved_pipeline_gives_the_same_scores(spark, rows, tmp_path):
    fitted = pipeline.cohort_pipeline(logistic(1500)).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = pipeline.load_pipeline(spark, str(tmp_path / "model"))
    assert isinstance(loaded, PipelineModel) and [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    before, after = scores(pipeline.answers(fitted, rows)), scores(pipeline.answers(loaded, rows))
    assert before == after
    # And those of the same classifier trained step by step.
    apart = scores(train(rows, LOGISTIC_REGRESSION).score(rows))
    assert before == pytest.approx(apart, abs=1e-6)
    # Rows with values that were not fitted, without a label.
    other = rows.limit(20).drop(TARGET).withColumns({"location": F.lit("XX"), "gender": F.lit(None).cast("string")})
    assert pipeline.answers(loaded, other).where("p1 BETWEEN 0 AND 1").count() == 20


def test_the_estimator_is_saved_and_tuned(spark, rows, tmp_path):
    forest = RandomForestClassifier(numTrees=5, seed=1)
    estimator = pipeline.cohort_pipeline(forest)
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    again = Pipeline.load(str(tmp_path / "estimator"))
    assert [type(s) for s in again.getStages()] == [pipeline.CohortFeatures, RandomForestClassifier]
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [1, 5]).build()
    chosen = TrainValidationSplit(estimator=estimator, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=TARGET), trainRatio=0.7, seed=3)
    best = chosen.fit(rows)
    assert len(best.validationMetrics) == 2 and best.bestModel.stages[1].getMaxDepth() in (1, 5)
    assert max(best.validationMetrics) > 0.8


def test_a_pipeline_scores_a_stream(spark, rows, tmp_path):
    fitted = pipeline.cohort_pipeline(logistic(1500)).fit(rows)
    rows.write.parquet(str(tmp_path / "in"))
    stream = pipeline.answers(fitted, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query.start(str(tmp_path / "out")).awaitTermination()
    assert scores(spark.read.parquet(str(tmp_path / "out"))) == scores(pipeline.answers(fitted, rows))
