"""Training and scoring with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators.features import FeatureState, fit_features
from cohortflow.schemas import FEATURES, RAW_INPUTS, TARGET
from cohortflow.session import local_table, scratch_path
from cohortflow.sources.zones import write_document

# Model names and default hyperparameters.
RANDOM_FOREST, LOGISTIC_REGRESSION = "random_forest", "logistic_regression"
N_ESTIMATORS, MAX_DEPTH, RANDOM_STATE, MAX_ITER = 100, 10, 42, 1000
TOP_FEATURES = 5

IMPORTANCE = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])

_LOADERS = {RANDOM_FOREST: RandomForestClassificationModel, LOGISTIC_REGRESSION: LogisticRegressionModel}


@dataclass(frozen=True)
class CohortModel:
    """A classifier with the feature state it was trained on.

    ``features`` is None for a classifier trained on rows that were already scaled; such a model
    scores only rows of that form.
    """

    kind: str
    features: FeatureState | None
    classifier: RandomForestClassificationModel | LogisticRegressionModel

    def score(self, rows: DataFrame) -> DataFrame:
        """Input rows plus ``predicted`` (int) and ``p1``; no join, so rows need no key."""
        scored = self.classifier.transform(_with_vector(rows, self.features))
        return scored.withColumns(
            {"predicted": F.col("prediction").cast("int"), "p1": vector_to_array("probability")[1]}
        ).drop("_features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.classifier.write().overwrite().save(f"{path}/classifier")
        if self.features is not None:
            self.features.save(f"{path}/features")
        about = spark.range(1).select(
            F.lit(self.kind).alias("kind"), F.lit(self.features is not None).alias("has_features")
        )
        write_document(about, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CohortModel:
        about = spark.read.schema("kind string, has_features boolean").json(f"{path}/about").first()
        features = FeatureState.load(spark, f"{path}/features") if about["has_features"] else None
        return CohortModel(about["kind"], features, _LOADERS[about["kind"]].load(f"{path}/classifier"))


def _with_vector(rows: DataFrame, features: FeatureState | None) -> DataFrame:
    if features is None:
        return rows.withColumn("_features", array_to_vector(F.array(*FEATURES)))
    vector = array_to_vector(F.array(*[F.col(f"features_scaled.{n}") for n in FEATURES]))
    return features.transform(rows).withColumn("_features", vector).drop("features_scaled")


def train(
    rows: DataFrame,
    kind: str = RANDOM_FOREST,
    n_estimators: int = N_ESTIMATORS,
    max_depth: int = MAX_DEPTH,
    random_state: int = RANDOM_STATE,
    target: str = TARGET,
    features: FeatureState | None = None,
) -> CohortModel:
    """Fit on raw inputs, learning the features first unless given, or on scaled features if the rows
    have no raw categories.

    The logistic regression penalty equals C = 1 on the summed loss: 1/n on the mean loss.
    """
    if kind not in _LOADERS:
        raise ValueError(f"unknown model {kind}")
    if all(name in rows.columns for name in RAW_INPUTS):
        features = features or fit_features(rows)
    else:
        features = None
    vectors = _with_vector(rows, features).select("_features", F.col(target).cast("double").alias("_label"))
    columns = {"featuresCol": "_features", "labelCol": "_label"}
    if kind == RANDOM_FOREST:
        # More histogram memory than the default, so that deep forests need fewer passes over the data.
        estimator = RandomForestClassifier(
            numTrees=n_estimators, maxDepth=max_depth, seed=random_state, maxMemoryInMB=512, **columns
        )
    else:
        estimator = LogisticRegression(
            maxIter=MAX_ITER, regParam=1.0 / rows.count(), elasticNetParam=0.0, standardization=False, **columns
        )
    # Stored and read back: a fresh model carries a training summary that refers to the session, and
    # tasks cannot be sent such a model once the session has observed a metric.
    path = scratch_path(rows.sparkSession, "classifier")
    estimator.fit(vectors).write().save(path)
    return CohortModel(kind, features, _LOADERS[kind].load(path))


def feature_importance(model: CohortModel) -> DataFrame:
    """(feature, importance) of a forest; empty for a model without importances."""
    spark = SparkSession.active()
    values = model.classifier.featureImportances.toArray() if model.kind == RANDOM_FOREST else []
    return local_table(spark, [(name, float(value)) for name, value in zip(FEATURES, values)], IMPORTANCE)


def top_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def model_metadata(
    model: CohortModel,
    training: DataFrame,
    validation: DataFrame,
    target: str = TARGET,
    n_estimators: int = N_ESTIMATORS,
    max_depth: int = MAX_DEPTH,
    random_state: int = RANDOM_STATE,
) -> DataFrame:
    """One row describing a trained model. A forest's settings are its own; the arguments stand for those of a model
    that has none."""
    if model.kind == RANDOM_FOREST:
        forest = model.classifier
        n_estimators, max_depth, random_state = forest.getNumTrees, forest.getMaxDepth(), forest.getSeed()
    importance = feature_importance(model).agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))))
    classes = training.select(F.array_sort(F.collect_set(F.col(target).cast("int"))))
    return SparkSession.active().range(1).select(
        F.lit(model.kind).alias("model_type"),
        F.struct(
            F.lit(n_estimators).alias("n_estimators"),
            F.lit(max_depth).alias("max_depth"),
            F.lit(random_state).alias("random_state"),
        ).alias("hyperparameters"),
        F.array(*[F.lit(n) for n in FEATURES]).alias("feature_names"),
        classes.scalar().alias("target_classes"),
        training.agg(F.count("*")).scalar().alias("training_samples"),
        validation.agg(F.count("*")).scalar().alias("validation_samples"),
        importance.scalar().alias("feature_importance"),
    )


def logistic_score(rows: DataFrame, moments: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Score with given coefficients on standardised inputs (missing counts as 0).

    ``moments`` is the one row of ``scaler_row`` for the weighted columns. The probability is rounded
    to four places, so equal scores occur.
    """
    scored = rows.withColumn("_m", moments.select(F.struct(*moments.columns)).scalar())
    linear = F.lit(intercept)
    for name, weight in weights.items():
        filled = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        linear = linear + weight * ((filled - F.col(f"_m.{name}_mean")) / F.col(f"_m.{name}_std"))
    p1 = F.round(1.0 / (1.0 + F.exp(-linear)), 4)
    return scored.withColumn("p1", p1).withColumn("predicted", (F.col("p1") > 0.5).cast("int")).drop("_m")
