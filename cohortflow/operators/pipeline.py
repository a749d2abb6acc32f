"""Feature engineering as Spark ML stages, so that features and classifier are one pipeline to save, load and tune."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.features import FeatureState, fit_features
from cohortflow.schemas import FEATURES, TARGET

FEATURES_COLUMN = "cohort_features"


class CohortFeatures(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns category indices and scaler moments from raw inputs."""

    @keyword_only
    def __init__(self, *, outputCol: str = FEATURES_COLUMN):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CohortFeaturesModel:
        return self._copyValues(CohortFeaturesModel(fit_features(dataset)))


class CohortFeaturesModel(Model, HasOutputCol, MLReadable, MLWritable):
    """Adds the fourteen scaled features as a vector; rows, streams included, need no key."""

    def __init__(self, state: FeatureState | None = None):
        super().__init__()
        self.state = state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = self.state.transform(dataset)
        vector = array_to_vector(F.array(*[F.col(f"features_scaled.{n}") for n in FEATURES]))
        return scaled.withColumn(self.getOutputCol(), vector).drop("features_scaled")

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _StateWriter(MLWriter):
    """Parameters as metadata, what was learned as tables beside them."""

    def __init__(self, instance: CohortFeaturesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.state.save(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> CohortFeaturesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(FeatureState.load(self.sparkSession, f"{path}/state"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def cohort_pipeline(classifier: RandomForestClassifier | LogisticRegression, label: str = TARGET) -> Pipeline:
    """Features and ``classifier`` as one estimator over raw inputs with a ``label``."""
    features = CohortFeatures()
    return Pipeline(stages=[features, classifier.setFeaturesCol(features.getOutputCol()).setLabelCol(label)])


def answers(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Input rows plus ``predicted`` (int) and ``p1``, as a ``CohortModel`` gives them."""
    scored = model.transform(rows)
    found = {"predicted": F.col("prediction").cast("int"), "p1": vector_to_array("probability")[1]}
    return scored.withColumns(found).drop(FEATURES_COLUMN, "rawPrediction", "probability", "prediction")


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    """A saved pipeline; this module has to be importable, as its stages are found by name."""
    return PipelineModel.load(path)
