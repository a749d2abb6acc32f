"""The batch jobs: ingest, training with approval, and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.assignment import assign_experiments
from cohortflow.operators.evaluation import all_metrics, approval, evaluation_record
from cohortflow.operators.features import fit_label_rule
from cohortflow.operators.model import (
    MAX_DEPTH,
    N_ESTIMATORS,
    RANDOM_FOREST,
    RANDOM_STATE,
    CohortModel,
    model_metadata,
    train,
)
from cohortflow.operators.split import stratified_split
from cohortflow.operators.validation import observed, validate
from cohortflow.schemas import LABEL, RAW_INPUTS, TARGET
from cohortflow.session import materialize
from cohortflow.sources.capture import write_capture
from cohortflow.sources.registry import gate_and_register
from cohortflow.sources.selector import load_users
from cohortflow.sources.snapshots import write_raw
from cohortflow.sources.zones import write_document


def ingest(
    spark: SparkSession, zone: str, kind: str, path: str | None = None, fmt: str = "csv", **options
) -> dict:
    """Load users and append them to the raw zone; returns location and row count. Large zones want parquet."""
    return write_raw(load_users(spark, kind, path, **options), zone, fmt=fmt)


def label_and_split(users: DataFrame, key: str = "user_id", label_scope: str = "all") -> DataFrame:
    """Users (a stored table) with label and split.

    ``label_scope="train"`` takes the label thresholds from the training rows alone; the split is then
    stratified by the thresholds of all rows, as it must come first.
    """
    split = stratified_split(users.withColumn(LABEL, fit_label_rule(users).label()), LABEL, key)
    if label_scope == "all":
        return split
    if label_scope != "train":
        raise ValueError(f"unknown label scope {label_scope}")
    stored = materialize(split, "split")
    return stored.withColumn(LABEL, fit_label_rule(stored.where(F.col("split") == "train")).label())


@dataclass(frozen=True)
class TrainingResult:
    model: CohortModel
    validation_metrics: DataFrame
    evaluation: DataFrame
    approval: DataFrame
    metadata: DataFrame
    split: DataFrame


def train_and_evaluate(
    users: DataFrame,
    kind: str = RANDOM_FOREST,
    key: str = "user_id",
    n_estimators: int = N_ESTIMATORS,
    max_depth: int = MAX_DEPTH,
    random_state: int = RANDOM_STATE,
    label_scope: str = "all",
) -> TrainingResult:
    """Label, split, fit on train, measure on validation and test; test rows are transformed once."""
    stored = materialize(users.select(key, *RAW_INPUTS), "users")
    split = materialize(label_and_split(stored, key, label_scope).withColumnRenamed(LABEL, TARGET), "split")
    parts = {name: split.where(F.col("split") == name) for name in ["train", "validation", "test"]}
    model = train(parts["train"], kind, n_estimators, max_depth, random_state)

    def scored(name: str) -> DataFrame:
        rows = model.score(parts[name]).select(F.col(TARGET).alias("y"), "predicted", "p1")
        return materialize(rows, f"scored-{name}")

    tested = scored("test")
    return TrainingResult(
        model,
        all_metrics(scored("validation")),
        evaluation_record(tested),
        approval(all_metrics(tested)),
        model_metadata(model, parts["train"], parts["validation"], TARGET, n_estimators, max_depth, random_state),
        split,
    )


def candidate(result: TrainingResult, model_id: str, path: str) -> DataFrame:
    """The trained model as a registry candidate."""
    metrics = result.evaluation.select(F.struct(*result.evaluation.columns).alias("metrics"))
    return result.approval.select(
        F.lit(model_id).alias("model_id"), F.lit(path).alias("path"), metrics.scalar().alias("metrics"), "approve_model"
    )


def publish(result: TrainingResult, model_id: str, zone: str, rejects: str | None = None) -> str:
    """Save the model and its documents, then pass the gate into ``zone/model_registry``."""
    path = f"{zone}/models/{model_id}"
    result.model.save(path)
    write_document(result.validation_metrics, f"{path}/metrics")
    write_document(result.metadata, f"{path}/metadata")
    write_document(result.evaluation, f"{path}/evaluation_metrics")
    write_document(result.approval, f"{path}/model_approval")
    gate_and_register(candidate(result, model_id, path), f"{zone}/model_registry", rejects)
    return path


def score_requests(requests: DataFrame, model: CohortModel, mode: str = "fail", capture_path: str | None = None) -> DataFrame:
    """Validate, score and assign a batch of requests, optionally capturing them.

    With ``fail`` the rules are counted by the job that scores and stores the rows: the requests are read once, and
    nothing is returned or captured if a row breaks a rule.
    """
    if mode == "fail":
        counted, check = observed(requests)
        assigned = materialize(assign_experiments(model.score(counted)), "assigned")
        check()
    else:
        checked = validate(requests, mode)
        if mode == "quarantine":
            checked = checked.where("is_valid").drop("is_valid")
        assigned = assign_experiments(model.score(checked))
        if capture_path is not None:
            assigned = materialize(assigned, "assigned")
    if capture_path is not None:
        write_capture(assigned, capture_path)
    return assigned
