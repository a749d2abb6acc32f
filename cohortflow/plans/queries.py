"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortflow.functions import stamps
from cohortflow.functions.history import HISTORY_TYPE, conversion_rate, format_history, parse_history
from cohortflow.operators import evaluation, features, monitoring, profiles, validation
from cohortflow.operators import pipeline as ml_pipeline
from cohortflow.operators.assignment import as_json, assign_experiments, with_user_index
from cohortflow.operators.model import (
    LOGISTIC_REGRESSION,
    MAX_ITER,
    CohortModel,
    feature_importance,
    logistic_score,
    top_features,
    train,
)
from cohortflow.operators.model import model_metadata as describe_model
from cohortflow.operators.split import split_sizes, stratified_split
from cohortflow.plans import jobs
from cohortflow.schemas import CATEGORICAL_FEATURES, CORRUPT, FEATURES, LABEL, RAW_INPUTS, TARGET, USER
from cohortflow.session import materialize, scratch_path
from cohortflow.sources import capture, registry, requests, reviews, selector, snapshots, synthetic, tables, zones
from cohortflow.streaming import alarms
from cohortflow.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIXED_WEIGHTS, FIXED_INTERCEPT = {"engagement_score": 1.6, "total_spent": 1.2}, -2.0
# Alarm settings that fire on the test events, which are sparse.
TEST_ERROR_ALARM = monitoring.Alarm("high_error_rate", "errors", True, 4, 2, False)
CAPTURE_TEST_SHARE = 0.25
#: Features whose scaled values are added up per split.
SCALED_SUMS = ["age", "engagement_score", "gender_encoded"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(names: list[str], places: int = 6) -> list:
    return [F.round(F.col(n), places).alias(n) for n in names]


def _stamp_text(name: str):
    # Event times have no zone, so their text does not depend on the session's.
    return F.col(name).cast("timestamp_ntz").cast("string").alias(name)


def _engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored first: the fact tables are read once, all further passes read the user table.
    users = materialize(tables.user_rows(spark, sf_dir), "users")
    return features.with_engagement(users, features.engagement_bounds(users))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_high_value(_engaged(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(_labelled(spark, sf_dir), LABEL, "user_id")


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    moments = features.scaler_row(labelled, list(FIXED_WEIGHTS))
    return logistic_score(labelled, moments, FIXED_WEIGHTS, FIXED_INTERCEPT).withColumn("y", F.col(LABEL))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select("y", "predicted", "p1")


# Users, engagement, labels and features


@query
def user_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_rows(spark, sf_dir)


@query
def engagement_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engaged(spark, sf_dir).select("user_id", *_rounded(["engagement_score"]))


@query
def high_value_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return labelled.groupBy("location", LABEL).agg(
        F.count("*").alias("n_users"), F.round(F.avg("engagement_score"), 6).alias("avg_engagement")
    )


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_distribution(_labelled(spark, sf_dir))


@query
def value_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.derive(tables.user_rows(spark, sf_dir)).select("user_id", "age_group", "spending_tier")


@query
def derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.derive(tables.user_rows(spark, sf_dir)).select(
        "user_id", "spend_per_purchase", "session_efficiency"
    )


@query
def vocab_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fit_vocabulary(features.derive(tables.user_rows(spark, sf_dir))).table


@query
def encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _engaged(spark, sf_dir)
    vocabulary = features.fit_vocabulary(features.derive(users))
    encoded = features.encode(features.derive(tables.faulty_requests(users)), vocabulary)
    return encoded.select("user_id", *[f"{n}_encoded" for n in CATEGORICAL_FEATURES])


@query
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = features.derive(_engaged(spark, sf_dir))
    encoded = features.encode(derived, features.fit_vocabulary(derived))
    return features.fit_scaler(encoded).select("feature", *_rounded(["mean", "std"]))


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = materialize(_split(spark, sf_dir), "split")
    state = features.fit_features(split.where(F.col("split") == "train"))
    scaled = [F.round(F.col(f"features_scaled.{n}"), 6).alias(n) for n in FEATURES]
    return state.transform(split).select("user_id", "split", F.col(LABEL).alias(TARGET), *scaled)


# Reviews


@query
def review_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = profiles.usable(profiles.review_totals(tables.review_rows(spark, sf_dir)))
    return _totals_output(totals)


def _totals_output(totals: DataFrame) -> DataFrame:
    return totals.select(
        "customer_id",
        "review_count",
        "helpful_votes",
        "total_votes",
        "verified_purchases",
        *_rounded(["avg_rating", "avg_review_length", "verified_ratio"]),
    )


@query
def review_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.rejected(profiles.review_totals(tables.review_rows(spark, sf_dir)))


def _profile_output(users: DataFrame, *more: str) -> DataFrame:
    doubles = [
        "avg_session_duration",
        "total_spent",
        "engagement_score",
        "historical_conversion_rate",
        "avg_rating_given",
        "verified_purchase_ratio",
    ]
    return users.select(
        "user_id",
        "age",
        "gender",
        "location",
        "session_count",
        "page_views",
        "purchase_history",
        "previous_experiments",
        "review_count",
        "helpful_votes_received",
        *more,
        *_rounded(doubles),
    )


@query
def review_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_output(profiles.review_profiles(tables.review_rows(spark, sf_dir), noise=False))


@query
def review_users_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulk = tables.order_line_reviews(spark, sf_dir)
    return _profile_output(profiles.review_profiles(bulk, noise=True))


@query
def customers_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = profiles.first_seen_customers(tables.review_rows(spark, sf_dir), ["row_key"])
    return seen.select("customer_id", F.col("_first_seen").alias("row_key"))


@query
def customer_totals_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = profiles.review_totals(tables.order_line_reviews(spark, sf_dir), ["row_key"])
    return totals.select("customer_id", "review_count", F.col("_first_seen").alias("row_key"), *_rounded(["avg_rating"]))


@query
def review_profile_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals_output(profiles.usable(profiles.review_totals(tables.order_line_reviews(spark, sf_dir))))


@query
def top_up_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = profiles.review_profiles(tables.review_rows(spark, sf_dir), noise=False)
    return _profile_output(profiles.top_up(derived, lambda n: synthetic.synthetic_cohort(spark, n)))


# Experiment history


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # At most thirty exposures per user, so the array is bounded.
    entry = F.struct("number", "variant", "converted")
    ordered = tables.exposures(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    named = F.transform(
        "h",
        lambda e: F.struct(
            F.concat(F.lit("exp_"), e["number"].cast("string")).alias("experiment"),
            e["variant"].alias("variant"),
            e["converted"].alias("converted"),
        ),
    )
    return ordered.select("user_id", named.cast(HISTORY_TYPE).alias("history"))


@query
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histories(spark, sf_dir).select("user_id", format_history(F.col("history")).alias("previous_experiments"))


@query
def history_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_text(spark, sf_dir).select("user_id", F.inline(parse_history(F.col("previous_experiments"))))


@query
def history_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = conversion_rate(parse_history(F.col("previous_experiments")))
    return history_text(spark, sf_dir).select("user_id", F.round(rate, 6).alias("historical_conversion_rate"))


# Split


@query
def stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sizes(_split(spark, sf_dir), LABEL)


@query
def stratified_split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("user_id", LABEL, "split")


@query
def split_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = materialize(_split(spark, sf_dir), "split")
    state = features.fit_features(split.where(F.col("split") == "train"))
    path = scratch_path(spark, "zone")
    zones.write_splits(state.transform(split), path, LABEL)
    sets = None
    for name in zones.SPLITS:
        raw = zones.read_split(spark, path, name, "raw").drop(TARGET)
        scaled = zones.read_split(spark, path, name, "scaled")
        counted = raw.agg(F.count("*").alias("n_raw"), F.sum("page_views").alias("page_views"))
        # A sum over the training rows is 0 up to rounding: no negative zero.
        sums = [(F.round(F.sum(n), 4) + 0.0).alias(f"{n}_scaled") for n in SCALED_SUMS]
        labelled = materialize(scaled.agg(F.count("*").alias("n_scaled"), F.sum(TARGET).alias("n_high_value"), *sums), "scaled-sums")
        row = counted.select(
            F.lit(name).alias("split"),
            "n_raw",
            "page_views",
            labelled.select("n_scaled").scalar().alias("n_scaled"),
            labelled.select("n_high_value").scalar().alias("n_high_value"),
            *[labelled.select(f"{n}_scaled").scalar().alias(f"{n}_scaled") for n in SCALED_SUMS],
        )
        sets = row if sets is None else sets.unionByName(row)
    return sets


# Requests


@query
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(tables.faulty_requests(_engaged(spark, sf_dir)), "report")


@query
def request_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validation.validate(tables.faulty_requests(_engaged(spark, sf_dir)), "quarantine")
    return checked.select("user_id", F.col("is_valid").cast("int").alias("is_valid"))


@query
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.unknown_values(tables.faulty_requests(_engaged(spark, sf_dir)))


def _request_text(rows: DataFrame) -> DataFrame:
    text = F.to_json(F.struct("user_id", *RAW_INPUTS))
    # Some requests send a number as a word.
    text = F.when(F.col("c_custkey") % 53 == 0, F.regexp_replace(text, '"page_views":[0-9]+', '"page_views":"many"')).otherwise(text)
    return rows.select(text.alias("value"))


def _json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.faulty_requests(_engaged(spark, sf_dir))
    path = scratch_path(spark, "requests")
    _request_text(rows).write.text(path)
    parsed = requests.read_requests(spark, path)
    validation.require_columns(parsed)
    return parsed


@query
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.accepted(_json_requests(spark, sf_dir))
    return rows.select("user_id", "age", "session_count", "gender", *_rounded(["engagement_score"]))


@query
def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = requests.quarantined(_json_requests(spark, sf_dir))
    return kept.select(F.get_json_object(CORRUPT, "$.user_id").alias("user_id"))


# Scoring and assignment


@query
def fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select("user_id", "p1", "predicted", "y")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_experiments(_fixed(spark, sf_dir))


def _assigned_columns() -> list:
    return [
        F.col("predicted_bucket"),
        *_rounded(["confidence", "high_value_probability", "standard_probability"]),
        F.col("experiment_assignment.experiment_type").alias("experiment_type"),
        F.col("experiment_assignment.variant").alias("variant"),
        F.col("experiment_assignment.priority").alias("priority"),
        F.col("model_version"),
    ]


@query
def assign_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("user_id", *_assigned_columns())


@query
def assignment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, variant = F.col("experiment_assignment.experiment_type"), F.col("experiment_assignment.variant")
    return _assigned(spark, sf_dir).groupBy(kind.alias("experiment_type"), variant.alias("variant")).agg(
        F.count("*").alias("n_users")
    )


@query
def score_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = with_user_index(_assigned(spark, sf_dir), ["user_id"])
    parsed = as_json(indexed).select(F.from_json("value", indexed.schema).alias("r")).select("r.*")
    return parsed.select("user_index", *_assigned_columns())


@query
def capture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.capture_rows(_assigned(spark, sf_dir), CAPTURE_TEST_SHARE)
    return rows.select(
        "user_id",
        F.col("input.age").alias("age"),
        F.col("output.predicted_bucket").alias("predicted_bucket"),
        F.col("output.experiment_assignment.variant").alias("variant"),
    )


# Evaluation


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(evaluation.counts(_outcomes(spark, sf_dir)))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(evaluation.counts(_outcomes(spark, sf_dir))).select(*_rounded(evaluation.METRICS))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(_outcomes(spark, sf_dir)).select(*_rounded(["auc"]))


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation.classification_report(evaluation.counts(_outcomes(spark, sf_dir)))
    return report.select("class", *_rounded(["precision", "recall", "f1_score"]), "support")


@query
def business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = evaluation.business_metrics(evaluation.counts(_outcomes(spark, sf_dir)))
    shares = ["bucketing_efficiency", "coverage", "high_value_precision", "high_value_recall"]
    return numbers.select(*[c for c in numbers.columns if c not in shares], *_rounded(shares))


@query
def approval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = evaluation.approval(evaluation.all_metrics(_outcomes(spark, sf_dir)))
    path = scratch_path(spark, "approval")
    zones.write_document(record, path)
    flag = registry.read_approval(spark, path).select(F.col("approve_model").cast("int"))
    return record.select(
        flag.scalar().alias("approve_model"),
        *[F.col(f"approval_criteria.{n}_pass").cast("int").alias(f"{n}_pass") for n in evaluation.THRESHOLDS],
        "recommendation_reason",
    )


# Monitoring


@query
def metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = monitoring.window_statistics(tables.metric_points(tables.table(spark, sf_dir, "events")))
    return windows.select(_stamp_text("period_start"), "variant_name", *_rounded(["avg_latency"]), "errors", "invocations")


def _alarm(spark: SparkSession, sf_dir: str, alarm: monitoring.Alarm, period: str) -> DataFrame:
    points = tables.metric_points(tables.table(spark, sf_dir, "events"))
    windows = materialize(monitoring.window_statistics(points, period), "windows")
    states = monitoring.evaluate_alarm(windows, alarm, period)
    value = F.round(F.col("value").cast("double"), 6).alias("value")
    return states.select(_stamp_text("period_start"), "variant_name", value, "state")


@query
def alarm_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(spark, sf_dir, monitoring.HIGH_LATENCY, "1 hour")


@query
def alarm_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(spark, sf_dir, TEST_ERROR_ALARM, "1 hour")


@query
def alarm_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(spark, sf_dir, monitoring.HIGH_ERROR_RATE, "1 hour")


@query
def alarm_low_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(spark, sf_dir, monitoring.LOW_INVOCATION, "5 minutes")


@query
def event_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return tables.table(spark, sf_dir, "events").select(
        "event_id", stamps.compact_stamp(ts).alias("compact"), stamps.iso_text(ts).alias("iso")
    )


# Files


@query
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _engaged(spark, sf_dir).select("user_id", *RAW_INPUTS)
    zone = scratch_path(spark, "raw-zone")
    older = users.withColumn("age", F.lit(1))
    snapshots.write_raw(older, zone, "20240101_000000")
    snapshots.write_raw(users, zone, "20240102_000000")
    read = snapshots.latest_run(spark, zone, users.schema)
    return read.select("user_id", "age", "gender", "location", "session_count", *_rounded(["engagement_score", "total_spent"]))


@query
def raw_zone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = snapshots.write_raw(_engaged(spark, sf_dir).select("user_id", *RAW_INPUTS), scratch_path(spark, "raw-zone"), fmt="parquet")
    stored = spark.read.parquet(report["location"]).agg(F.count("*").alias("n_read"))
    return stored.select("n_read", F.lit(report["rows"]).cast("bigint").alias("n_reported"))


def _review_file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "reviews")
    reviews.write_reviews(tables.review_rows(spark, sf_dir), path)
    return path


@query
def review_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.read_reviews(spark, _review_file(spark, sf_dir))
    return _totals_output(profiles.usable(profiles.review_totals(rows)))


@query
def dataset_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _review_file(spark, sf_dir)
    return _profile_output(selector.load_users(spark, selector.REVIEWS, path, noise=False), "data_source")


@query
def synthetic_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    users = synthetic.synthetic_users(ids)
    doubles = ["avg_session_duration", "total_spent", "engagement_score", "historical_conversion_rate"]
    plain = [c for c in users.columns if c not in [*doubles, "created_at"]]
    return users.select(*plain, *_rounded(doubles))


# Models


def _training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_split(spark, sf_dir).withColumnRenamed(LABEL, TARGET), "split")


def _part(split: DataFrame, name: str) -> DataFrame:
    return split.where(F.col("split") == name)


def _score_checks() -> list:
    """Relations that hold for the answers of any classifier: 1 where a row keeps them."""
    p1, high = F.col("high_value_probability"), F.col("predicted_bucket") == "high_value"
    kind = (
        F.when((p1 > 0.5) & (p1 > 0.8), "premium_features")
        .when(p1 > 0.5, "engagement_boost")
        .when(p1 > 0.3, "conversion_optimization")
        .otherwise("basic_features")
    )
    checks = {
        "bucket_fits": high == (p1 > 0.5),
        "confidence_fits": F.abs(F.col("confidence") - F.greatest(p1, 1 - p1)) < 1e-9,
        "sum_is_one": F.abs(p1 + F.col("standard_probability") - 1) < 1e-9,
        "experiment_fits": F.col("experiment_assignment.experiment_type") == kind,
        "priority_fits": (F.col("experiment_assignment.priority") == "high") == (kind == "premium_features"),
    }
    return [found.cast("int").alias(name) for name, found in checks.items()]


def _model_scores(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    split = _training_sets(spark, sf_dir)
    model = train(_part(split, "train"), **options)
    return assign_experiments(model.score(split)).select("user_id", "split", TARGET, *_score_checks())


@query
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_scores(spark, sf_dir)


@query
def rf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forest says of itself, and whether it has learned: a model with one answer for all fails."""
    split = _training_sets(spark, sf_dir)
    training, held_out, tested = (_part(split, name) for name in ("train", "validation", "test"))
    model = train(training)
    outcomes = materialize(model.score(tested).select(F.col(TARGET).alias("y"), "predicted", "p1"), "outcomes")
    metrics = evaluation.all_metrics(outcomes)
    about = describe_model(model, training, held_out, n_estimators=0, max_depth=0, random_state=0)
    reached = [(F.col(name) >= floor).cast("int").alias(f"{name}_reached") for name, floor in (("accuracy", 0.75), ("auc", 0.8))]
    learned = metrics.select(*reached)
    return about.select(
        "model_type",
        F.col("hyperparameters.n_estimators").cast("int").alias("n_estimators"),
        F.col("hyperparameters.max_depth").cast("int").alias("max_depth"),
        F.col("hyperparameters.random_state").cast("int").alias("random_state"),
        F.array_join(F.col("target_classes").cast("array<string>"), ",").alias("classes"),
        F.array_join("feature_names", ",").alias("feature_names"),
        "training_samples",
        "validation_samples",
        F.size("feature_importance").alias("n_importances"),
        (F.abs(F.aggregate(F.map_values("feature_importance"), F.lit(0.0), lambda s, x: s + x) - 1) < 1e-6).cast("int").alias("importances_sum_to_one"),
        *[learned.select(c).scalar().alias(c) for c in learned.columns],
        outcomes.agg((F.count_distinct("p1") > 10).cast("int")).scalar().alias("tells_users_apart"),
        outcomes.agg(F.count("*")).scalar().alias("n_test"),
    )


@query
def saved_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by a pipeline that was saved and loaded, and whether it answers like the same model trained step by step."""
    split = _training_sets(spark, sf_dir)
    training = _part(split, "train")
    classifier = LogisticRegression(maxIter=MAX_ITER, regParam=1.0 / training.count(), elasticNetParam=0.0, standardization=False)
    path = scratch_path(spark, "pipeline")
    ml_pipeline.cohort_pipeline(classifier).fit(training).write().save(path)
    rows = ml_pipeline.answers(ml_pipeline.load_pipeline(spark, path), split).select("user_id", "split", TARGET, "predicted", "p1")
    apart = train(training, LOGISTIC_REGRESSION).score(split).select("user_id", F.col("p1").alias("other"))
    same = F.abs(F.col("p1") - F.col("other")) < 1e-5
    both = rows.join(apart, "user_id").groupBy("split", TARGET)
    return both.agg(F.count("*").alias("n_users"), F.count_if(same).alias("n_same"), (F.count_if((F.col("p1") > 0.5) != (F.col("predicted") == 1))).alias("n_odd"))


@query
def stream_answer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables that a stream of faulty requests is answered into."""
    users = _engaged(spark, sf_dir)
    moments = materialize(features.scaler_row(users, list(FIXED_WEIGHTS)), "moments")
    zone = scratch_path(spark, "answer-tables")
    _request_text(tables.faulty_requests(users)).write.text(f"{zone}/in")
    score = lambda rows: logistic_score(rows, moments, FIXED_WEIGHTS, FIXED_INTERCEPT)
    _finish(streams.answer_tables(requests.stream_requests(spark, f"{zone}/in"), score, f"{zone}/out", f"{zone}/checkpoint"))
    read = lambda name: spark.read.parquet(f"{zone}/out/{name}")
    scored = read("scored").select(F.lit("scored").alias("kind"), "user_id", F.round("confidence", 6).alias("confidence"))
    name = F.coalesce("user_id", F.get_json_object("text", "$.user_id"))
    refused = read("refused").select(F.lit("refused").alias("kind"), name.alias("user_id"), F.lit(None).cast("double").alias("confidence"))
    captured = read("captured").select(F.lit("captured").alias("kind"), name.alias("user_id"), F.lit(None).cast("double").alias("confidence"))
    return scored.unionByName(refused).unionByName(captured)


@query
def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_scores(spark, sf_dir, kind=LOGISTIC_REGRESSION)


@query
def lr_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of the penalised mean loss on the training rows: 0 where the fit has converged."""
    rows = _part(_training_sets(spark, sf_dir), "train")
    model = train(rows, LOGISTIC_REGRESSION)
    scaled = model.features.transform(model.score(rows).select(*RAW_INPUTS, TARGET, "p1"))
    miss = F.col("p1") - F.col(TARGET)
    weights = dict(zip(FEATURES, model.classifier.coefficients.toArray().tolist()))
    slopes = [(F.avg(miss * F.col(f"features_scaled.{n}")) + w / F.count("*")).alias(n) for n, w in weights.items()]
    found = scaled.agg(*slopes, F.avg(miss).alias("intercept"))
    pairs = [F.struct(F.lit(n).alias("feature"), F.round(F.abs(n), 3).alias("gradient")) for n in found.columns]
    return found.select(F.inline(F.array(*pairs)))


@query
def rf_importance_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(_part(_training_sets(spark, sf_dir), "train"))
    importance = materialize(feature_importance(model), "importance")
    total = importance.agg((F.abs(F.sum("importance") - 1) < 1e-6).cast("int")).scalar()
    order = Window.orderBy(F.desc("importance"), "feature")
    top = top_features(importance).withColumn("rank", F.row_number().over(order))
    falls = F.coalesce(F.lag("importance").over(order) >= F.col("importance"), F.lit(True))
    return top.select("rank", F.col("feature").isin(FEATURES).cast("int").alias("is_feature"), falls.cast("int").alias("falls"), total.alias("sum_is_one"))


@query
def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows and true classes of the evaluation of a trained model, and whether it ranks them well."""
    result = jobs.train_and_evaluate(_engaged(spark, sf_dir), LOGISTIC_REGRESSION)
    record = result.evaluation.select(
        F.col("business_metrics.total_test_users").alias("n_test"),
        F.col("business_metrics.actual_high_value_users").alias("n_high_value"),
        (F.col("test_auc") >= 0.8).cast("int").alias("ranks_well"),
    )
    return record


@query
def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _training_sets(spark, sf_dir)
    training, held_out = _part(split, "train"), _part(split, "validation")
    path = scratch_path(spark, "model")
    train(training, LOGISTIC_REGRESSION).save(path)
    return describe_model(CohortModel.load(spark, path), training, held_out).select(
        "model_type",
        "training_samples",
        "validation_samples",
        F.size("feature_names").alias("n_features"),
        F.size("target_classes").alias("n_classes"),
        F.col("hyperparameters.random_state").alias("random_state"),
    )


@query
def registry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and the same one reversed, gated into registry and rejects."""
    outcomes = materialize(_outcomes(spark, sf_dir), "outcomes")
    turned = F.round(1 - F.col("p1"), 4)
    reverse = outcomes.select("y", (turned > 0.5).cast("int").alias("predicted"), turned.alias("p1"))
    zone = scratch_path(spark, "models")
    for name, rows in [("fixed", outcomes), ("reversed", reverse)]:
        record = evaluation.approval(evaluation.all_metrics(rows))
        metrics = F.struct(F.lit(name).alias("name"))
        row = record.select(F.lit(name).alias("model_id"), F.lit(zone).alias("path"), metrics.alias("metrics"), "approve_model")
        registry.gate_and_register(materialize(row, "candidate"), f"{zone}/registry", f"{zone}/rejected")
        # Registered again by a repeated job: still one row each.
        registry.gate_and_register(materialize(row, "candidate"), f"{zone}/registry", f"{zone}/rejected")
    registered = registry.read_rows(spark, f"{zone}/registry", "model_id string, status string")
    refused = registry.read_rows(spark, f"{zone}/rejected", "model_id string, reason string").withColumnRenamed("reason", "status")
    return registered.unionByName(refused)


# Streams


def _finish(query_) -> None:
    query_.awaitTermination()


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _engaged(spark, sf_dir).select("user_id", *RAW_INPUTS)
    zone = scratch_path(spark, "drop")
    users.write.option("header", True).csv(f"{zone}/in")
    _finish(streams.ingest(streams.drop_folder(spark, f"{zone}/in", users.schema), f"{zone}/out", f"{zone}/checkpoint"))
    doubles = [n for n in RAW_INPUTS if n in USER.fieldNames() and USER[n].dataType == DoubleType()]
    plain = [n for n in RAW_INPUTS if n not in doubles]
    return spark.read.parquet(f"{zone}/out").select("user_id", *plain, *_rounded(doubles), CORRUPT)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faulty requests, answered by a stream with the fixed score."""
    users = _engaged(spark, sf_dir)
    moments = materialize(features.scaler_row(users, list(FIXED_WEIGHTS)), "moments")
    zone = scratch_path(spark, "scoring")
    _request_text(tables.faulty_requests(users)).write.text(f"{zone}/in")
    score = lambda rows: logistic_score(rows, moments, FIXED_WEIGHTS, FIXED_INTERCEPT)
    _finish(streams.answer(requests.stream_requests(spark, f"{zone}/in"), score, f"{zone}/out", f"{zone}/checkpoint"))
    return spark.read.parquet(f"{zone}/out")


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.scored_rows(_answered(spark, sf_dir)).select("user_id", *_assigned_columns())


@query
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every request is in exactly one of the two.
    return _answered(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_requests"))


@query
def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = streams.captured_rows(_answered(spark, sf_dir))
    name = F.coalesce("user_id", F.get_json_object("text", "$.user_id"))
    return captured.select(
        name.alias("user_id"),
        "status",
        *[F.when(F.col("text").isNull(), F.col(f"input.{n}")).alias(n) for n in ["location", "page_views"]],
        F.col("output.predicted_bucket").alias("predicted_bucket"),
        F.round("output.confidence", 6).alias("confidence"),
        F.col("output.experiment_assignment.variant").alias("variant"),
    )


def _streamed_windows(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """The windows that a drained stream has closed, and those that were still open."""
    zone = scratch_path(spark, "windows")
    points = tables.metric_points(streams.event_stream(spark, sf_dir, "events.parquet"))
    run = streams.metric_windows(points, f"{zone}/out", f"{zone}/checkpoint", period)
    _finish(run)
    events = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rest = streams.open_windows(tables.metric_points(events), streams.watermark(run), period)
    return materialize(spark.read.parquet(f"{zone}/out").unionByName(rest), "windows")


@query
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _streamed_windows(spark, sf_dir, "1 hour")
    return windows.select(_stamp_text("period_start"), "variant_name", *_rounded(["avg_latency"]), "errors", "invocations")


@query
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _streamed_windows(spark, sf_dir, "5 minutes")
    states = monitoring.evaluate_alarm(windows, monitoring.LOW_INVOCATION, "5 minutes")
    return states.select(_stamp_text("period_start"), "variant_name", F.col("value").cast("double").alias("value"), "state")


#: Heartbeats after the hour of the last event, and the period they tick in.
SILENT_HOURS, BEAT_PERIOD = 6, "5 minutes"


def _alarm_log(spark: SparkSession, sf_dir: str, alarm: monitoring.Alarm) -> DataFrame:
    """States that a stream over the events keeps in two runs, with heartbeats up to some hours after the last event."""
    zone = scratch_path(spark, "alarm-log")
    events = tables.table(spark, sf_dir, "events")
    first, middle, last = events.agg(
        F.date_trunc("hour", F.min("ts")), F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2), F.date_trunc("hour", F.max("ts"))
    ).first()
    hours = F.sequence(F.lit(first), F.lit(last) + F.expr(f"INTERVAL {SILENT_HOURS} HOURS"), F.expr(f"INTERVAL {BEAT_PERIOD}"))
    beats = spark.range(1).select(F.explode(hours).alias("ts"))
    log = alarms.AlarmLog(f"{zone}/log", alarm, BEAT_PERIOD)
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        stamped.where(part).write.mode("append").parquet(f"{zone}/events")
        beats.where(part).write.mode("append").parquet(f"{zone}/beats")
        points = tables.metric_points(streams.event_stream(spark, f"{zone}/events"))
        clock = spark.readStream.schema(beats.schema).parquet(f"{zone}/beats")
        _finish(alarms.watch(log, alarms.with_heartbeat(points, clock), f"{zone}/checkpoint"))
    return log.states(spark).select(_stamp_text("period_start"), "variant_name", F.col("value").cast("double").alias("value"), "state")


@query
def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-traffic states, with the silence after the last event."""
    return _alarm_log(spark, sf_dir, monitoring.LOW_INVOCATION)


@query
def stream_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error states of the same stream."""
    return _alarm_log(spark, sf_dir, monitoring.Alarm("errors", "errors", True, 0, 2, False))
