from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import features, lookup
from cohortflow.schemas import CATEGORICAL_FEATURES, FEATURES, LABEL
from cohortflow.sources import tables


@pytest.fixture(scope="module")
def users(spark, sf_dir):
    return features.with_engagement(tables.user_rows(spark, sf_dir)).cache()


def brute_force(train: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """The fourteen scaled features, computed row-wise in pandas."""

    def engineer(frame):
        frame = frame.copy()
        bought = frame["purchase_history"] > 0
        frame["spend_per_purchase"] = np.where(bought, frame["total_spent"] / frame["purchase_history"].where(bought, 1), 0)
        frame["session_efficiency"] = frame["page_views"] / np.maximum(frame["session_count"], 1)
        frame["age_group"] = pd.cut(frame["age"], [0, 25, 35, 50, 100], labels=["young", "adult", "middle_aged", "senior"])
        frame["spending_tier"] = pd.cut(frame["total_spent"], [-1, 0, 50, 200, np.inf], labels=["none", "low", "medium", "high"])
        for name in CATEGORICAL_FEATURES:
            frame[name] = frame[name].astype(object).where(frame[name].notna(), "nan").astype(str)
        return frame

    fitted, wanted = engineer(train), engineer(rows)
    for name in CATEGORICAL_FEATURES:
        classes = sorted(set(fitted[name]))
        for frame in [fitted, wanted]:
            frame[f"{name}_encoded"] = [classes.index(v) if v in classes else 0 for v in frame[name]]
    base = fitted[FEATURES].astype(float).fillna(0).to_numpy()
    std = base.std(axis=0)
    std[std == 0] = 1
    return (wanted[FEATURES].astype(float).fillna(0).to_numpy() - base.mean(axis=0)) / std


def test_transform_equals_brute_force(spark, users):
    train = users.where(F.col("location") != "FR")  # FR is unseen
    state = features.fit_features(train)
    scaled = state.transform(users).select("user_id", *[F.col(f"features_scaled.{n}").alias(f"s_{n}") for n in FEATURES])
    found = scaled.toPandas().sort_values("user_id").drop(columns="user_id").to_numpy()
    expected = brute_force(train.toPandas(), users.toPandas().sort_values("user_id"))
    assert np.allclose(found, expected)


def test_state_survives_saving(spark, users, tmp_path):
    state = features.fit_features(users)
    state.save(str(tmp_path / "state"))
    loaded = features.FeatureState.load(spark, str(tmp_path / "state"))
    assert loaded.scaler == state.scaler
    assert sorted(loaded.vocabulary.table.collect()) == sorted(state.vocabulary.table.collect())
    assert loaded.vocabulary.literal == state.vocabulary.literal


# Literal, sent to the rows, joined with and without frequent values.
SIZES = [{}, {"literal_values": 0}, {"literal_values": 0, "broadcast_rows": 0}, {"literal_values": 2, "broadcast_rows": 4}]


@pytest.mark.parametrize("sizes", SIZES)
def test_every_way_of_lookup_gives_the_same(spark, users, sizes, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_VALUES", 2)
    derived = features.derive(users).withColumns({"gender": F.when(F.col("c_custkey") % 9 != 0, F.col("gender")), "m": F.create_map(F.lit("a"), F.lit(1))})
    fitted = features.fit_vocabulary(derived.where("location <> 'FR'"), **sizes)
    values = {}
    for feature, value, idx in fitted.table.collect():
        values.setdefault(feature, {})[value] = idx
    assert all(sorted(v, key=v.get) == sorted(v) and sorted(v.values()) == list(range(len(v))) for v in values.values())
    encoded = features.encode(derived, fitted)
    assert encoded.count() == derived.count()
    for row in encoded.collect():
        for name in CATEGORICAL_FEATURES:
            assert row[f"{name}_encoded"] == values[name].get("nan" if row[name] is None else row[name], 0)


def wide_rows(spark):
    """A feature of 5,000 values, one of which, and one that was not fitted, hold a third of the rows each, next to gender."""
    rows = spark.range(30_000).withColumn("gender", F.when(F.col("id") % 2 == 0, "F").otherwise("M"))
    value = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "new").otherwise(F.concat(F.lit("v"), (F.col("id") % 5000).cast("string")))
    return rows.withColumn("page", value)


def test_a_wide_feature_leaves_others_alone(spark):
    rows = wide_rows(spark)
    index = features.fit_vocabulary(rows.where("page <> 'new'"), ["gender", "page"], broadcast_rows=1000)
    assert index.sizes["page"] > 1000 and index.literal["gender"] == ["F", "M"] and "hot" in dict(index.sent["page"])
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    gender, both = features.encode(rows, index, ["gender"]), features.encode(rows, index, ["gender", "page"])
    # Applying the index runs no job, and gender needs neither a shuffle nor a join.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    plan = gender._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    former = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        positions = {v: i for i, v in enumerate(sorted({r["page"] for r in rows.collect()} - {"new"}))}
        assert all(r["page_encoded"] == positions.get(r["page"], 0) for r in both.collect())
        # Neither the frequent value nor the one that was not fitted, 10,000 rows each, meets in one task.
        dealt = index._joined(rows.withColumns({"_value": F.col("page"), "_idx": F.when(F.col("page") == "hot", 0).cast("bigint")}), "page")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 8_000
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)


def test_index_on_a_stream(spark, tmp_path):
    rows = wide_rows(spark)
    index = features.fit_vocabulary(rows.where("page <> 'new'"), ["gender", "page"], broadcast_rows=1000)
    rows.write.parquet(str(tmp_path / "in"))
    stream = features.encode(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), index, ["gender", "page"])
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query.start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("id", "gender_encoded", "page_encoded")
    want = features.encode(rows, index, ["gender", "page"]).select("id", "gender_encoded", "page_encoded")
    assert found.exceptAll(want).count() == 0 and found.count() == 30_000


def test_zero_deviation_becomes_one(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, 2.0)], "a double, b double")
    rows = {r["feature"]: (r["mean"], r["std"]) for r in features.fit_scaler(df, ["a", "b"]).collect()}
    assert rows == {"a": (3.0, 1.0), "b": (1.0, 1.0)}


def test_label_is_strict_and_missing_is_low(spark):
    rule = features.LabelRule(0.5, 100.0)
    df = spark.createDataFrame(
        [(0.5, 200.0), (0.6, 100.0), (0.6, 100.1), (None, 500.0)], "engagement_score double, total_spent double"
    )
    assert [r[0] for r in df.select(rule.label()).collect()] == [0, 0, 1, 0]


def test_label_matches_pandas(spark, users):
    frame = users.toPandas()
    expected = (frame.engagement_score > frame.engagement_score.quantile(0.7)) & (
        frame.total_spent > frame.total_spent.quantile(0.6)
    )
    labelled = features.label_high_value(users).toPandas().set_index("user_id")[LABEL]
    assert labelled.to_dict() == dict(zip(frame.user_id, expected.astype(int)))


def test_given_bounds_replace_the_extremes(spark, users):
    fixed = features.with_engagement(users.drop("engagement_score"), (0.0, 10.0))
    plain = users.select("user_id", "engagement_score")
    joined = fixed.select("user_id", F.col("engagement_score").alias("fixed")).join(plain, "user_id").toPandas().dropna()
    assert np.corrcoef(joined["fixed"], joined["engagement_score"])[0, 1] == pytest.approx(1.0)
    assert joined["fixed"].max() < 1.0
