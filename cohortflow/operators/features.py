"""Feature engineering fitted on one set of rows and applied to any other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.behaviour import age_group, raw_engagement, session_efficiency, spend_per_purchase, spending_tier
from cohortflow.functions.numeric import min_max
from cohortflow.operators.lookup import ENTRIES, CategoryIndex, fit_index
from cohortflow.operators.ordering import exact_quantiles
from cohortflow.schemas import CATEGORICAL_FEATURES, DERIVED_RATIOS, FEATURES, LABEL, NUMERIC_INPUTS
from cohortflow.session import local_table

# Quantiles above which a user counts as high value.
ENGAGEMENT_QUANTILE, SPEND_QUANTILE = 0.7, 0.6

SCALER = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())]
)


def engagement_bounds(users: DataFrame) -> tuple[float, float]:
    """Least and greatest raw engagement."""
    low, high = users.select(raw_engagement().alias("_raw")).agg(F.min("_raw"), F.max("_raw")).first()
    return low, high


def with_engagement(users: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Add ``engagement_score``: raw engagement min-max scaled over all users.

    Without ``bounds`` the extremes are a scalar subquery of the same plan, which computes ``users``
    a second time; users that are costly to compute should be stored first. A stream must pass the
    bounds of a fitted batch, since a micro-batch has extremes of its own.
    """
    raw = users.withColumn("_raw", raw_engagement())
    if bounds is None:
        extremes = raw.agg(F.struct(F.min("_raw").alias("low"), F.max("_raw").alias("high")).alias("e")).scalar()
        raw = raw.withColumn("_extremes", extremes)
        scaled = min_max(F.col("_raw"), F.col("_extremes.low"), F.col("_extremes.high"))
    else:
        scaled = min_max(F.col("_raw"), F.lit(bounds[0]), F.lit(bounds[1]))
    return raw.withColumn("engagement_score", scaled).drop("_raw", "_extremes")


@dataclass(frozen=True)
class LabelRule:
    """Fitted thresholds of the high-value label."""

    engagement: float | None
    spend: float | None

    def label(self) -> Column:
        if self.engagement is None or self.spend is None:
            return F.lit(0)
        above = (F.col("engagement_score") > self.engagement) & (F.col("total_spent") > self.spend)
        return F.coalesce(above, F.lit(False)).cast("int")


def fit_label_rule(users: DataFrame) -> LabelRule:
    """Exact quantiles of engagement and spend, searched in the same passes; pass a stored table."""
    return LabelRule(*exact_quantiles(users, [("engagement_score", ENGAGEMENT_QUANTILE), ("total_spent", SPEND_QUANTILE)]))


def label_high_value(users: DataFrame, rule: LabelRule | None = None) -> DataFrame:
    return users.withColumn(LABEL, (rule or fit_label_rule(users)).label())


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n_users"))


def derive(users: DataFrame) -> DataFrame:
    """The two ratios and the two binned columns."""
    return users.withColumns(
        {
            "spend_per_purchase": spend_per_purchase(),
            "session_efficiency": session_efficiency(),
            "age_group": age_group(),
            "spending_tier": spending_tier(),
        }
    )


def fit_vocabulary(derived: DataFrame, names: list[str] | None = None, **sizes: int) -> CategoryIndex:
    """The distinct values of each feature, numbered in ascending order; ``sizes`` as in ``fit_index``."""
    return fit_index(derived, names or CATEGORICAL_FEATURES, **sizes)


def encode(derived: DataFrame, vocabulary: CategoryIndex, names: list[str] | None = None) -> DataFrame:
    """Add ``<name>_encoded``; a value that was not fitted gets index 0, the alphabetically first class."""
    return vocabulary.encode(derived, names or CATEGORICAL_FEATURES)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def scaler_row(encoded: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row with ``<name>_mean`` and ``<name>_std`` (population, 0 replaced by 1); missing counts as 0."""
    names = names or FEATURES
    moments = [F.avg(_filled(n)).alias(f"{n}_mean") for n in names]
    moments += [F.stddev_pop(_filled(n)).alias(f"{n}_raw_std") for n in names]
    return encoded.agg(*moments).select(
        *[f"{n}_mean" for n in names],
        *[F.when(F.col(f"{n}_raw_std") == 0, 1.0).otherwise(F.col(f"{n}_raw_std")).alias(f"{n}_std") for n in names],
    )


def fit_scaler(encoded: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(feature, mean, std), one row per feature."""
    names = names or FEATURES
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n in names]
    return scaler_row(encoded, names).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class FeatureState:
    """What a fit learned: category indices and scaler moments."""

    vocabulary: CategoryIndex
    scaler: dict[str, tuple[float, float]]

    def engineered(self, rows: DataFrame) -> DataFrame:
        """Input rows with ratios, bins and category indices, unscaled."""
        return encode(derive(rows), self.vocabulary)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Input rows plus the fourteen features, scaled, as a struct ``features_scaled``."""
        scaled = [
            ((_filled(n) - F.lit(self.scaler[n][0])) / F.lit(self.scaler[n][1])).alias(n) for n in FEATURES
        ]
        derived_names = DERIVED_RATIOS + CATEGORICAL_FEATURES[2:] + [f"{n}_encoded" for n in CATEGORICAL_FEATURES]
        return self.engineered(rows).withColumn("features_scaled", F.struct(*scaled)).drop(*derived_names)

    def save(self, path: str) -> None:
        spark = self.vocabulary.entries.sparkSession
        self.vocabulary.entries.write.mode("overwrite").parquet(f"{path}/vocabulary")
        rows = [(name, mean, std) for name, (mean, std) in self.scaler.items()]
        local_table(spark, rows, SCALER).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureState:
        scaler = spark.read.schema(SCALER).parquet(f"{path}/scaler").collect()
        return FeatureState(
            CategoryIndex.of(spark.read.schema(ENTRIES).parquet(f"{path}/vocabulary")),
            {row["feature"]: (row["mean"], row["std"]) for row in scaler},
        )


def fit_features(rows: DataFrame) -> FeatureState:
    """Learn category indices, then the scaler on the encoded rows."""
    derived = derive(rows.select(*NUMERIC_INPUTS, "gender", "location"))
    vocabulary = fit_vocabulary(derived)
    scaler = fit_scaler(encode(derived, vocabulary)).collect()
    return FeatureState(vocabulary, {row["feature"]: (row["mean"], row["std"]) for row in scaler})
