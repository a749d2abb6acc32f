"""Exact stratified split into train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.draws import hash60
from cohortflow.session import lookup_side

# Share of all rows for test, share of the remainder for validation, seed.
TEST_SHARE, VALIDATION_SHARE, SEED = 0.2, 0.25, 42

HASH_BITS, BUCKET_BITS = 60, 16


def _shares(strata: DataFrame, size: str, total: str, quota: str) -> DataFrame:
    """Divide ``total`` rows over the strata in proportion to ``size`` by largest remainder.

    Products are decimals, which hold those of two row counts, and remainders are whole numbers.
    """
    everyone = Window.partitionBy()
    wide = "decimal(19,0)"
    product = F.col(size).cast(wide) * F.col(total).cast(wide)
    whole = F.sum(size).over(everyone).cast(wide)
    parts = strata.select("*", product.alias("_product"), whole.alias("_whole")).select(
        *strata.columns,
        F.coalesce(F.expr("_product div nullif(_whole, 0)"), F.lit(0)).alias("_floor"),
        F.coalesce(F.expr("_product % nullif(_whole, 0)"), F.lit(0)).alias("_remainder"),
    )
    by_remainder = Window.orderBy(F.col("_remainder").desc(), "_label")
    extra = F.row_number().over(by_remainder) <= F.col(total) - F.sum("_floor").over(everyone)
    return parts.select(*strata.columns, (F.col("_floor") + extra.cast("int")).cast("bigint").alias(quota))


def quotas(label_counts: DataFrame, test_share: float = TEST_SHARE, validation_share: float = VALIDATION_SHARE) -> DataFrame:
    """(label, n, test rows, validation rows) per label from (label, n); one row per label throughout."""
    everyone = Window.partitionBy()

    def part(size: Column, share: float) -> Column:
        return F.ceil(F.round(F.sum(size).over(everyone) * share, 9)).cast("bigint")

    sized = label_counts.select("_label", "n", part(F.col("n"), test_share).alias("_total"))
    rest = F.col("n") - F.col("n_test")
    tested = _shares(sized, "n", "_total", "n_test").select(
        "_label", "n", "n_test", rest.alias("_rest"), part(rest, validation_share).alias("_total")
    )
    return _shares(tested, "_rest", "_total", "n_validation").select("_label", "n", "n_test", "n_validation")


def _cuts(keyed: DataFrame, test_share: float, validation_share: float) -> DataFrame:
    """Per label, the last (hash, tie) of the test rows and of the validation rows.

    Bucket counts locate the bucket that holds each cut; only rows of those buckets are ranked.
    """
    counts = keyed.groupBy("_label", "_bucket").agg(F.count("*").alias("n"))
    labels = quotas(counts.groupBy("_label").agg(F.sum("n").alias("n")), test_share, validation_share)
    in_label = Window.partitionBy("_label").orderBy("_bucket")
    reached = counts.withColumn("_upto", F.sum("n").over(in_label)).withColumn("_before", F.col("_upto") - F.col("n"))
    positions = labels.select(
        F.col("_label").alias("_edge_label"),
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("position")),
                F.struct(F.lit("validation").alias("cut"), (F.col("n_test") + F.col("n_validation")).alias("position")),
            )
        ),
    )
    edges = (
        reached.join(positions, F.col("_label").eqNullSafe(F.col("_edge_label")))
        .where((F.col("_before") < F.col("position")) & (F.col("position") <= F.col("_upto")))
        .select("_edge_label", F.col("_bucket").alias("_edge_bucket"), "cut", "position", "_before")
    )
    in_edge = Window.partitionBy("_label", "cut").orderBy("_hash", "_tie")
    near = keyed.join(
        lookup_side(edges),
        F.col("_label").eqNullSafe(F.col("_edge_label")) & (F.col("_bucket") == F.col("_edge_bucket")),
    )
    last = (
        near.withColumn("_place", F.row_number().over(in_edge) + F.col("_before"))
        .where(F.col("_place") == F.col("position"))
        .select("_label", "cut", F.struct("_hash", "_tie").alias("at"))
    )
    return last.groupBy("_label").agg(
        F.max(F.when(F.col("cut") == "test", F.col("at"))).alias("_test_end"),
        F.max(F.when(F.col("cut") == "validation", F.col("at"))).alias("_validation_end"),
    )


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` (train, validation, test); sizes are exact for the whole table and per label.

    Rows of a label are taken in the order of a hash of ``key``; rows without a key, or with the same
    one, in that of a hash of all their columns, so only rows that are equal throughout share a place.
    Whether a row is in a split depends only on its own hash and the label's two cut points, so no row
    is ranked against its whole label.
    """
    tie = F.xxhash64(*df.columns)
    hashed: Column = F.coalesce(hash60(F.col(key), seed), hash60(tie.cast("string"), seed))
    keyed = df.withColumns({"_label": F.col(label), "_tie": tie, "_hash": hashed}).withColumn(
        "_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS)
    )
    cuts = _cuts(keyed.select("_label", "_tie", "_hash", "_bucket"), test_share, validation_share)
    cuts = cuts.withColumnRenamed("_label", "_cut_label")
    at = F.struct("_hash", "_tie")
    split = (
        F.when(at <= F.col("_test_end"), "test").when(at <= F.col("_validation_end"), "validation").otherwise("train")
    )
    return (
        keyed.join(lookup_side(cuts), F.col("_label").eqNullSafe(F.col("_cut_label")), "left")
        .withColumn("split", split)
        .drop("_label", "_tie", "_hash", "_bucket", "_cut_label", "_test_end", "_validation_end")
    )


def split_sizes(split: DataFrame, label: str) -> DataFrame:
    return split.groupBy("split", label).agg(F.count("*").alias("n_users"))
