"""User, review, request and metric rows derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.numeric import nan_to_null


# More than any order has lines.
LINES_PER_ORDER = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money_sum(column: str) -> Column:
    # Summed as decimal so that the order of addition cannot change the result.
    return F.sum(nan_to_null(F.col(column)).cast("decimal(18,2)")).cast("double")


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer, with activity from events and purchases from orders.

    Both fact tables are reduced to one row per user before the join. Edge cases (missing session
    counts, ages outside every bin, users without purchases) depend on the customer number.
    """
    key = F.col("c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("order_count"), _money_sum("o_totalprice").alias("order_total")
    )
    activity = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("event_count"),
        _money_sum("value").alias("event_total"),
        F.count_if(F.col("event_type") == "view").alias("view_count"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    bought = key % 17 != 0
    locations = F.array(*[F.lit(code) for code in ["US", "UK", "CA", "AU", "DE", "FR"]])
    return (
        customers.join(orders, "c_custkey", "left")
        .join(activity, "c_custkey", "left")
        .select(
            key,
            F.concat(F.lit("user_"), F.lpad(key.cast("string"), 6, "0")).alias("user_id"),
            F.when(key % 101 == 0, 0).when(key % 103 == 0, 120).otherwise((18 + key % 63).cast("int")).alias("age"),
            F.when(key % 25 < 12, "M").when(key % 25 < 24, "F").otherwise("Other").alias("gender"),
            F.get(locations, (F.col("c_nationkey") % 6).cast("int")).alias("location"),
            F.when(key % 31 != 0, F.coalesce("event_count", key % 23)).cast("bigint").alias("session_count"),
            F.coalesce(F.col("event_total"), 30.0 * (key % 37)).alias("avg_session_duration"),
            F.coalesce(F.col("view_count"), key % 41).cast("bigint").alias("page_views"),
            F.when(bought, F.coalesce("order_count", F.lit(0))).otherwise(0).cast("bigint").alias("purchase_history"),
            F.when(bought, F.coalesce("order_total", F.lit(0.0)) / 10000.0).otherwise(0.0).alias("total_spent"),
            ((key % 11) / 10.0).alias("historical_conversion_rate"),
        )
    )


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document; ``row_key`` is the file order. Includes missing and unparsable fields."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    key = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .join(labels, "doc_id", "left")
        .select(
            key.alias("row_key"),
            F.when(key % 101 == 0, "").when(key % 103 != 0, (key % 97).cast("string")).alias("customer_id"),
            F.when((key % 97 == 13) | (key % 7 == 0), "n/a").otherwise((1 + key % 5).cast("string")).alias("star_rating"),
            F.when(key % 19 == 0, "x").otherwise((key % 11).cast("string")).alias("helpful_votes"),
            (key % 17).cast("string").alias("total_votes"),
            F.when(key % 41 != 0, F.col("text")).alias("review_body"),
            F.when(F.col("quality") == 1, "Y").otherwise("N").alias("verified_purchase"),
        )
    )


def order_line_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order line: the bulk form. ``row_key``, the order and line number in one, is the file order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * LINES_PER_ORDER + F.col("l_linenumber")).alias("row_key"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        (1 + F.col("l_linenumber") % 5).cast("string").alias("star_rating"),
        (F.col("l_suppkey") % 11).cast("string").alias("helpful_votes"),
        (F.col("l_suppkey") % 17).cast("string").alias("total_votes"),
        F.concat("l_returnflag", "l_linestatus").alias("review_body"),
        F.when(F.col("l_returnflag") == "R", "N").otherwise("Y").alias("verified_purchase"),
    )


def metric_points(events: DataFrame) -> DataFrame:
    """One invocation per event: time, latency and error flag. Works on a table or a stream."""
    return events.select(
        "ts",
        F.lit("primary").alias("variant_name"),
        (nan_to_null(F.col("value")) * 100.0).alias("latency"),
        (F.col("event_type") == "error").cast("int").alias("err4xx"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment exposures from events: one row per user, experiment and variant.

    At most ten experiments with three variants each, so a user has at most thirty rows however many
    events there are.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    variant = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("event_id") % 3).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            (1 + k % 10).alias("number"),
            variant.alias("variant"),
            (F.col("event_type") == "purchase").alias("converted"),
        )
        .groupBy("user_id", "number", "variant")
        .agg(F.bool_or("converted").alias("converted"))
    )


def faulty_requests(users: DataFrame) -> DataFrame:
    """Scoring requests from users (with engagement), some with values outside the allowed ranges."""
    key = F.col("c_custkey")
    return users.select(
        "c_custkey",
        "user_id",
        F.when(key % 89 == 0, 121).when(key % 97 == 0, -1).otherwise(F.col("age")).alias("age"),
        F.when(key % 83 == 0, -5).otherwise(F.col("session_count")).alias("session_count"),
        F.when(key % 79 == 0, -0.5).otherwise(F.col("avg_session_duration")).alias("avg_session_duration"),
        "page_views",
        "purchase_history",
        F.when(key % 73 == 0, -1.0).otherwise(F.col("total_spent")).alias("total_spent"),
        F.when(key % 71 == 0, 1.5).otherwise(F.col("engagement_score")).alias("engagement_score"),
        F.when(key % 67 == 0, -0.1).otherwise(F.col("historical_conversion_rate")).alias("historical_conversion_rate"),
        F.when(key % 5 == 0, "female").when(key % 7 == 0, "unknown").otherwise(F.col("gender")).alias("gender"),
        F.when(key % 61 != 0, F.col("location")).alias("location"),
    )
