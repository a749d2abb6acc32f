"""Evaluation of binary predictions: counts, metrics, AUC, reports and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.numeric import safe_ratio
from cohortflow.operators.ordering import running_totals

# Quality floors of the approval, compared with >=.
THRESHOLDS = {"accuracy": 0.75, "precision": 0.70, "recall": 0.65, "auc": 0.80}
REASON_PASS, REASON_FAIL = "All criteria met", "Some criteria not met"

METRICS = ["accuracy", "precision", "recall", "f1_score"]


def counts(scored: DataFrame, label: str = "y", prediction: str = "predicted") -> DataFrame:
    """One row (tn, fp, fn, tp); every other count-based metric follows from it."""
    y, p = F.col(label), F.col(prediction)
    return scored.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """Four rows (actual, predicted, n), including empty cells."""
    grid = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )
    return cells.select(F.inline(grid))


def _f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2.0 * precision * recall, precision + recall)


def binary_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ["tn", "fp", "fn", "tp"])
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return cells.select(
        safe_ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1_score"),
    )


def roc_auc(scored: DataFrame, label: str = "y", score: str = "p1") -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a class is missing.

    Rows are first reduced to one per distinct score, so a score shared by many rows is one row.
    """
    by_score = scored.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(by_score, [score], {"neg_before": F.col("neg")})
    # Pairs won, doubled to stay integral; exact as decimal.
    pos, neg, before = (F.col(c).cast("decimal(18,0)") for c in ["pos", "neg", "neg_before"])
    won = F.sum(pos * (2 * before + neg)).cast("double")
    pairs = F.sum(F.col("pos")).cast("double") * F.sum(F.col("neg")).cast("double")
    return ranked.agg(F.try_divide(won, 2.0 * pairs).alias("auc"))


def classification_report(cells: DataFrame) -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg with precision, recall, f1_score and support."""
    tn, fp, fn, tp = (F.col(c) for c in ["tn", "fp", "fn", "tp"])
    per_class = cells.select(
        safe_ratio(tn, tn + fn).alias("p0"),
        safe_ratio(tn, tn + fp).alias("r0"),
        (tn + fp).alias("s0"),
        safe_ratio(tp, tp + fp).alias("p1"),
        safe_ratio(tp, tp + fn).alias("r1"),
        (fn + tp).alias("s1"),
        safe_ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
    ).withColumns({"f0": _f1(F.col("p0"), F.col("r0")), "f1": _f1(F.col("p1"), F.col("r1"))})
    s0, s1 = F.col("s0"), F.col("s1")
    support = s0 + s1

    def line(name: str, precision: Column, recall: Column, f1: Column, rows: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            rows.alias("support"),
        )

    def macro(name: str) -> Column:
        return (F.col(f"{name}0") + F.col(f"{name}1")) / 2.0

    def weighted(name: str) -> Column:
        return safe_ratio(F.col(f"{name}0") * s0 + F.col(f"{name}1") * s1, support)

    accuracy = F.col("accuracy")
    return per_class.select(
        F.inline(
            F.array(
                line("0", F.col("p0"), F.col("r0"), F.col("f0"), s0),
                line("1", F.col("p1"), F.col("r1"), F.col("f1"), s1),
                line("accuracy", accuracy, accuracy, accuracy, support),
                line("macro avg", macro("p"), macro("r"), macro("f"), support),
                line("weighted avg", weighted("p"), weighted("r"), weighted("f"), support),
            )
        )
    )


def business_metrics(cells: DataFrame) -> DataFrame:
    """Totals of high-value users found, and the shares built on them."""
    tn, fp, fn, tp = (F.col(c) for c in ["tn", "fp", "fn", "tp"])

    def share(total: Column) -> Column:
        return tp.cast("double") / F.greatest(total, F.lit(1)).cast("double")

    return cells.select(
        (tn + fp + fn + tp).alias("total_test_users"),
        (tp + fn).alias("actual_high_value_users"),
        (tp + fp).alias("predicted_high_value_users"),
        tp.alias("correctly_identified_high_value"),
        share(tp + fp).alias("bucketing_efficiency"),
        share(tp + fn).alias("coverage"),
        safe_ratio(tp, tp + fp).alias("high_value_precision"),
        safe_ratio(tp, tp + fn).alias("high_value_recall"),
    )


def approval(metrics: DataFrame) -> DataFrame:
    """Approval record from a row with accuracy, precision, recall and auc; equality passes."""
    passes = {name: F.coalesce(F.col(name) >= floor, F.lit(False)) for name, floor in THRESHOLDS.items()}
    approved = passes["accuracy"] & passes["precision"] & passes["recall"] & passes["auc"]
    return metrics.select(
        approved.alias("approve_model"),
        F.struct(*[ok.alias(f"{name}_pass") for name, ok in passes.items()]).alias("approval_criteria"),
        F.struct(*[F.lit(floor).alias(f"min_{name}") for name, floor in THRESHOLDS.items()]).alias("thresholds"),
        F.when(approved, REASON_PASS).otherwise(REASON_FAIL).alias("recommendation_reason"),
    )


def all_metrics(scored: DataFrame, label: str = "y", prediction: str = "predicted", score: str = "p1") -> DataFrame:
    """One row: the count-based metrics and the AUC."""
    auc = roc_auc(scored, label, score)
    return binary_metrics(counts(scored, label, prediction)).withColumn("auc", auc.scalar())


def evaluation_record(scored: DataFrame, label: str = "y", prediction: str = "predicted", score: str = "p1") -> DataFrame:
    """The full one-row evaluation document: metrics, matrix, report and business numbers."""
    cells = counts(scored, label, prediction)
    report = classification_report(cells).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("report"))
    business = business_metrics(cells)
    business = business.select(F.struct(*business.columns).alias("b"))
    auc = roc_auc(scored, label, score)
    metrics = binary_metrics(cells).select(*[F.col(m).alias(f"test_{m}") for m in METRICS])
    matrix = cells.select(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("m"))
    return metrics.select(
        "*",
        auc.scalar().alias("test_auc"),
        matrix.scalar().alias("confusion_matrix"),
        report.scalar().alias("classification_report"),
        business.scalar().alias("business_metrics"),
    )
