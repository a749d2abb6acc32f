"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document stands up to ``cap`` times in the queue of its source, in a shuffled order that depends on its id
alone. The virtual finish time of a copy is the number of words of its source up to and with it, divided by the
source's target, and the mix is the order of all copies of all sources by that time. Since the targets add up to the
total budget, the words reach the budget where the time reaches 1: there the order is cut. A document that the cut goes
through stays if at least half of it lies before, so a source misses its target by half a document at most.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
ordered last; rows with equal id are ordered by size and text, and equal rows finish at the same time; an empty table gives
an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import WORD
from cohortflow.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
#: Groups of the shuffled order within a source, as hex digits.
ORDER_DIGITS = 3


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source with its words, weight and target.

    The weights share all words; a source whose share is above ``cap`` times its words gets just that, and the
    others share the rest by weight: sources are filled in the order of cap * words / weight, and the first that
    does not overflow gives the level of all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", (F.row_number().over(by_name) - 1) % len(weights) + 1)
        .withColumn("weight", weight)
        .withColumn("most", (cap * F.col("source_size")).cast("double"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def queue_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns that the queue needs: doc_id, source, size and a digest that tells apart texts with equal id."""
    return docs.select(
        "doc_id", "source", word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest")
    )


def fair_mix(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``queue_rows`` with source_size, target, copies taken and words ``taken``.

    Running sums are taken per source and slice of the shuffled order, so that a source with most of the documents
    is spread over many tasks; the slices' sums per source are a small table.
    """
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    queue = rows.select("doc_id", "source", "size", "digest", order.alias("place"))
    queue = materialize(queue.withColumn("slice", F.substring("place", 1, ORDER_DIGITS)), "mix-queue")
    targets = materialize(source_targets(queue.select("source", "size"), weights, cap), "mix-targets")
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        queue.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .select("source", "slice", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    )
    named = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target")
    # Rows that are equal in all these columns are peers and reach the same sum.
    within = Window.partitionBy("source", "slice").orderBy("place", "size", "digest")
    reached = (
        queue.withColumn("reached", F.sum("size").over(within))
        .alias("q")
        .join(named.alias("n"), F.col("q.source").eqNullSafe(F.col("n.source")) & (F.col("q.slice") == F.col("n.slice")))
        .select("doc_id", "q.source", "size", "digest", "source_size", "target", (F.col("reached") + F.col("offset")).alias("reached"))
    )
    # A copy is taken if its middle lies before time 1; doubled, so that all but the target are whole numbers.
    doubled = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: 2 * (F.col("reached") + k * F.col("source_size")) - F.col("size"))
    copies = F.size(F.filter(doubled, lambda d: d.cast("double") <= 2 * F.col("target")))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    return reached.withColumn("copies", copies).select(
        "doc_id", "source", "size", "digest", "source_size", "target", "reached", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in the order of the mix; other columns pass through."""
    plan = fair_mix(queue_rows(docs, text), weights, cap).where("copies > 0")
    # Rows that are equal here have equal plans.
    plan = plan.dropDuplicates(["doc_id", "source", "digest"])
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "source", digest.alias("digest"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "source", "digest")]
    joined = packed.alias("d").join(plan.alias("p").hint("shuffle_hash"), same[0] & same[1] & same[2])
    times = F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda k: (F.col("reached") + k * F.col("source_size")).cast("double") / F.col("target")
    )
    queue = joined.select("row", F.col("d.digest").alias("digest"), F.explode(times).alias("finish"))
    return queue.repartitionByRange("finish", "digest").sortWithinPartitions("finish", "digest").select("row.*")
