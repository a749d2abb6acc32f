"""Indices of category values, looked up for each feature in the way that its size asks for.

* Up to ``LITERAL_VALUES`` values stand in the plan itself: no join and no shuffle.
* Up to ``BROADCAST_MAX_ROWS`` values travel to the rows.
* More are joined by shuffle. Values that were frequent when the index was made, at most ``HOT_VALUES`` of a feature, travel
  to the rows as well, so no hot value meets in one task; the rest is salted, as a value may be frequent that was not then.

What is small is collected once, when the index is made, so that applying it runs no job: it works on a stream too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators.ordering import running_totals
from cohortflow.session import BROADCAST_MAX_ROWS, local_table, materialize

# Fixed value: the text of a missing category.
MISSING_CATEGORY = "nan"

LITERAL_VALUES, HOT_VALUES = 64, 1000
#: A value is frequent from this share of the rows on; copies of a large index that its rows are dealt to.
HOT_SHARE, SALTS = 1e-4, 8

ENTRIES = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


def category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING_CATEGORY))


@dataclass(frozen=True)
class CategoryIndex:
    """(feature, value, idx, n) as a table, and the parts of it that are small enough to go along with the plan."""

    entries: DataFrame
    sizes: dict[str, int]
    #: The values of small features in order; those of middle-sized ones, and the frequent ones of large ones, with their index.
    literal: dict[str, list[str]] = field(repr=False)
    sent: dict[str, list[tuple[str, int]]] = field(repr=False)
    broadcast_rows: int = BROADCAST_MAX_ROWS

    @property
    def table(self) -> DataFrame:
        return self.entries.select("feature", "value", "idx")

    @staticmethod
    def of(entries: DataFrame, literal_values: int = LITERAL_VALUES, broadcast_rows: int = BROADCAST_MAX_ROWS) -> CategoryIndex:
        """From a stored table of entries."""
        totals = entries.groupBy("feature").agg(F.count("*").alias("size"), F.sum("n").alias("rows")).collect()  # a row per feature
        sizes = {row["feature"]: row["size"] for row in totals}
        literal = {row["feature"]: [] for row in totals if row["size"] <= literal_values}
        sent = {row["feature"]: [] for row in totals if row["size"] > literal_values}
        wanted = F.lit(False)
        for row in totals:
            part = F.col("feature") == row["feature"]
            wanted = wanted | (part if row["size"] <= broadcast_rows else part & (F.col("n") >= max(2.0, HOT_SHARE * row["rows"])))
        rows = entries.where(wanted).select("feature", "value", "idx", "n")
        # At most ``broadcast_rows`` of a feature: fewer entries, or those with their share of the rows.
        for feature, value, idx, n in sorted(rows.collect(), key=lambda r: (r["feature"], r["idx"])):
            if feature in literal:
                literal[feature].append(value)
            else:
                sent[feature].append((value, idx, n))
        for name, found in sent.items():
            if sizes[name] > broadcast_rows:
                found = sorted(found, key=lambda r: (-r[2], r[1]))[:HOT_VALUES]
            sent[name] = [(value, idx) for value, idx, _ in found]
        return CategoryIndex(entries, sizes, literal, sent, broadcast_rows)

    def _sent_side(self, name: str, value: str, idx: str) -> DataFrame:
        schema = T.StructType([T.StructField(value, T.StringType()), T.StructField(idx, T.LongType())])
        return F.broadcast(local_table(self.entries.sparkSession, self.sent[name], schema))

    def encode(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Add ``<name>_encoded``; a value that the index does not hold gets 0, the first value's index."""
        for name in names:
            if name in self.literal or name not in self.sizes:
                values = F.array(*[F.lit(v) for v in self.literal.get(name, [])]).cast("array<string>")
                place = F.array_position(values, category(name)) - 1
                rows = rows.withColumn(f"{name}_encoded", F.greatest(place, F.lit(0)).cast("bigint"))
                continue
            rows = rows.withColumn("_value", category(name)).join(self._sent_side(name, "_value", "_idx"), "_value", "left")
            if self.sizes[name] > self.broadcast_rows:
                rows = self._joined(rows, name)
            rows = rows.withColumn(f"{name}_encoded", F.coalesce("_idx", F.lit(0)).cast("bigint")).drop("_value", "_idx")
        return rows

    def _joined(self, rows: DataFrame, name: str) -> DataFrame:
        """``_idx`` of the values that were not sent. Rows that have one already are dealt out evenly and meet nothing."""
        plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        dealt = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
        known = F.col("_idx").isNotNull()
        salted = rows.withColumns(
            {
                "_salt": F.when(known, dealt).otherwise(F.pmod(dealt, F.lit(SALTS))),
                "_rest": F.when(~known, F.col("_value")).otherwise(F.lit("")),
                "_known": known,
            }
        )
        side = self.entries.where(F.col("feature") == name).select(
            F.col("value").alias("_rest"), F.col("idx").alias("_found"), F.lit(False).alias("_known"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("_salt")
        )
        joined = salted.join(side, ["_rest", "_salt", "_known"], "left")
        return joined.withColumn("_idx", F.coalesce("_idx", "_found")).drop("_rest", "_salt", "_known", "_found")


def fit_index(
    rows: DataFrame, names: list[str], literal_values: int = LITERAL_VALUES, broadcast_rows: int = BROADCAST_MAX_ROWS
) -> CategoryIndex:
    """The distinct values of each feature, numbered in ascending order, with how often they occur."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), category(n).alias("value")) for n in names])
    counted = materialize(rows.select(F.inline(pairs)).groupBy("feature", "value").agg(F.count("*").alias("n")), "category-counts")
    placed = running_totals(counted, ["feature", "value"], {"place": F.lit(1).cast("bigint")})
    first = placed.groupBy("feature").agg(F.min("place").alias("first"))  # one row per feature name
    numbered = placed.join(F.broadcast(first), "feature").select("feature", "value", (F.col("place") - F.col("first")).alias("idx"), "n")
    return CategoryIndex.of(materialize(numbered, "category-index"), literal_values, broadcast_rows)
