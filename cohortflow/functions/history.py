"""Experiment history: text form ``exp_3:A:True|exp_7:C:False`` and typed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and spellings of the text form.
ENTRY_SEPARATOR, FIELD_SEPARATOR = "|", ":"
CONVERTED_TRUE, CONVERTED_FALSE = "True", "False"

HISTORY_TYPE = "array<struct<experiment:string,variant:string,converted:boolean>>"


def format_history(history: Column) -> Column:
    """Typed history to text; an empty history is the empty text."""
    return F.array_join(
        F.transform(
            history,
            lambda e: F.concat_ws(
                FIELD_SEPARATOR,
                e["experiment"],
                e["variant"],
                F.when(e["converted"], CONVERTED_TRUE).otherwise(CONVERTED_FALSE),
            ),
        ),
        ENTRY_SEPARATOR,
    )


def parse_history(text: Column) -> Column:
    """Text to typed history; missing or empty text is an empty history."""

    def entry(item: Column) -> Column:
        fields = F.split(item, FIELD_SEPARATOR)
        return F.struct(
            F.get(fields, 0).alias("experiment"),
            F.get(fields, 1).alias("variant"),
            (F.get(fields, 2) == CONVERTED_TRUE).alias("converted"),
        )

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda item: item != "")
    return F.transform(parts, entry).cast(HISTORY_TYPE)


def conversion_rate(history: Column) -> Column:
    """Converted entries over all entries, 0 for an empty history."""
    converted = F.size(F.filter(history, lambda e: e["converted"]))
    return F.coalesce(F.try_divide(converted.cast("double"), F.size(history).cast("double")), F.lit(0.0))
