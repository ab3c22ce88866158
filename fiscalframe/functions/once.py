"""Keeping the optimizer from copying costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that filters and projections above do not copy.

    A filter on a projected column is normally pushed below the projection with
    the column's expression in place of its name: an extracted field would be
    extracted once per mention in the filter, and again for the output.  A
    generator of one row keeps such filters above, while those on the other
    columns still reach the scan.  A generator is computed even if its column is
    not read, so only wanted columns should be added.

    The value is projected below the generator, which keeps its code in a method
    of its own.
    """
    return df.withColumn("_once", value).select(*df.columns, F.inline(F.array(F.struct(F.col("_once").alias(name)))))


def non_empty(text: Column) -> Column:
    """The text, or null if it is empty; unlike nullif it mentions the text once."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))
