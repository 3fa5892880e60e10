"""Columns that are evaluated exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-element generator.

    A plain projection is merged into its readers, so a costly expression read
    by a filter and several fields runs once for each. The generator is a
    barrier to that, without a shuffle or a cache.
    """
    named = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(named)))
