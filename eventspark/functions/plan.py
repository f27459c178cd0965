"""Expressions that say something to the optimiser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(c: Column) -> Column:
    """The same value, marked non-deterministic: a filter on it is not pushed
    below the projection that computes it, so what lies below is evaluated once
    per row instead of being copied into the filter."""
    return F.when(F.spark_partition_id() < 0, F.lit(None)).otherwise(c)
