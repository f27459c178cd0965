"""Dashboard feeds (D1-D8) over the metrics and raw tables.

Means over metric rows are weighted by ``event_count`` (a mean of window
means would over-weight quiet windows). A p95 cannot be merged from p95s:
``d4_p95_latency`` reports the largest one, an upper bound of the bucket's p95,
and ``d4_exact_p95_per_scenario`` the p95 itself, from latency counts.
Weighted means are exact: the stored averages have a fixed scale, so
``sum(avg * 10^s * count)`` is an integer and the quotient is rounded HALF_UP
with integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio_half_up
from ..operators.metrics import percentiles_of_partials
from .queries import as_of_column, q06_recent_events, throughput_per_window


def _weighted(avg_col: str, scale: int) -> Column:
    units = (F.col(avg_col) * F.lit(10 ** scale)).cast("decimal(38,0)") * F.col("event_count").cast("decimal(38,0)")
    return ratio_half_up(F.sum(units), F.sum("event_count"), scale)


def _period(metrics: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        s = as_of_column(start)
        metrics = metrics.filter((F.col("bucket_start") >= s) & (F.col("bucket_date") >= F.to_date(s))) \
            if "bucket_date" in metrics.columns else metrics.filter(F.col("bucket_start") >= s)
    if end is not None:
        e = as_of_column(end)
        metrics = metrics.filter(F.col("bucket_start") < e)
    return metrics


def d1_avg_price_per_symbol(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return (_period(metrics, start, end).groupBy(F.col("bucket_start").alias("time"), "symbol")
            .agg(_weighted("avg_price", 6).alias("avg_price"))
            .orderBy("time", "symbol"))


def d2_volume_per_symbol(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return (_period(metrics, start, end).groupBy(F.col("bucket_start").alias("time"), "symbol")
            .agg(F.sum("total_quantity").cast("long").alias("volume"))
            .orderBy("time", "symbol"))


def d3_avg_latency_per_scenario(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return (_period(metrics, start, end).groupBy(F.col("bucket_start").alias("time"), "scenario")
            .agg(_weighted("avg_ingestion_latency_ms", 2).alias("avg_latency_ms"))
            .orderBy("time", "scenario"))


def d4_p95_latency(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return (_period(metrics, start, end).groupBy(F.col("bucket_start").alias("time"), "scenario")
            .agg(F.max("p95_ingestion_latency_ms").alias("p95_latency_ms_upper"))
            .orderBy("time", "scenario"))


def d4_exact_p95_per_scenario(partials: DataFrame, start=None, end=None) -> DataFrame:
    """The p95 over all symbols of a window, from the latency counts that the
    streaming job keeps (``operators.partials``; in batch ``window_partials``)."""
    of = percentiles_of_partials(_period(partials, start, end), ["bucket_start", "scenario"], {"p95_latency_ms": 95})
    return of.withColumnRenamed("bucket_start", "time").orderBy("time", "scenario")


def d5_persisted_throughput(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return throughput_per_window(_period(metrics, start, end)).orderBy("time", "scenario")


def d6_total_events(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return _period(metrics, start, end).agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("long")
                                            .alias("total_events"))


def d7_avg_latency(metrics: DataFrame, start=None, end=None) -> DataFrame:
    return _period(metrics, start, end).agg(_weighted("avg_ingestion_latency_ms", 2).alias("avg_latency_ms"))


def d8_recent_events(raw: DataFrame, limit: int = 20) -> DataFrame:
    return q06_recent_events(raw, limit)
