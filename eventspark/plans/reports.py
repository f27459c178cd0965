"""Run reports (R1-R7): DataFrames, written as CSV with a header by
``sources.connect.write_csv``.

R1-R5 read the raw and metrics tables; R6 and R7 read the CSV artefacts of
experiment runs (query timings, container resource samples).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import bankers, decimal_half_up, exact_avg_half_up, ratio_half_up
from ..functions.timefn import time_bucket
from ..operators.percentiles import spread_percentiles, with_percentiles
from ..sources.connect import read_run_csv


def r1_latency_by_scenario(raw: DataFrame) -> DataFrame:
    """count, avg, stddev, p50, p95, max latency and avg lag per scenario;
    averages and stddev rounded to 2 decimals (HALF_UP)."""
    n = F.count(F.lit(1))
    lat = "ingestion_latency_ms"
    return (spread_percentiles(raw, ["scenario"], lat, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
                             n.alias("total_events"),
                             exact_avg_half_up(F.sum(lat), n, 2).alias("avg_latency_ms"),
                             decimal_half_up(F.stddev_samp(lat), 2).alias("stddev_latency_ms"),
                             F.max(lat).alias("max_latency_ms"),
                             exact_avg_half_up(F.sum("event_lag_ms"), n, 2).alias("avg_event_lag_ms"))
            .select("scenario", "total_events", "avg_latency_ms", "stddev_latency_ms", "p50_latency_ms",
                    "p95_latency_ms", "max_latency_ms", "avg_event_lag_ms")
            .orderBy("scenario"))


def _throughput_by_scenario(raw: DataFrame, zero_span_gives_count: bool) -> DataFrame:
    agg = (raw.groupBy("scenario")
           .agg(F.min("processing_time").alias("first_processing_time"),
                F.max("processing_time").alias("last_processing_time"),
                F.count(F.lit(1)).alias("total_events")))
    span_us = F.unix_micros("last_processing_time") - F.unix_micros("first_processing_time")
    # events / seconds = events * 10^6 / microseconds, rounded exactly.
    rate = ratio_half_up(F.col("total_events") * F.lit(1_000_000), span_us, 2)
    fallback = F.col("total_events").cast("decimal(38,2)") if zero_span_gives_count else F.lit(None).cast("decimal(38,2)")
    return (agg.withColumn("effective_events_per_second", F.when(span_us > 0, rate).otherwise(fallback))
            .orderBy("scenario"))


def r2_throughput_by_scenario(raw: DataFrame) -> DataFrame:
    """Effective events/s per scenario; a zero time span gives the count."""
    return _throughput_by_scenario(raw, True)


def r3_throughput_by_scenario(raw: DataFrame) -> DataFrame:
    """Effective events/s per scenario; a zero time span gives NULL."""
    return _throughput_by_scenario(raw, False)


def r4_minute_by_minute(raw: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    df = raw.withColumn("minute", time_bucket(F.col("processing_time"), "1 minute"))
    return (with_percentiles(df, ["minute", "scenario"], "ingestion_latency_ms", {"p95_latency_ms": 0.95},
                             n.alias("events"),
                             exact_avg_half_up(F.sum("ingestion_latency_ms"), n, 2).alias("avg_latency_ms"))
            .select("minute", "scenario", "events", "avg_latency_ms", "p95_latency_ms")
            .orderBy("minute", "scenario"))


EXPORT_METRIC_COLUMNS = ["bucket_start", "bucket_end", "symbol", "scenario", "event_count", "avg_price",
                         "total_quantity", "avg_ingestion_latency_ms", "p95_ingestion_latency_ms",
                         "max_ingestion_latency_ms"]


def r5_aggregated_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select(*EXPORT_METRIC_COLUMNS).orderBy("bucket_start", "symbol", "scenario")


# ------------------------------------------------------- run artefacts

QUERY_TIMINGS_FILE = "query-response-times.csv"
RESOURCE_SAMPLES_FILE = "docker-stats-samples.csv"


def r6_query_timings(spark: SparkSession, root: str) -> DataFrame:
    """All query timing files below ``root`` in one frame, except those in a
    directory whose path contains ``summary`` (any case); blank and repeated
    header rows are dropped. The ``type`` column is kept."""
    df = read_run_csv(spark, root, QUERY_TIMINGS_FILE)
    df = df.filter(~F.lower(F.col("source_dir")).contains("summary"))
    df = df.filter(F.col("elapsed_ms").isNotNull() & (F.trim("elapsed_ms") != "")
                   & (F.col("elapsed_ms") != "elapsed_ms"))
    return df.select("query", "window", "scenario", "type", "elapsed_ms")


def r7_resource_usage(spark: SparkSession, root: str) -> DataFrame:
    """Mean CPU % and memory % per scenario and container, with the sample
    count; the scenario is the part of the run directory name after its last
    ``-``; means are rounded half to even."""
    df = read_run_csv(spark, root, RESOURCE_SAMPLES_FILE)
    df = df.filter(F.col("cpu_percent").isNotNull() & (F.col("cpu_percent") != "")
                   & (F.col("cpu_percent") != "cpu_percent"))
    scenario = F.regexp_extract(F.col("source_dir"), r"([^/\\-]+)$", 1)
    pct = lambda c: (F.regexp_replace(F.col(c), "%", "")).try_cast("double")
    return (df.withColumns({"scenario": scenario, "_cpu": pct("cpu_percent"), "_mem": pct("memory_percent")})
            .groupBy("scenario", "container")
            .agg(F.count(F.lit(1)).alias("sample_count"),
                 bankers(F.avg("_cpu"), 2).alias("avg_cpu_percent"),
                 bankers(F.avg("_mem"), 2).alias("avg_mem_percent"))
            .orderBy("scenario", "container"))
