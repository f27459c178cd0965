"""Named time-series queries over the raw table, the metrics table and the
roll-ups (Q00-Q12).

Each takes the table(s) as DataFrames and ``as_of`` - the "now" of the
relative-time predicates: ``None`` means ``current_timestamp()``; epoch
microseconds, a ``datetime`` or ISO text (UTC without a zone) or a Column (for
example a scalar subquery) may be given. Each
relative-time predicate also constrains the day partition column when the
table has one, so that the scan prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import average_price, safe_div
from ..functions.timefn import instant, interval_micros, seconds_between, time_bucket
from ..operators.percentiles import spread_percentiles, with_percentiles

LAT = "ingestion_latency_ms"


def as_of_column(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return instant(as_of)


def since(df: DataFrame, time_col: str, as_of, interval: str, date_col: str | None = None) -> DataFrame:
    """``time_col >= as_of - interval`` (+ the day-partition predicate)."""
    bound = F.timestamp_micros(F.unix_micros(as_of_column(as_of)) - F.lit(interval_micros(interval)))
    cond = F.col(time_col) >= bound
    if date_col is None:
        date_col = next((c for c in ("event_date", "bucket_date") if c in df.columns), None)
    if date_col and date_col in df.columns:
        cond = cond & (F.col(date_col) >= F.to_date(bound))
    return df.filter(cond)


def _avg_price() -> Column:
    return average_price("price", 18)


# ------------------------------------------------------------------ Q00

def q00_healthcheck(spark: SparkSession, raw_table: str = "financial_events",
                    partitioned: tuple[str, ...] = ("financial_events", "financial_event_metrics"),
                    database: str | None = None) -> dict[str, DataFrame]:
    """Catalogue check: is the raw table there; which partitioned tables exist,
    with their number of partition columns."""
    cat = spark.catalog
    present = [(database or cat.currentDatabase(), raw_table)] if cat.tableExists(raw_table, database) else []
    rows = []
    for t in sorted(partitioned):
        if cat.tableExists(t, database):
            n = sum(1 for c in cat.listColumns(t, database) if c.isPartition)
            if n:
                rows.append((database or cat.currentDatabase(), t, n))
    return {
        "tables": spark.createDataFrame(present, "table_schema string, table_name string"),
        "partitioned": spark.createDataFrame(rows, "table_schema string, table_name string, num_dimensions int"),
    }


# -------------------------------------------------------------- raw table

def q01_last_5_minutes(raw: DataFrame, as_of=None) -> DataFrame:
    return (since(raw, "event_time", as_of, "5 minutes")
            .groupBy(time_bucket(F.col("event_time"), "10 seconds").alias("bucket"), "symbol")
            .agg(_avg_price().alias("avg_price"),
                 F.sum("quantity").cast("long").alias("total_quantity"),
                 F.avg("ingestion_latency_ms").alias("avg_latency_ms"),
                 F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("bucket").desc(), "symbol"))


def q02_last_1_hour(raw: DataFrame, as_of=None) -> DataFrame:
    return (since(raw, "event_time", as_of, "1 hour")
            .groupBy(time_bucket(F.col("event_time"), "1 minute").alias("bucket"), "symbol")
            .agg(_avg_price().alias("avg_price"),
                 F.min("price").alias("min_price"),
                 F.max("price").alias("max_price"),
                 F.avg("ingestion_latency_ms").alias("avg_latency_ms"),
                 F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("bucket").desc(), "symbol"))


# Exact interpolated percentiles from histograms: ``with_percentiles`` for time
# buckets, ``spread_percentiles`` where a group can hold a large share of all rows.
P50_P95 = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}


def q03_last_24_hours(raw: DataFrame, as_of=None) -> DataFrame:
    df = since(raw, "event_time", as_of, "24 hours").withColumn(
        "bucket", time_bucket(F.col("event_time"), "15 minutes"))
    return (with_percentiles(df, ["bucket", "scenario"], LAT, P50_P95,
                             F.count(F.lit(1)).alias("events"),
                             F.avg(LAT).alias("avg_latency_ms"),
                             F.max(LAT).alias("max_latency_ms"))
            .select("bucket", "scenario", "events", "avg_latency_ms", "p50_latency_ms", "p95_latency_ms",
                    "max_latency_ms")
            .orderBy(F.col("bucket").desc(), "scenario"))


def q04_latency_by_scenario(raw: DataFrame) -> DataFrame:
    return (spread_percentiles(raw, ["scenario"], LAT, P50_P95,
                               F.count(F.lit(1)).alias("total_events"),
                             F.avg(LAT).alias("avg_latency_ms"),
                             F.max(LAT).alias("max_latency_ms"),
                             F.avg("event_lag_ms").alias("avg_event_lag_ms"))
            .select("scenario", "total_events", "avg_latency_ms", "p50_latency_ms", "p95_latency_ms",
                    "max_latency_ms", "avg_event_lag_ms")
            .orderBy("scenario"))


def q05_throughput_per_second(raw: DataFrame, limit: int = 120) -> DataFrame:
    """Events per second of processing time and scenario, latest 120."""
    return (raw.groupBy(time_bucket(F.col("processing_time"), "1 second").alias("second"), "scenario")
            .agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("second").desc(), "scenario")
            .limit(limit))


RECENT_EVENT_COLUMNS = ["event_id", "producer_id", "symbol", "price", "quantity", "event_time",
                        "producer_time", "processing_time", "ingestion_latency_ms", "event_lag_ms",
                        "scenario", "source"]


def q06_recent_events(raw: DataFrame, limit: int = 20) -> DataFrame:
    """Most recently inserted events (ties on ``created_at`` broken by event_id)."""
    return (raw.orderBy(F.col("created_at").desc(), F.col("event_id").desc())
            .select(*RECENT_EVENT_COLUMNS)
            .limit(limit))


def q09_events_by_producer(raw: DataFrame) -> DataFrame:
    return (spread_percentiles(raw, ["producer_id", "scenario"], LAT, {"p95_latency_ms": 0.95},
                               F.count(F.lit(1)).alias("total_events"),
                             F.avg(LAT).alias("avg_latency_ms"),
                             F.min("event_time").alias("first_event_time"),
                             F.max("event_time").alias("last_event_time"))
            .select("producer_id", "scenario", "total_events", "avg_latency_ms", "p95_latency_ms",
                    "first_event_time", "last_event_time")
            .orderBy("scenario", "producer_id"))


# ---------------------------------------------------------- metrics table

RECENT_METRIC_COLUMNS = ["bucket_start", "bucket_end", "symbol", "scenario", "event_count", "avg_price",
                         "total_quantity", "avg_ingestion_latency_ms", "p50_ingestion_latency_ms",
                         "p95_ingestion_latency_ms", "max_ingestion_latency_ms"]


def q07_aggregated_metrics_recent(metrics: DataFrame, limit: int = 50) -> DataFrame:
    return (metrics.orderBy(F.col("bucket_start").desc(), "symbol", "scenario")
            .select(*RECENT_METRIC_COLUMNS)
            .limit(limit))


def throughput_per_window(metrics: DataFrame) -> DataFrame:
    """Per window start and scenario: events, window length in seconds and
    events per second (NULL for a zero-length window)."""
    secs = seconds_between(F.min("bucket_start"), F.max("bucket_end"))
    return (metrics.groupBy(F.col("bucket_start").alias("time"), "scenario")
            .agg(F.sum("event_count").cast("long").alias("events"),
                 secs.alias("window_seconds"),
                 safe_div(F.sum("event_count"), secs).alias("events_per_second")))


def q08_aggregated_throughput(metrics: DataFrame, limit: int = 120) -> DataFrame:
    return throughput_per_window(metrics).orderBy(F.col("time").desc(), "scenario").limit(limit)


# ---------------------------------------------------------------- roll-ups

def q10_rollup_last_5_minutes(minute: DataFrame, as_of=None) -> DataFrame:
    return (since(minute, "bucket", as_of, "5 minutes")
            .select("bucket", "symbol", "event_count", "avg_price", "total_quantity",
                    "avg_latency_ms", "max_latency_ms")
            .orderBy(F.col("bucket").desc(), "symbol"))


def q11_rollup_last_1_hour(minute: DataFrame, as_of=None) -> DataFrame:
    return (since(minute, "bucket", as_of, "1 hour")
            .select("bucket", "symbol", "event_count", "avg_price", "min_price", "max_price",
                    "avg_latency_ms", "max_latency_ms")
            .orderBy(F.col("bucket").desc(), "symbol"))


def q12_rollup_last_24_hours(quarter: DataFrame, as_of=None) -> DataFrame:
    """Rows of the 15-minute roll-up as stored: one per (bucket, symbol,
    scenario), without the symbol column and without re-grouping."""
    return (since(quarter, "bucket", as_of, "24 hours")
            .select("bucket", "scenario", "event_count", "avg_latency_ms", "max_latency_ms")
            .orderBy(F.col("bucket").desc(), "scenario"))
